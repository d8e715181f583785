"""Technical indicators over price bars (symbol, date, open, high, low, close, volume).

Windows partition by symbol; exponential averages are folds over the symbol's
bars, of which there is one a day at most, so an array stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("symbol").orderBy("date")


def _last(n: int):
    return _order().rowsBetween(1 - n, 0)


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).drop("back")


def moving_average(n: int, column: str = "close") -> Column:
    """Mean of ``n`` bars, null while there are fewer; four decimals hold means of cents over 5, 10 and 20 exactly."""
    return F.when(F.count(column).over(_last(n)) == n, F.round(F.avg(column).over(_last(n)), 4))


def bar_statistics(bars: DataFrame) -> DataFrame:
    """Per symbol: latest, high, low, change in %, mean volume, up and down days; symbols with one bar are left out."""
    rows = bars.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.max_by("close", "date").alias("latest"),
        F.min_by("close", "date").alias("first"),
        F.max("high").alias("highest"),
        F.min("low").alias("lowest"),
        F.avg("volume").cast("long").alias("mean_volume"),
        F.sum((F.col("close") > F.col("open")).cast("long")).alias("up_days"),
        F.sum((F.col("close") <= F.col("open")).cast("long")).alias("down_days"),
    )
    change = F.round((F.col("latest") / F.col("first") - 1) * 100, 2).alias("change_pct")
    return rows.where("n >= 2").select("symbol", "n", "latest", "highest", "lowest", change, "mean_volume", "up_days", "down_days")


def averages(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", "close", *(moving_average(n).alias(f"ma{n}") for n in (5, 10, 20)))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI of simple means, from bar ``n``; a flat series has no gain and no loss, RSI 0, and ``is_flat``."""
    change = F.coalesce(F.col("close") - F.lag("close").over(_order()), F.lit(0.0))
    rows = bars.withColumn("gain", F.greatest(change, F.lit(0.0))).withColumn("loss", F.greatest(-change, F.lit(0.0)))
    up, down = F.avg("gain").over(_last(n)), F.avg("loss").over(_last(n))
    value = 100 - 100 / (1 + up / F.when(down == 0, 1e-10).otherwise(down))
    full = F.count("*").over(_last(n)) == n
    return rows.select("symbol", "date", F.when(full, F.round(value, 4)).alias("rsi"), F.when(full, (up == 0) & (down == 0)).alias("is_flat"))


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean and bands of ``width`` sample deviations, and where the close stands."""
    full = F.count("close").over(_last(n)) == n
    mid, dev = F.avg("close").over(_last(n)), F.stddev_samp("close").over(_last(n))
    rows = bars.select("symbol", "date", "close", F.when(full, mid).alias("mid"), F.when(full, mid + width * dev).alias("upper"), F.when(full, mid - width * dev).alias("lower"))
    place = F.when(F.col("upper").isNull(), None).when(F.col("close") >= F.col("upper") * 0.98, "upper").when(F.col("close") <= F.col("lower") * 1.02, "lower").otherwise("middle")
    return rows.select("symbol", "date", F.round("mid", 4).alias("mid"), F.round("upper", 4).alias("upper"), F.round("lower", 4).alias("lower"), place.alias("position"))


#: Values that are averaged into one array before they are joined to the others.
_EWM_BLOCK = 64


def _ewm(values: Column, alpha: float) -> Column:
    """Exponential averages of an array: each the last times 1 - alpha plus the value times alpha.

    The array is folded in blocks that hand on their last average, so its parts
    are copied once and not for every value.
    """

    def averaged(last: Column, some: Column) -> Column:
        return F.aggregate(some, F.array(last), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) * (1 - alpha) + x * alpha)))

    def step(state: Column, some: Column) -> Column:
        first = averaged(F.element_at(some, 1), F.slice(some, 2, _EWM_BLOCK))
        later = F.slice(averaged(state["last"], some), 2, _EWM_BLOCK)
        made = F.array(F.when(state["last"].isNull(), first).otherwise(later))
        return F.transform(made, lambda m: F.struct(F.concat(state["done"], F.array(m)).alias("done"), F.element_at(m, -1).alias("last")))[0]

    def folded(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _EWM_BLOCK).cast("int")), lambda i: F.slice(v, i * _EWM_BLOCK + 1, F.lit(_EWM_BLOCK)))
        nothing = F.struct(F.array().cast("array<array<double>>").alias("done"), F.lit(None).cast("double").alias("last"))
        return F.flatten(F.aggregate(blocks, nothing, step, lambda s: s["done"]))

    return F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, folded(v)).otherwise(v))[0]


def _series(bars: DataFrame, *columns: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("date", *columns)))
    return bars.groupBy("symbol").agg(ordered.alias("bars"))


def macd(bars: DataFrame, least: int = 26) -> DataFrame:
    """DIF (12 - 26), DEA (9) and twice their difference, with the crossing of the last two bars.

    Symbols with fewer than ``least`` bars are left out.
    """
    rows = _series(bars, "close").where(F.size("bars") >= least)
    rows = rows.withColumn("close", F.col("bars.close"))
    rows = rows.withColumn("dif", F.zip_with(_ewm(F.col("close"), 2 / 13), _ewm(F.col("close"), 2 / 27), lambda a, b: a - b))
    rows = rows.withColumn("dea", _ewm(F.col("dif"), 2 / 10))
    each = rows.select("symbol", F.posexplode(F.arrays_zip(F.col("bars.date").alias("date"), "dif", "dea")).alias("i", "x"))
    dif, dea = F.col("x.dif"), F.col("x.dea")
    before = F.lag(dif - dea).over(Window.partitionBy("symbol").orderBy("i"))
    cross = F.when((before <= 0) & (dif > dea), "golden").when((before >= 0) & (dif < dea), "dead").when(dif > dea, "bull").otherwise("bear")
    return each.select("symbol", F.col("x.date").alias("date"), F.round(dif, 4).alias("dif"), F.round(dea, 4).alias("dea"), F.round(2 * (dif - dea), 4).alias("hist"), cross.alias("cross"))


def kdj(bars: DataFrame, n: int = 9) -> DataFrame:
    """K and D are averages of RSV with a third of weight, from the first full window; J is 3K - 2D."""
    low, high = F.min("low").over(_last(n)), F.max("high").over(_last(n))
    rsv = (F.col("close") - low) / (high - low + 1e-10) * 100
    rows = bars.select("symbol", "date", rsv.alias("rsv"), F.count("*").over(_last(n)).alias("c")).where(F.col("c") == n)
    rows = _series(rows, "rsv").withColumn("k", _ewm(F.col("bars.rsv"), 1 / 3))
    rows = rows.withColumn("d", _ewm(F.col("k"), 1 / 3))
    each = rows.select("symbol", F.explode(F.arrays_zip(F.col("bars.date").alias("date"), "k", "d")).alias("x"))
    return each.select("symbol", F.col("x.date").alias("date"), F.round("x.k", 4).alias("k"), F.round("x.d", 4).alias("d"), F.round(3 * F.col("x.k") - 2 * F.col("x.d"), 4).alias("j"))


def event_windows(events: DataFrame, bars: DataFrame, width: int = 10) -> DataFrame:
    """Per event (event_id, symbol, event_date): mean change in % of ``width`` bars before and after the nearest bar.

    The nearest bar is by real dates, the earlier of two equally near; changes
    are from close to close. Each bar stands for the days to which it is the
    nearest, so an event meets one row and not the bars of its symbol.
    """
    before, after = F.lag("date").over(_order()), F.lead("date").over(_order())
    numbered = bars.select("symbol", "date", "close", F.row_number().over(_order()).alias("n"), ((F.col("close") / F.lag("close").over(_order()) - 1) * 100).alias("pct"), before.alias("before"), after.alias("after"))
    half = lambda low, high: F.date_add(low, F.floor(F.datediff(high, low) / 2).cast("int"))
    begin = F.coalesce(F.date_add(half(F.col("before"), F.col("date")), 1), F.col("date"))
    days = numbered.select("symbol", "n", F.explode(F.sequence(begin, F.coalesce(half(F.col("date"), F.col("after")), F.col("date")))).alias("day"))
    bounds = bars.groupBy("symbol").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    day = F.greatest(F.least("event_date", "high"), "low")
    near = events.join(bounds, "symbol").withColumn("day", day).join(days, ["symbol", "day"]).select("event_id", "symbol", F.col("n").alias("at"))
    around = near.withColumn("n", F.explode(F.sequence(F.col("at") - width, F.col("at") + width)))
    rows = around.join(numbered.select("symbol", "n", "pct"), ["symbol", "n"])
    mean = lambda side: F.round(F.avg(F.when(side, F.col("pct"))), 4)
    out = rows.groupBy("event_id", "symbol").agg(mean(F.col("n") < F.col("at")).alias("before_pct"), mean(F.col("n") > F.col("at")).alias("after_pct"), F.count("*").alias("n_bars"))
    return out.withColumn("delta_pct", F.round(F.col("after_pct") - F.col("before_pct"), 4))


def signals(rsi_rows: DataFrame, high: float = 70.0, low: float = 30.0) -> DataFrame:
    """``rsi`` rows with a label: overbought over ``high``, oversold under ``low``, flat, neutral; null before the first value."""
    value = F.col("rsi")
    label = F.when(value.isNull(), None).when(F.col("is_flat"), "flat").when(value > high, "overbought").when(value < low, "oversold").otherwise("neutral")
    return rsi_rows.withColumn("signal", label)


def is_fund(code: Column, prefixes: tuple[str, ...] = ("51", "159")) -> Column:
    """Whether a code is that of an exchange-traded fund, by how it begins."""
    out = F.lit(False)
    for prefix in prefixes:
        out = out | code.startswith(prefix)
    return F.coalesce(out, F.lit(False))


def find_instruments(instruments: DataFrame, keyword: str, limit: int = 10, name: str = "name", code: str = "code") -> DataFrame:
    """The first instruments by code whose name has the keyword."""
    return instruments.where(F.contains(F.col(name), F.lit(keyword))).orderBy(code).limit(limit)


def bar_report(bars: DataFrame, last: int = 10) -> DataFrame:
    """(symbol, text): statistics and the last bars with their averages, a line each."""
    stats = bar_statistics(bars)
    rows = tail(bars.select("symbol", "date", "open", "close", moving_average(5).alias("ma5")), last)
    number = lambda c: F.format_string("%.2f", F.col(c))
    line = F.concat_ws(" | ", F.col("date").cast("string"), number("open"), number("close"), F.when(F.col("ma5").isNull(), "-").otherwise(number("ma5")))
    lines = rows.groupBy("symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("# "), F.col("symbol"), F.format_string("\nlatest %.2f, high %.2f, low %.2f, change %.2f%%, up %d, down %d\n", "latest", "highest", "lowest", "change_pct", "up_days", "down_days"))
    return stats.join(lines, "symbol").select("symbol", F.concat(head, F.col("lines")).alias("text"))
