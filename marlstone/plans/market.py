"""Indicators over daily bars. The bars are made of orders: the priority is the symbol, the price the order's total.

Every bar counts; only ``tail_bars`` is about the last ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators
from .registry import query, table

#: Bars that the tail keeps of each symbol.
DAYS = 250

_BARS = """
bars AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL)
"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar of each symbol; a day gives one at most."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


@query(f"WITH {_BARS} SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k <= {DAYS}")
def tail_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bars of each symbol."""
    return indicators.tail(bars(spark, sf_dir), DAYS)


@query(
    f"""WITH {_BARS}
SELECT symbol, count(*) AS n, max_by(close, date) AS latest, max(high) AS highest, min(low) AS lowest,
       round((max_by(close, date) / min_by(close, date) - 1) * 100, 2) AS change_pct, floor(avg(volume))::BIGINT AS mean_volume,
       sum((close > open)::BIGINT)::BIGINT AS up_days, sum((close <= open)::BIGINT)::BIGINT AS down_days
FROM bars GROUP BY symbol HAVING count(*) >= 2"""
)
def bar_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.bar_statistics(bars(spark, sf_dir))


@query(
    f"""WITH {_BARS} SELECT symbol, date, close,
{", ".join(f"CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) = {n} THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING), 4) END AS ma{n}" for n in (5, 10, 20))}
FROM bars"""
)
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.averages(bars(spark, sf_dir))


@query(
    f"""WITH {_BARS},
g AS (SELECT symbol, date, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS c FROM bars),
a AS (SELECT symbol, date, count(*) OVER w AS n, avg(greatest(c, 0)) OVER w AS up, avg(greatest(-c, 0)) OVER w AS down FROM g
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))
SELECT symbol, date, CASE WHEN n = 14 THEN round(100 - 100 / (1 + up / CASE WHEN down = 0 THEN 1e-10 ELSE down END), 4) END AS rsi,
       CASE WHEN n = 14 THEN up = 0 AND down = 0 END AS is_flat FROM a"""
)
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.rsi(bars(spark, sf_dir))


@query(
    f"""WITH {_BARS},
a AS (SELECT symbol, date, close, count(*) OVER w AS n, avg(close) OVER w AS mid, stddev_samp(close) OVER w AS dev FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
b AS (SELECT symbol, date, close, CASE WHEN n = 20 THEN mid END AS mid, CASE WHEN n = 20 THEN mid + 2 * dev END AS upper, CASE WHEN n = 20 THEN mid - 2 * dev END AS lower FROM a)
SELECT symbol, date, round(mid, 4) AS mid, round(upper, 4) AS upper, round(lower, 4) AS lower,
       CASE WHEN upper IS NULL THEN NULL WHEN close >= upper * 0.98 THEN 'upper' WHEN close <= lower * 1.02 THEN 'lower' ELSE 'middle' END AS position FROM b"""
)
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.bollinger(bars(spark, sf_dir))


def _ewm(values: str, alpha: str) -> str:
    """The averages at every place of a list, each a fold over what comes before."""
    return f"list_transform(range(1, len({values}) + 1), lambda i: list_reduce({values}[1:i], lambda a, x: a * (1 - {alpha}) + x * {alpha}))"


@query(
    f"""WITH {_BARS},
s AS (SELECT symbol, list(date ORDER BY date) AS dates, list(close ORDER BY date) AS c FROM bars GROUP BY symbol HAVING count(*) >= 26),
e AS (SELECT symbol, dates, {_ewm("c", "(2::DOUBLE / 13)")} AS fast, {_ewm("c", "(2::DOUBLE / 27)")} AS slow FROM s),
d AS (SELECT symbol, dates, list_transform(range(1, len(fast) + 1), lambda i: fast[i] - slow[i]) AS dif FROM e),
x AS (SELECT symbol, dates, dif, {_ewm("dif", "(2::DOUBLE / 10)")} AS dea FROM d),
y AS (SELECT symbol, unnest(dates) AS date, unnest(dif) AS f, unnest(dea) AS a FROM x),
z AS (SELECT *, lag(f - a) OVER (PARTITION BY symbol ORDER BY date) AS b FROM y)
SELECT symbol, date, round(f, 4) AS dif, round(a, 4) AS dea, round(2 * (f - a), 4) AS hist,
       CASE WHEN b <= 0 AND f > a THEN 'golden' WHEN b >= 0 AND f < a THEN 'dead' WHEN f > a THEN 'bull' ELSE 'bear' END AS cross FROM z"""
)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.macd(bars(spark, sf_dir))


@query(
    f"""WITH {_BARS},
r AS (SELECT symbol, date, count(*) OVER w AS n, (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w + 1e-10) * 100 AS rsv FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 8 PRECEDING)),
s AS (SELECT symbol, list(date ORDER BY date) AS dates, list(rsv ORDER BY date) AS c FROM r WHERE n = 9 GROUP BY symbol),
e AS (SELECT symbol, dates, {_ewm("c", "(1::DOUBLE / 3)")} AS k FROM s),
d AS (SELECT symbol, dates, k, {_ewm("k", "(1::DOUBLE / 3)")} AS d FROM e),
y AS (SELECT symbol, unnest(dates) AS date, unnest(k) AS k, unnest(d) AS d FROM d)
SELECT symbol, date, round(k, 4) AS k, round(d, 4) AS d, round(3 * k - 2 * d, 4) AS j FROM y"""
)
def kdj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.kdj(bars(spark, sf_dir))


@query(
    f"""WITH {_BARS},
n AS (SELECT symbol, date, row_number() OVER w AS n, (close / lag(close) OVER w - 1) * 100 AS pct FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
e AS (SELECT n_nationkey::BIGINT AS event_id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][n_nationkey % 5 + 1] AS symbol, DATE '1998-01-01' + n_nationkey * 40 AS event_date FROM nation),
a AS (SELECT event_id, symbol, min_by(n, {{'g': abs(date - event_date), 'd': date}}) AS pos FROM e JOIN n USING (symbol) GROUP BY ALL),
r AS (SELECT event_id, a.symbol, pos, n, pct FROM a JOIN n ON a.symbol = n.symbol AND n.n BETWEEN pos - 10 AND pos + 10)
SELECT event_id, symbol, round(avg(pct) FILTER (n < pos), 4) AS before_pct, round(avg(pct) FILTER (n > pos), 4) AS after_pct, count(*) AS n_bars,
       round(round(avg(pct) FILTER (n > pos), 4) - round(avg(pct) FILTER (n < pos), 4), 4) AS delta_pct FROM r GROUP BY ALL"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars around 25 dated events, one per nation, by the nearest real date."""
    return indicators.event_windows(_events(spark, sf_dir), bars(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(key.cast("long").alias("event_id"), F.element_at(names, (key % 5 + 1).cast("int")).alias("symbol"), F.date_add(F.lit("1998-01-01").cast("date"), key * 40).alias("event_date"))


@query(
    f"""WITH {_BARS}, b AS (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM bars)
SELECT symbol, date, CASE WHEN before <> 0 THEN round((close - before) / abs(before) * 100, 2) + 0.0::DOUBLE END AS growth_pct,
       CASE WHEN before <> 0 THEN round(close / before, 2) END AS ratio FROM b"""
)
def growth_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth against the bar before, in % of its absolute value; null where that is missing or 0."""
    return _growth(bars(spark, sf_dir))


def _growth(daily: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    rows = daily.select("symbol", "date", "close", before.alias("before"))
    valid = F.col("before") != 0
    return rows.select("symbol", "date", F.when(valid, F.round((F.col("close") - F.col("before")) / F.abs("before") * 100, 2) + 0.0).alias("growth_pct"), F.when(valid, F.round(F.col("close") / F.col("before"), 2)).alias("ratio"))
