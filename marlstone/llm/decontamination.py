"""Benchmark decontamination by spaced-seed hashing, as DataFrame operations.

A seed is a fixed mask over some consecutive tokens that ignores some positions.
Hashes of the masked tokens of all training positions are joined to those of the
benchmark, so a hit survives substitutions in the ignored positions. Around each
hit the two texts are laid over each other: a document is contaminated by an
item if some window of WINDOW tokens of the item (the whole item, if it is
shorter) agrees with it in at least SHARE of its tokens. The masks find every such
window, wherever its substitutions are; a test enumerates them.

The training side is never shuffled before the join: the distinct hashes of the
benchmark are counted and broadcast if they are few; more are joined by shuffle,
and then only ids, positions and hashes move. Only hits carry context on.

A phrase that many items share makes hot seeds, which are not joined item by
item. What surrounds them in the items is judged by what it shares first: the
same hot tokens at the same places are one class, and a hit that agrees with
enough of these has met the whole class. What the hot tokens do not decide needs
an agreeing token that few items have there, and is joined on that.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import lookup, staged

#: The masks, as offsets. Together they find all windows of SPAN to
#: WINDOW tokens that agree in SHARE.
SPAN = 11
SEEDS = (
    (0, 5, 6, 7, 8, 9, 10),
    (0, 1, 2, 4, 6, 9, 10),
    (0, 1, 2, 4, 5),
    (0, 1, 3, 8, 10),
)
#: Places of a mask that may lie outside a text; all of them are ignored ones.
EDGE = 2
WINDOW = 20
SHARE = 0.8
#: Distinct benchmark hashes that may be broadcast (9 bytes each).
BROADCAST_HASHES = 2_000_000
#: A seed with more places in the benchmark, or a token with more contexts at one place of it, is hot.
HOT = 64


def tokens(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]+``, lower-cased; an empty array for null."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def needed(width: int | Column) -> int | Column:
    """Agreeing tokens that a window of ``width`` must have."""
    return ceil(width * SHARE) if isinstance(width, int) else F.ceil(width * SHARE).cast("int")


def _short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of ``n`` places that leave none of the substitutions that SHARE allows unignored.

    For k substitutions the places are cut into k + 2 parts, and each mask
    ignores k of them.
    """
    k = n - needed(n)
    edges = [round(n * i / (k + 2)) for i in range(k + 3)]
    parts = [range(edges[i], edges[i + 1]) for i in range(k + 2)]
    return [tuple(j for i, part in enumerate(parts) if i not in out for j in part) for out in combinations(range(k + 2), k)]


def _masks(short: list[int]) -> list[tuple[int, tuple[int, ...], int]]:
    """(number of tokens spanned, offsets, length of the items it is for or 0) of every seed.

    Items of fewer tokens than SPAN cannot hold all masks of SEEDS, so each such
    length has masks of its own. The others are for items of SPAN tokens or more.
    """
    return [(s[-1] + 1, s, 0) for s in SEEDS] + [(n, s, n) for n in short for s in _short_masks(n)]


def _seeds(rows: DataFrame, hashes: str, masks: list[tuple[int, tuple[int, ...], int]], edge: int = 0) -> DataFrame:
    """``rows`` for every position p, from ``-edge``, and mask, with its seed; a mask that reaches too far gives none."""
    size = F.size(hashes)
    rows = rows.where(size > 0).select("*", F.explode(F.sequence(F.lit(-edge), size - 1)).alias("p"))

    def seed(number: int, span: int, offsets: tuple[int, ...]) -> Column:
        some = F.xxhash64(F.lit(number), *(F.get(hashes, F.col("p") + j) for j in offsets))
        return F.when(F.col("p") <= size - span + edge, some)

    return rows.select("*", F.posexplode(F.array(*(seed(k, span, offsets) for k, (span, offsets, _) in enumerate(masks)))).alias("mask", "seed")).where("seed is not null")


def _context(hashes: str, at: Column) -> Column:
    """Token hashes around a span: WINDOW - 1 before its start to WINDOW - 1 after; null outside."""
    return F.array(*(F.get(hashes, at + j) for j in range(1 - WINDOW, WINDOW)))


def benchmark_seeds(items: DataFrame, masks: list[tuple[int, tuple[int, ...], int]], id_col: str, text_col: str) -> DataFrame:
    """(seed, item_id, n, q, span, ictx): every seed of every item with its context."""
    rows = items.select(F.col(id_col).alias("item_id"), F.transform(tokens(F.col(text_col)), lambda w: F.xxhash64(w)).alias("ih")).withColumn("n", F.size("ih"))
    spans = F.element_at(F.array(*(F.lit(s) for s, _, _ in masks)), F.col("mask") + 1)
    meant = F.element_at(F.array(*(F.lit(n) for _, _, n in masks)), F.col("mask") + 1)
    # The seed of a short length is meant for items of just that length.
    seeds = _seeds(rows, "ih", masks).where(F.when(meant == 0, F.col("n") >= SPAN).otherwise(meant == F.col("n")))
    return seeds.select("item_id", "n", F.col("p").alias("q"), spans.alias("span"), "seed", _context("ih", F.col("p")).alias("ictx"))


def _hits(docs: DataFrame, wanted: DataFrame, masks: list[tuple[int, tuple[int, ...], int]], most: int) -> DataFrame:
    """(hit, doc_id, seed, hot, dctx) of the positions of ``docs`` with a seed of the benchmark."""
    if wanted.limit(most + 1).count() <= most:
        hits = _seeds(docs, "dh", masks, EDGE).join(F.broadcast(wanted), "seed")
    else:
        keyed = docs.withColumn("th", F.xxhash64("dh"))
        few = _seeds(keyed, "dh", masks, EDGE).select("doc_id", "th", "p", "seed").join(wanted, "seed").distinct()
        few = staged(few, "seed-positions").select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "p", "seed", "hot")
        hits = keyed.join(few, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")))
    return staged(hits.select(F.monotonically_increasing_id().alias("hit"), "doc_id", "seed", "hot", _context("dh", F.col("p")).alias("dctx")), "seed-hits")


def _windows(bench: DataFrame) -> DataFrame:
    """``bench`` with width, first and last: the starts, within a context, of the windows that hold the span and lie within the item.

    The span starts at WINDOW - 1; a window of w tokens that contains it starts
    between WINDOW - 1 - (w - span) and WINDOW - 1.
    """
    at = F.lit(WINDOW - 1)
    bench = bench.withColumn("width", F.least(F.col("n"), F.lit(WINDOW)))
    first, last = F.greatest(at - (F.col("width") - F.col("span")), at - F.col("q")), F.least(at, at - F.col("q") + F.col("n") - F.col("width"))
    return bench.withColumn("first", first).withColumn("last", last).where("first <= last")


def _overlaps() -> Column:
    """Whether a window around the hit agrees in SHARE of its tokens."""
    agree = F.zip_with("dctx", "ictx", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    most = F.array_max(F.transform(F.sequence("first", "last"), lambda s: F.aggregate(F.slice(agree, s + 1, F.col("width")), F.lit(0), lambda t, x: t + x)))
    return most >= needed(F.col("width"))


def _hot_tokens(contexts: DataFrame) -> DataFrame:
    """(seed, hots): for each place of a context the tokens that more than HOT contexts of the seed have there."""
    places = contexts.select("seed", F.posexplode("ictx").alias("at", "tok")).where("tok is not null")
    often = places.groupBy("seed", "at", "tok").count().where(F.col("count") > HOT)
    # Of n contexts at most n / HOT tokens at a place.
    found = often.groupBy("seed").agg(F.collect_list(F.struct("at", "tok")).alias("found"))
    hots = F.transform(F.sequence(F.lit(0), F.lit(2 * WINDOW - 2)), lambda k: F.transform(F.filter("found", lambda x: x["at"] == k), lambda x: x["tok"]))
    return staged(found.select("seed", hots.alias("hots")), "hot-tokens")


def _rare_places() -> Column:
    """Places and tokens that are not hot, so many that a window which agrees in SHARE, and not by its hot tokens alone, agrees in one.

    Of m allowed substitutions, one of any m + 1 such places of a window agrees;
    those nearest to the span's start on either side lie in every window that
    has as many.
    """
    some = F.filter(
        F.transform(F.zip_with("ictx", "hctx", lambda t, h: F.when(h.isNull(), t)), lambda t, i: F.struct(i.alias("at"), t.alias("tok"))),
        lambda x: x["tok"].isNotNull() & (x["at"] >= F.col("first")) & (x["at"] < F.col("last") + F.col("width")),
    )
    enough = F.col("width") - needed(F.col("width")) + 1
    left = F.slice(F.reverse(F.filter(some, lambda x: x["at"] < WINDOW - 1)), F.lit(1), enough)
    return F.concat(left, F.slice(F.filter(some, lambda x: x["at"] >= WINDOW - 1), F.lit(1), enough))


def _hot_matches(hits: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class) of what agrees around hot seeds, and the members (class, item_id) of the classes."""
    shape = ("seed", "first", "last", "width")
    rows = staged(_windows(bench).select("item_id", *shape, "ictx").withColumn("context", F.xxhash64(F.lit(1), *shape, "ictx")), "hot-rows")
    contexts = staged(rows.dropDuplicates(["context"]).drop("item_id"), "hot-contexts")
    hots = _hot_tokens(contexts)
    shared = F.zip_with("ictx", F.coalesce("hots", F.array().cast("array<array<bigint>>")), lambda t, some: F.when(F.array_contains(some, t), t))
    marks = contexts.join(lookup(hots), "seed", "left").withColumn("hctx", shared).drop("hots")
    # A hash of an array leaves nulls out, so their places are hashed too.
    marks = staged(marks.withColumn("class", F.xxhash64(F.lit(2), *shape, "hctx", F.transform("hctx", lambda h: h.isNull()))), "hot-marks")

    agree = F.zip_with("dctx", "toks", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    classes = marks.dropDuplicates(["class"]).select("class", "seed", "width", F.col("hctx").alias("toks"), F.explode(F.sequence("first", "last")).alias("s"))
    classes = staged(classes.where(F.size(F.filter(F.slice("toks", F.col("s") + 1, F.col("width")), lambda t: t.isNotNull())) >= needed(F.col("width"))), "hot-classes")
    enough = F.aggregate(F.slice(agree, F.col("s") + 1, F.col("width")), F.lit(0), lambda t, x: t + x) >= needed(F.col("width"))
    by_class = hits.join(lookup(classes), "seed").where(enough).select("doc_id", "class")

    keys = staged(marks.select("seed", "context", F.explode(_rare_places()).alias("rare")).select("seed", "context", "rare.at", "rare.tok"), "rare-tokens")
    spots = hits.select("hit", "seed", F.posexplode("dctx").alias("at", "tok"))
    met = staged(spots.join(lookup(keys), ["seed", "at", "tok"]).select("hit", "context").distinct(), "rare-hits")
    by_token = hits.drop("seed").join(met, "hit").join(contexts, "context").where(_overlaps()).select("doc_id", F.col("context").alias("class"))
    members = rows.select("context", "item_id").join(marks.select("context", "class"), "context")
    members = members.select("class", "item_id").unionByName(rows.select(F.col("context").alias("class"), "item_id"))
    return staged(by_class.unionByName(by_token).distinct(), "hot-matches"), members.distinct()


def _matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, most: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Pairs (doc_id, item_id) by seeds that are not hot; classes and members as ``_hot_matches`` gives, if some are."""
    items = items.where(F.col(item_col).isNotNull())
    sizes = items.select(F.size(tokens(F.col(item_text))).alias("n"))
    short = sorted(r[0] for r in sizes.where((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect())  # under SPAN values
    masks = _masks(short)
    bench = staged(benchmark_seeds(items, masks, item_col, item_text), "benchmark-seeds")
    wanted = staged(bench.groupBy("seed").agg((F.count("*") > HOT).alias("hot")), "benchmark-hashes")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.transform(tokens(F.col(text_col)), lambda w: F.xxhash64(w)).alias("dh"))
    hits = _hits(rows, wanted, masks, most)
    pairs = hits.where("not hot").join(_windows(bench), "seed").where(_overlaps()).select("doc_id", "item_id").distinct()
    hot = lookup(wanted.where("hot"))
    return pairs, _hot_matches(hits.where("hot"), bench.join(hot, "seed", "left_semi")) if wanted.where("hot").limit(1).count() else None


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BROADCAST_HASHES) -> DataFrame:
    """Distinct pairs (doc_id, item_id) of documents that overlap a benchmark item.

    Null and empty texts have no tokens and match nothing; null ids of documents
    are passed through, items with a null id are not used. Rows that repeat an id
    are judged together. Either table may be empty. Other columns are not read.
    """
    pairs, hot = _matches(docs, items, id_col, text_col, item_col, item_text, most)
    if hot is None:
        return pairs
    met, members = hot
    return pairs.unionByName(met.join(members, "class").select("doc_id", "item_id")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BROADCAST_HASHES) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all columns; cases as in ``contaminated``."""
    pairs, hot = _matches(docs, items, id_col, text_col, item_col, item_text, most)
    found = pairs.select("doc_id") if hot is None else pairs.select("doc_id").unionByName(hot[0].select("doc_id"))
    bad = staged(found.select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return docs.join(lookup(bad), docs[id_col].eqNullSafe(bad["bad_id"]), "left_anti")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """(doc_id, contaminated, item_ids) for every row of ``docs``; item_ids ascending."""
    found = contaminated(docs, items, id_col, **columns).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("found"))
    found = staged(found, "contaminated").withColumnRenamed("doc_id", "found_id")
    rows = docs.select(F.col(id_col).alias("doc_id")).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    none = F.array().cast(dict(found.dtypes)["found"])
    return rows.select("doc_id", F.col("found").isNotNull().alias("contaminated"), F.coalesce("found", none).alias("item_ids"))
