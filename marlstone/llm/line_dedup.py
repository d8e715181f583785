"""Line deduplication by a deletion-neighbourhood join, as DataFrame operations.

A line goes if an earlier line is equal to it or within ``max_edits`` edited
characters. Two lines are so near exactly if deletions in both give the same
string, the deletions of the two, place by place, adding up to no more than the
bound. So each line emits, as hashed keys, its variants with characters deleted;
equal keys are joined, and the edit distance is verified.

1. Equal lines are one: they are grouped by a 128-bit hash, the earliest
   occurrence owns the line. The aggregate is partial, so a line of a license in
   a third of all documents is combined before the shuffle.
2. Cut into one piece more than there are edits, a line within the bound of
   another has one of these pieces in common with it, at nearly the same place.
   Lines whose pieces occur once are settled by this alone, which leaves the
   neighbourhoods to few lines.
3. The others emit variants. Within a key only the earliest line can remove the
   rest, so a minimum per key replaces pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import lookup, staged

def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _order() -> Column:
    """The place of an occurrence; the smallest is the earliest."""
    return F.struct("doc_id", "th", "line_no")


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, line_no, line) of every line that is not blank."""
    # Hash and split come before the explode, else both are made again for every line.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), _split(F.col(text_col)).alias("parts"))
    rows = rows.select("doc_id", "th", F.posexplode_outer("parts").alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _pieces(line: Column, n: Column, edits: int) -> Column:
    """Keys of the pieces that a line can share with a partner whose length differs by ``edits`` at most; null where none fits.

    The shorter partner of ``base`` characters is cut into ``edits + 1`` pieces.
    One of them has no edit. Left of piece j there are then j edits at most or,
    for another piece, right of it ``edits - j`` (else one further left or right
    is free of edits as well), which leaves few places in the longer partner.
    """
    keys = []
    for more in range(edits + 1):
        base = n - more
        for j in range(edits + 1):
            begin = F.floor(base * j / (edits + 1)).cast("int")
            size = F.floor(base * (j + 1) / (edits + 1)).cast("int") - begin
            for shift in range(-edits, edits + 1):
                if abs(shift) <= j and abs(shift - more) <= edits - j:
                    piece = F.xxhash64(F.lit(j), base, F.substring(line, begin + shift + 1, size))
                    # One edit never leaves the line.
                    keys.append(piece if edits <= 1 else F.when((base >= 0) & (begin + shift >= 0), piece))
    return F.array(*keys)


def _near_candidates(lines: DataFrame) -> DataFrame:
    """Hashes of lines that share a piece with another line."""
    keys = lines.select("h1", F.explode("pieces").alias("key")).where("key is not null")
    return staged(_shared_keys(keys, ["key"]).select("h1").distinct(), "near-candidates")


def _shared_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key occurs with more than one line."""
    met = rows.groupBy(*key).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select(*key)
    return rows.join(lookup(staged(met, "shared-keys")), key, "left_semi")


def dropped_lines(docs: DataFrame, max_edits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences that go: (doc_id, th, line_no), th being the hash of the whole text.

    Occurrences are ordered by (id, text hash, line number), null ids first.
    Lines of white space only are never judged. An earlier line removes a later
    one whether or not it is removed itself. A line of n characters costs in the
    order of n to the power ``max_edits + 1`` if others share a piece with it;
    with one edit a variant costs the root of n, and only blocks of such a length
    in which the line may differ from another emit any.
    """
    if max_edits < 0:
        raise ValueError("max_edits is 0 or more")
    found = _occurrences(docs, id_col, text_col)
    marked = found.withColumn("n", F.length("line"))
    marked = marked.select("doc_id", "th", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"), _pieces(F.col("line"), F.col("n"), max_edits).alias("pieces"))
    lines = staged(marked, "lines")
    owners = lines.groupBy("h1", "h2").agg(F.min(_order()).alias("first"))
    distinct = staged(owners, "owners")
    near = _near_lines(found, distinct, _near_candidates(lines), max_edits) if max_edits else None
    rows = lines.join(distinct, ["h1", "h2"])
    again = _order() > F.col("first")
    if near is not None:
        rows = rows.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
        again = again | F.coalesce("near", F.lit(False))
    return rows.where(again).select("doc_id", "th", "line_no")


def _width(base: Column) -> Column:
    """Characters of a block of a line of ``base`` characters: there are about sqrt(base) blocks of about as many."""
    return F.greatest(F.ceil(F.sqrt(base)).cast("int"), F.lit(1))


def _cut(line: Column, width: Column) -> Column:
    """The line's blocks from the left, in one pass over it."""
    return F.regexp_extract_all(line, F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), 0)


def _chain(parts: Column, seed: int) -> Column:
    """Hashes of the first 0, 1, 2, ... parts, each from the one before."""
    return F.aggregate(parts, F.array(F.xxhash64(F.lit(seed))), lambda done, x: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), x))))


def _blocks(texts: DataFrame) -> DataFrame:
    """(h1, h2, base, j, key, key2): for each block of a line the hashes of what stands before and after it.

    A line takes part with its own length as the shorter or equal partner, and
    with one less as the longer one. A pair within one edit agrees before and
    after the block of the shorter line that holds the edit. The hashes are
    chained over blocks, so all of them together read a line a few times.
    """
    rows = texts.select("h1", "h2", "line", "n", F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("base")).withColumn("w", _width(F.col("base")))
    left = _cut(F.col("line"), F.col("w"))
    right = F.reverse(_cut(F.substring(F.col("line"), F.col("n") - F.col("base") + 1, F.col("n")), F.col("w")))
    parts = F.struct("base", F.greatest(F.ceil(F.col("base") / F.col("w")).cast("int"), F.lit(1)).alias("count"), left.alias("left"), right.alias("right"))

    def chains(x: Column) -> Column:
        return F.struct(x["base"].alias("base"), x["count"].alias("count"), *(_chain(x[side], seed).alias(f"{side}{seed}") for side in ("left", "right") for seed in (1, 2)))

    def keys(x: Column) -> Column:
        outside = lambda j, seed: F.xxhash64(F.lit(seed), x["base"], j, F.get(x[f"left{seed}"], j), F.get(x[f"right{seed}"], x["count"] - 1 - j))
        return F.transform(F.sequence(F.lit(0), x["count"] - 1), lambda j: F.struct(j.alias("j"), outside(j, 1).alias("key"), outside(j, 2).alias("key2")))

    # Fields of a lambda's argument are made once, and not for every block.
    found = F.transform(F.transform(F.array(parts), chains), keys)[0]
    return rows.select("h1", "h2", "base", F.explode(found).alias("b")).select("h1", "h2", "base", "b.*")


def _variants(texts: DataFrame) -> DataFrame:
    """Variants (h1, h2, first, kind, at, k1, k2) that can meet one of another line.

    Kind ``s`` is a line without one character, to meet lines of its length
    without the one at the same place; ``w`` is a line as it is, and ``d`` one
    without a character, to meet a whole one; ``at`` is the place of that character
    in the line, 0 for none. The key is made of the hashes of
    what stands outside the block and of the rest of the block alone, so a variant
    costs the root of the length. Blocks whose outside occurs once emit nothing.
    """
    blocks = staged(_blocks(texts), "blocks")
    met = _shared_keys(blocks, ["key"]).groupBy("h1", "h2").agg(F.collect_set(F.struct("base", "j", "key", "key2")).alias("met"))
    rows = texts.join(met, ["h1", "h2"])
    both = F.struct("n", "met", _cut(F.col("line"), _width(F.col("n"))).alias("even"), _cut(F.col("line"), _width(F.col("n") - 1)).alias("odd"))

    def region(x: Column, m: Column) -> Column:
        """The block; for the longer partner with the character that follows."""
        more = F.concat(F.get(x["odd"], m["j"]), F.coalesce(F.substring(F.get(x["odd"], m["j"] + 1), 1, 1), F.lit("")))
        return F.struct(m["base"].alias("base"), (m["j"] * _width(m["base"])).alias("before"), m["key"].alias("key"), m["key2"].alias("key2"), F.when(m["base"] == x["n"], F.get(x["even"], m["j"])).otherwise(more).alias("part"))

    found = F.transform(F.array(both), lambda x: F.transform(x["met"], lambda m: region(x, m)))[0]
    parts = rows.select("h1", "h2", "first", "n", F.explode(found).alias("m")).select("h1", "h2", "first", "n", "m.*")
    equal = F.col("base") == F.col("n")
    rest = F.concat(F.substring(F.col("part"), F.lit(1), F.col("p") - 1), F.substring(F.col("part"), F.col("p") + 1, F.length("part")))
    cut = parts.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("part")))).withColumn("rest", rest)
    place = F.when(equal, F.col("p")).otherwise(F.lit(0))
    cut = cut.select("h1", "h2", "first", F.when(equal, "s").otherwise("d").alias("kind"), (F.col("before") + F.col("p")).alias("at"), *(F.xxhash64(F.col(key), place, F.col("rest")).alias(k) for key, k in (("key", "k1"), ("key2", "k2"))))
    whole = parts.where(equal).select("h1", "h2", "first", F.lit("w").alias("kind"), F.lit(0).alias("at"), *(F.xxhash64(F.col(key), F.lit(0), F.col("part")).alias(k) for key, k in (("key", "k1"), ("key2", "k2"))))
    return cut.unionByName(whole)


def _edited(texts: DataFrame, edits: int) -> DataFrame:
    """Keys (h1, h2, first, k1, k2) of every line, such that two lines share one exactly if they are within ``edits``.

    An edit at a gap of the remaining string either deletes the character after
    the gap or leaves the line as it is there; the partner does either as well.
    The key is the remaining string with the gaps of all ``edits`` edits, in
    ascending order, deletions first.
    """
    rows = texts.select("h1", "h2", "first", F.col("line").alias("v"), F.lit(0).alias("gap"), F.lit(True).alias("cuts"), F.array().cast("array<int>").alias("gaps"))
    for _ in range(edits):
        rows = rows.select("*", F.explode(F.sequence("gap", F.length("v"))).alias("g")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("cut"))
        rows = rows.where(~F.col("cut") | ((F.col("g") < F.length("v")) & (F.col("cuts") | (F.col("g") > F.col("gap")))))
        cut = F.concat(F.substring("v", F.lit(1), F.col("g")), F.substring("v", F.col("g") + 2, F.length("v")))
        rows = rows.select("h1", "h2", "first", F.when(F.col("cut"), cut).otherwise(F.col("v")).alias("v"), F.col("g").alias("gap"), F.col("cut").alias("cuts"), F.concat("gaps", F.array("g")).alias("gaps"))
    return rows.select("h1", "h2", "first", F.xxhash64("v", "gaps").alias("k1"), F.xxhash64(F.lit(17), "v", "gaps").alias("k2"))


def _met_one(texts: DataFrame) -> DataFrame:
    """(h1, h2, best, late_at, early_at): lines, an earlier line within one edit of each, and what to delete in the two."""
    met = staged(_shared_keys(staged(_variants(texts), "variants"), ["k1", "k2"]), "met-variants")
    of = lambda kind: met.where(F.col("kind") == kind)
    least = lambda kind: of(kind).groupBy("k1", "k2").agg(F.min(F.struct("first", F.col("at").alias("early_at"))).alias("m")).select("k1", "k2", F.col("m.first").alias("best"), "m.early_at")
    # The same place deleted on both sides is one substitution; one side whole and the other not, an insertion or deletion.
    pairs = [of(late).join(least(early), ["k1", "k2"]) for late, early in (("s", "s"), ("d", "w"), ("w", "d"))]
    found = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).where("best < first")
    # In a run of one sign many places do; one is enough.
    found = found.groupBy("h1", "h2", "best").agg(F.min(F.struct(F.col("at").alias("late_at"), "early_at")).alias("m"))
    return found.select("h1", "h2", "best", "m.late_at", "m.early_at")


def _without_one(line: Column, at: Column) -> Column:
    return F.when(at == 0, line).otherwise(F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + 1, F.length(line))))


def _met_more(texts: DataFrame, edits: int) -> DataFrame:
    """As ``_met_one``, for any number of edits."""
    met = staged(_shared_keys(staged(_edited(texts, edits), "variants"), ["k1", "k2"]), "met-variants")
    best = met.groupBy("k1", "k2").agg(F.min("first").alias("best"))
    return met.join(best, ["k1", "k2"]).where("best < first").select("h1", "h2", "best")


def _near_lines(found: DataFrame, distinct: DataFrame, candidates: DataFrame, edits: int) -> DataFrame:
    """Distinct lines (h1, h2) within so many edits of an earlier line."""
    chosen = distinct.join(lookup(candidates), "h1", "left_semi")
    first = chosen.select("h1", "h2", F.col("first.doc_id").alias("d"), F.col("first.th").alias("t"), F.col("first.line_no").alias("l"), "first")
    first = staged(first, "candidate-places")
    on = found["doc_id"].eqNullSafe(first["d"]) & (found["th"] == first["t"]) & (found["line_no"] == first["l"])
    texts = found.join(lookup(first), on).select("h1", "h2", "first", "line", F.length("line").alias("n"))
    # A text that is repeated under one id names one place twice.
    texts = staged(texts.dropDuplicates(["h1", "h2"]), "candidate-lines")
    pairs = staged(_met_one(texts) if edits == 1 else _met_more(texts, edits).distinct(), "line-pairs")
    mine = texts.select("h1", "h2", "line")
    other = texts.select(F.col("first").alias("best"), F.col("line").alias("earlier"))
    # For one edit the two are equal without the deleted characters, which is seen in one pass over them.
    if edits == 1:
        near = _without_one(F.col("line"), F.col("late_at")) == _without_one(F.col("earlier"), F.col("early_at"))
    else:
        near = F.levenshtein("line", "earlier", edits) >= 0
    checked = pairs.join(mine, ["h1", "h2"]).join(other, "best").where(near)
    return staged(checked.select("h1", "h2").distinct(), "near-lines")


def _without(parts: Column, gone: Column) -> Column:
    """The lines whose numbers are not in ``gone``, joined again; in time linear in the lines."""
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    # The lines are the field of a lambda's argument, so that they are split once and not for every line.
    both = F.array(F.struct(parts.alias("parts"), left.alias("left")))
    return F.array_join(F.transform(both, lambda x: F.transform(x["left"], lambda i: F.get(x["parts"], i)))[0], "\n")


def _repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rd, rt): id and text hash that several rows share."""
    keys = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("rd"), F.xxhash64(F.col(text_col)).alias("rt"))
    return staged(keys.groupBy("rd", "rt").count().where("count > 1").select("rd", "rt"), "repeated-rows")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns row, gd0, gt0 and again, which is true on all but one of the rows that share id and text."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("gd0"), F.xxhash64(F.col(text_col)).alias("gt0"))
    repeated = _repeated(docs, id_col, text_col)
    if not repeated.limit(1).count():
        return rows.withColumn("again", F.lit(False))
    on = F.col("gd0").eqNullSafe(F.col("rd")) & (F.col("gt0") == F.col("rt"))
    once = rows.join(lookup(repeated), on, "left_anti").withColumn("again", F.lit(False))
    # Written with their numbers, which then stay what they are when a task runs again.
    copies = staged(rows.join(lookup(repeated), on).withColumn("uid", F.monotonically_increasing_id()), "repeated-copies")
    least = copies.groupBy("rd", "rt").agg(F.min("uid").alias("uid")).select(F.col("uid").alias("least"))
    copies = copies.join(lookup(staged(least, "first-copies")), F.col("uid") == F.col("least"), "left")
    return once.unionByName(copies.select("row", "gd0", "gt0", F.col("least").isNull().alias("again")))


def line_dedup(docs: DataFrame, max_edits: int = 1, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with the repeated lines cut out of the text.

    Other columns stay as they are. With ``counts`` there are also n_lines and
    n_removed, in place of columns of those names. A null text stays null with no lines; an
    empty text has one blank line. Of rows that share id and text one is the
    first, and all lines but the blank ones of the others go. Documents are never
    dropped: one whose lines all go has an empty text.
    """
    gone = dropped_lines(docs, max_edits, id_col, text_col).groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gd"), F.col("th").alias("gt"), "gone")
    rows = _numbered(docs, id_col, text_col)
    joined = rows.join(gone, F.col("gd0").eqNullSafe(F.col("gd")) & (F.col("gt0") == F.col("gt")), "left")
    whole = F.col("row")[text_col]
    parts = _split(whole)
    filled = F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("gone", F.when(F.col("again"), filled).otherwise(F.col("gone")))
    text = F.when(F.col("gone").isNull(), whole).otherwise(_without(parts, F.col("gone")))
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if not counts:
        return joined.select(*columns)
    columns = [c for c, name in zip(columns, docs.columns, strict=True) if name not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.coalesce(F.when(whole.isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
