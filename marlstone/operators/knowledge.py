"""Knowledge-base life cycle: identities, new and changed documents, removal, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import if_few, rename_if_absent, staged


def doc_key(source: Column, text: Column) -> Column:
    """Identity of a document: 16 digits of the SHA-256 of its source and first 200 characters."""
    return F.substring(F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("|"), F.substring(F.coalesce(text, F.lit("")), 1, 200)), 256), 1, 16)


def content_hash(text: Column) -> Column:
    """Hash of the whole text, which also sees edits beyond the first 200 characters."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order."""
    one = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("row_of_key", F.row_number().over(one)).where("row_of_key = 1").drop("row_of_key")


def titled(rows: DataFrame, title: str, order: list[Column], untitled: str = "drop") -> DataFrame:
    """One row per title, the first in order; rows without a title all go (``drop``) or all stay (``keep``).

    Several sources are united first; they need not have the same columns.
    """
    has = F.trim(F.coalesce(F.col(title), F.lit(""))) != ""
    one = first_of(rows.where(has), [title], order)
    return one if untitled == "drop" else one.unionByName(rows.where(~has))


def united(sources: dict[str, DataFrame], column: str = "source") -> DataFrame:
    """Rows of several sources in one table, with the name of each; missing columns are null."""
    out = None
    for name, rows in sources.items():
        part = rows.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def new_documents(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Incoming rows whose key is not there yet; of equal keys the first."""
    return first_of(incoming.join(existing.select(key), key, "left_anti"), [key], order)


def difference(old: DataFrame, new: DataFrame, key: str = "key", digest: str = "digest") -> DataFrame:
    """(key, change) with change added, removed, edited or unchanged; one shuffle of the two key columns."""
    both = old.select(key, F.col(digest).alias("before")).join(new.select(key, F.col(digest).alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "edited").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def remove(docs: DataFrame, keyword: str | None = None, sources: list[str] | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """Without the rows of the given sources, and without those that hold the keyword in text or source."""
    out = docs
    if sources:
        out = out.where(~F.coalesce(F.col(source).isin(sources), F.lit(False)))
    if keyword:
        out = out.where(~keyword_match(keyword, text, source))
    return out


def keyword_match(keyword: str, text: str = "text", source: str = "source") -> Column:
    word = keyword.lower()
    return F.coalesce(F.contains(F.lower(F.col(text)), F.lit(word)), F.lit(False)) | F.coalesce(F.contains(F.lower(F.col(source)), F.lit(word)), F.lit(False))


def upsert(docs: DataFrame, rows: DataFrame, prefix: Column, key: str) -> DataFrame:
    """Rows replace the documents whose key starts with the prefix of one of them.

    Prefixes are compared by equality, one join for each length that they have,
    so that any number of them is a hash join and not a test of all pairs.
    """
    heads = rows.select(prefix.alias("head")).where("head is not null").distinct()
    kept = docs
    for (n,) in heads.select(F.length("head")).distinct().orderBy(F.length("head")).collect():  # few lengths
        some = heads.where(F.length("head") == n)
        kept = kept.join(some, F.substring(F.col(key), 1, n) == F.col("head"), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def newest(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Retention: the ``n`` first rows in order."""
    return rows.orderBy(*order).limit(n)


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, share): how many rows have the field, neither null nor empty; one pass."""
    counts = rows.agg(F.count("*").alias("n"), *(F.sum((F.col(f).isNotNull() & (F.col(f).cast("string") != "")).cast("long")).alias(f) for f in fields))
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return counts.selectExpr("n", f"stack({len(fields)}, {pairs}) AS (field, present)").select("field", "present", F.round(F.col("present") / F.col("n"), 4).alias("share"))


def save_snapshot(docs: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """Write a version, by default the next, and its manifest row (version, n_docs, checksum), which is what makes it count.

    Rows and manifest are written aside and then moved to names that nothing may
    have yet. So of two writers only one gets a number, and the other takes the
    next one, or fails if it was told its number; a manifest is there whole or not
    at all. A version with a manifest is never written again; what a failed write
    left of one without is replaced if its number is asked for.
    """
    spark = docs.sparkSession
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    docs.write.parquet(f"{draft}/rows")
    written = spark.read.parquet(f"{draft}/rows")
    n, sum_ = written.agg(F.count("*"), checksum(written)).first()
    if version is not None:
        if version in versions(spark, path):
            raise ValueError(f"version {version} is there already")
        _delete(spark, f"{path}/v={version}")
    while not rename_if_absent(spark, f"{draft}/rows", f"{path}/v={(number := next_version(spark, path) if version is None else version)}"):
        if version is not None:
            raise ValueError(f"version {version} is being written")
    spark.createDataFrame([(number, n, sum_)], "version int, n_docs long, checksum long").coalesce(1).write.parquet(f"{draft}/manifest")
    rename_if_absent(spark, f"{draft}/manifest", f"{path}/manifest/v={number}")
    _delete(spark, draft)
    return spark.read.parquet(f"{path}/manifest/v={number}")


def snapshot_info(spark: SparkSession, path: str) -> DataFrame:
    """(version, n_docs, checksum, n_files, bytes, modified, is_current) of every version that counts."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], "version int, n_docs long, checksum long, n_files long, bytes long, modified timestamp, is_current boolean")
    manifests = spark.read.parquet(*(f"{path}/manifest/v={v}" for v in known))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{path}/v={v}" for v in known])
    number = F.regexp_extract("path", r".*/v=(\d+)/", 1).cast("int")
    sizes = files.groupBy(number.alias("version")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    return manifests.join(sizes, "version", "left").select("version", "n_docs", "checksum", "n_files", "bytes", "modified", (F.col("version") == known[-1]).alias("is_current"))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checksum(rows: DataFrame) -> Column:
    """Sum of the hashes of whole rows, each modulo two to the power of 31; it does not depend on their order."""
    return F.sum(F.pmod(F.xxhash64(*sorted(rows.columns)), F.lit(1 << 31)))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions with a manifest, ascending; one folder name each."""
    return _numbers(spark, f"{path}/manifest")


def current_version(spark: SparkSession, path: str) -> int | None:
    known = versions(spark, path)
    return known[-1] if known else None


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the highest number that anybody has taken, with a manifest or without."""
    return max([0, *_numbers(spark, path), *versions(spark, path)]) + 1


def load_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A version, after its checksum was compared; a mismatch is an error."""
    docs = spark.read.parquet(f"{path}/v={version}")
    want = spark.read.parquet(f"{path}/manifest/v={version}").first()
    have = docs.agg(F.count("*").alias("n"), checksum(docs).alias("c")).first()
    if (have["n"], have["c"]) != (want["n_docs"], want["checksum"]):
        raise ValueError(f"snapshot {version} does not match its manifest")
    return docs


def dictionary_use(docs: DataFrame, terms: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """(term, documents, occurrences, hit_rate) of every term of a dictionary (term); missing ones have zero."""
    terms = if_few(staged(terms.select("term").distinct(), "dictionary-terms"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    found = docs.select(key, F.explode(words).alias("term")).join(terms, "term").groupBy("term", key).agg(F.count("*").alias("n"))
    found = found.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = terms.join(found, "term", "left").crossJoin(n_docs)  # one row
    return rows.select("term", zero(F.col("documents")).alias("documents"), zero(F.col("occurrences")).alias("occurrences"), F.round(zero(F.col("documents")) / F.greatest("n_docs", F.lit(1)), 4).alias("hit_rate"))


def merged_dictionary(parts: list[DataFrame], order: str = "part") -> DataFrame:
    """Dictionaries (term, value, kind) in one; a later part wins over an earlier one."""
    out = None
    for i, part in enumerate(parts):
        rows = part.select("term", "value", "kind", F.lit(i).alias(order))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("term", "kind").agg(F.max_by("value", F.struct(order, "value")).alias("value"))


def with_terms(dictionary: DataFrame, added: DataFrame) -> DataFrame:
    """A dictionary (term, value, kind) with words added at run time, which win over those that are there."""
    return merged_dictionary([dictionary, added])


def dictionary_statistics(dictionary: DataFrame) -> DataFrame:
    """(kind, n_terms, n_values) of a dictionary (term, value, kind)."""
    return dictionary.groupBy("kind").agg(F.countDistinct("term").alias("n_terms"), F.countDistinct("value").alias("n_values"))


def synonym_groups(pairs: DataFrame) -> DataFrame:
    """(group_id, members) of a dictionary (term, group_id), members in order: what an export writes."""
    return pairs.groupBy("group_id").agg(F.sort_array(F.collect_set("term")).alias("members"))


def first_members(pairs: DataFrame) -> DataFrame:
    """(term, first): the member that a dictionary (term, group_id, place) names first in a term's group; of several groups the smallest id's."""
    first = pairs.groupBy("group_id").agg(F.min_by("term", F.struct("place", "term")).alias("first"))
    own = pairs.groupBy("term").agg(F.min("group_id").alias("group_id"))
    return own.join(first, "group_id").select("term", "first")


def lineage(edges: DataFrame, start: DataFrame, downstream: bool = False) -> DataFrame:
    """(id, ancestor, depth): everything upstream of the start ids over edges (id, parent), each once, at its least depth.

    With ``downstream`` the third column's name is descendant and edges are
    followed the other way. Pairs are doubled: each round joins the pairs known so
    far to themselves, so the rounds are logarithmic in the depth, and none is cut
    off. Cycles end, as no pair comes nearer; an id is not its own ancestor. Edges
    with a null end are left out. The edges should be those of the sessions that
    are asked about, as all their pairs are made.
    """
    ends = ("parent", "id") if downstream else ("id", "parent")
    pairs = edges.select(F.col(ends[0]).alias("id"), F.col(ends[1]).alias("to")).where("id is not null and to is not null and id <> to").distinct()
    pairs = staged(pairs.withColumn("depth", F.lit(1)), "lineage")
    known = pairs.count()
    while known:
        onward = pairs.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        longer = pairs.join(onward, "to").where("id <> next").select("id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
        pairs = staged(pairs.unionByName(longer).groupBy("id", "to").agg(F.min("depth").alias("depth")), "lineage")
        before, known = known, pairs.count()
        if known == before:
            break
    return pairs.join(start.select("id").distinct(), "id", "left_semi").withColumnRenamed("to", "descendant" if downstream else "ancestor")
