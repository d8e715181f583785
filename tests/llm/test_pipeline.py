"""The pipeline against loops over plain Python values, stage by stage, and awkward rows through all of it."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, quality, queries
from marlstone.llm.scratch import staged

from .test_operators import contaminated, near

BLANK = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def n_grams(text):
    words = [xxhash.xxh3_64_intdigest(w) for w in (text or "").translate(FOLD).encode().split()]
    pairs = [int(quality.mixed(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(words, words[1:])]
    return [x % quality.BUCKETS for x in words + pairs]


def kept_by_classifier(spark, rows, labels):
    """Ids that stay; ``labels`` are (doc_id, quality, toxic)."""
    grams = {i: n_grams(t) for i, t in rows}
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    good = {i for i, q, toxic in labels if q == 1 and not toxic}
    for i, found in grams.items():
        for b in found:
            raw[b] += 1
            target[b] += i in good
    share = (raw + 1) / (raw.sum() + quality.BUCKETS)
    table = np.log((0.9 * target / target.sum() + 0.1 * share) / share)
    noise = {r.i: r.g for r in spark.createDataFrame([(i,) for i in grams], "i long").select("i", quality.gumbel(F.col("i"), 7).alias("g")).collect()}
    keys = {i: sum(table[b] for b in found) / max(1, len(found) / 20) + noise[i] for i, found in grams.items()}
    part = sum(q == 1 for _, q, _ in labels) / len(labels) + queries.QUALITY_MARGIN
    return set(sorted(keys, key=keys.get, reverse=True)[: math.ceil(len(keys) * part)])


def without_repeated_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows):
        left = []
        for line in text.split("\n"):
            blank = not line.strip(BLANK)
            if blank or not any(line == s or near(line, s, 1) for s in seen):
                left.append(line)
            if not blank:
                seen.append(line)
        out[i] = "\n".join(left)
    return out


def shingle_set(text):
    words = text.translate(FOLD).encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_of_classes(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i for i in sets if find(i) == i}


def each_match(text):
    coder, _ = bpe._coder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in coder._encode_single_piece(m[0])]


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}

    first = staged(corpus_pipeline.classify(spark, docs, sf), "first")
    kept = kept_by_classifier(spark, texts.items(), labels)
    assert first.columns == docs.columns and {r.doc_id: r.text for r in first.collect()} == {i: texts[i] for i in kept}

    second = staged(corpus_pipeline.clean_lines(spark, first, sf), "second")
    texts = without_repeated_lines([(i, texts[i]) for i in kept])
    assert second.columns == docs.columns and {r.doc_id: r.text for r in second.collect()} == texts
    assert second.where(F.col("n_chars") != F.length("text")).count() == 0

    third = staged(corpus_pipeline.drop_near_copies(spark, second, sf), "third")
    left = first_of_classes(texts)
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == left

    fourth = staged(corpus_pipeline.drop_leaks(spark, third, sf), "fourth")
    clean = {i for i in left if not any(contaminated(texts[i], item) for item in items)}
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == clean

    last = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(last) == clean and all(r.decoded_ok for r in last.values())
    assert all(list(last[i].token_ids) == each_match(texts[i]) for i in clean)


CLASH = {c: c for c in ("fp", "row", "gone", "node", "keys", "seed", "bad_id", "gone_id", "log_weight", "again")}


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder with awkward documents, labels and benchmark items."""
    at = str(tmp_path_factory.mktemp("awkward"))
    base = " ".join(f"word{k}" for k in range(120))
    leak = " ".join(f"leak{k}" for k in range(30))
    rows = [(1, base), (1, base), (2, base + " more"), (3, None), (4, ""), (5, " \n\t"), (None, "of no id " * 30), (None, None), (6, f"{base[::-1]} {leak}"), (7, " " * 1_200_000 + "x"), (8, "\n".join(f"line number {k} " * 3 for k in range(20_000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 6)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak), (None, base), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_awkward_rows_pass_all_stages(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, awkward), "awkward")
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        docs = after
    ids = [r.doc_id for r in docs.collect()]
    # All labels are good, so the classifier keeps all. The second copy of row 1 loses its lines and
    # then is one of the texts without words, which are equal. Rows that share an id, null too, stay together.
    assert n == 11 and 6 not in ids and 2 not in ids and 1 in ids and 7 in ids and 8 in ids
    assert ids.count(1) == 2 and ids.count(None) == 2 and not {3, 4, 5} & set(ids)
    last = corpus_pipeline.encode(spark, docs, awkward).collect()
    assert sorted((r.doc_id for r in last), key=repr) == sorted(ids, key=repr) and all(r.decoded_ok for r in last)
    whole = corpus_pipeline.run(spark, awkward).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole if r.doc_id) == sorted((r.doc_id, r.ids_sha256) for r in last if r.doc_id)


def test_empty_table_passes_all_stages(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, awkward), "empty")
        assert docs.count() == 0


def test_ids_hash_is_of_the_ids(spark):
    out = corpus_pipeline.encode(spark, spark.createDataFrame([(1, "One text.")], "doc_id long, text string"), "").first()
    assert hashlib.sha256(" ".join(map(str, out.token_ids)).encode()).hexdigest() == out.ids_sha256
