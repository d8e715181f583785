"""Collocations, fingerprints and chunked resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import collocations, fingerprints, phrase_queries, queries, resampling
from marlstone.llm.fingerprints import Digest
from marlstone.llm.words import cut_words

CLASHING = "key string, part int, n long, words string, k1 long, own string, text_ string, kind int, rank int, score string, th long"
EXTRA = ("k", 1, 2, "w", 3, "o", "t", 4, 5, "s", 6)


def frame(spark, rows):
    """Documents (doc_id, text, lang) with columns of names that the operators use inside."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], "doc_id long, text string, lang string, " + CLASHING)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["the"] * 40 + [f"w{i}" for i in range(30)] + ["É", "naïve", "a\x01b", "x\x85y", "a%0Ab", "日本"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ". ", "\n", "\t", " ;"]) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    langs = ["en", "de", None, "und", "x%0Ay", "x\ny", ""]
    out = [(i, t, langs[i % len(langs)]) for i, t in enumerate(texts)]
    out += [(100, None, "en"), (101, "", None), (102, " \t\n.,;", "de"), (None, texts[0], "en"), (None, texts[1], "en"), (3, texts[3], "en"), (3, texts[3], "en")]
    out += [(200, "The The the " * 4000, "en"), (201, "y" * 30000 + " z", "de"), (202, " ".join(f"u{i}" for i in range(9000)), "en")]
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 11. Collocations


def counted(rows, max_n):
    found, sizes = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    found[lang][tuple(words[i : i + n])] += 1
    return found, sizes


def plain_collocations(rows, max_n, least, inside, top):
    found, sizes = counted(rows, max_n)
    out = set()
    for lang, f in found.items():
        kept = []
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, sizes[lang], -score))
    return out


@pytest.mark.parametrize("max_n,least,top,frequent", [(3, 10, 2000, 20_000), (3, 2, 7, 3), (4, 3, 2000, 50), (2, 1, 2000, 20_000), (1, 1, 5, 10)])
def test_collocations_match_loop(spark, rows, max_n, least, top, frequent):
    got = collocations.collocations(frame(spark, rows), max_n, least, 50, top, frequent=frequent)
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, max_n, least, 50, top)


def test_phrase_counts_match_loop_when_first_words_are_spread(spark, rows):
    docs = frame(spark, rows)
    words = collocations.survey(docs)
    spread = collocations._spread(words, 4, 20_000)
    assert ("en", b"the") in spread and spread["en", b"the"] > 1
    got = {(r["lang"], r["phrase"]): (r["size"], r["f"]) for r in collocations.phrase_counts(docs, 3, 1).collect()}
    found, _ = counted(rows, 3)
    assert got == {(lang, " ".join(p)): (len(p), a) for lang, f in found.items() for p, a in f.items()}


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 4_000_000_000_000, 7_000_000_000_000, 9_999_999_999_999
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, size int, f long")
    assert collocations._scored(counts, 2).first()["score"] == 1_000_000 * a * a // (left * right)


def test_stack_goes_on_over_batches():
    keys = sorted((f"en\n{a}\n{b}\n" for a in "xyz" for b in "pqr"), reverse=True)
    for size in (1, 2, 4, 9):
        stack = collocations._Stack(2, 1)
        for i in range(0, 9, size):
            part = keys[i : i + size]
            stack.add(pa.array(part), np.full(len(part), 2), np.zeros(len(part), bool))
        stack.close()
        got = {p: int(n) for ps, ns, _ in stack.popped() for p, n in zip(ps.to_pylist(), ns)}
        assert got == {f"en\n{a}": 6 for a in "xyz"} | {f"en\n{a}\n{b}": 2 for a in "xyz" for b in "pqr"}


def test_blocks_and_parts_own_every_position_once(monkeypatch, rows):
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "PART_BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array([(r[1] or "").encode() for r in rows], pa.binary())], ["lang", "text"])
    got = Counter()
    for block in collocations._blocks(iter([batch]), 3):
        (_, *words), counts = block.combined()
        for *ids, n in zip(*words, counts):
            got[tuple(block.names[i].decode() for i in ids if i)] += int(n)
    want = Counter()
    for _, text, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            found = re.findall(r"[^\x20\x09]+", piece)
            want.update(tuple(found[i : i + 3]) for i in range(len(found)))
    assert got == want


# 12. Fingerprints


def plain_digest(data):
    counts = [0] * fingerprints.BUCKETS
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[(a + 256 * b + 65536 * c) * fingerprints.TRIPLET_MIX % 2**32 >> 23] += 1
    order = sorted(counts)
    marks = [order[len(order) * k // 4 - 1] for k in (1, 2, 3)]
    return [sum(n > m for m in marks) for n in counts]


def test_digests_match_loop(rows):
    for _, text, _ in rows:
        data = (text or "").encode()
        digest = Digest.of(data)
        assert digest.codes.tolist() == plain_digest(data)
        assert str(Digest.parse(str(digest))) == str(digest)
        assert digest.likeness(digest) == 1


def test_digest_of_a_long_text_goes_over_blocks(monkeypatch):
    data = " ".join(f"word{i * 7919 % 1000}" for i in range(3000)).encode()
    whole = Digest.of(data)
    monkeypatch.setattr(fingerprints, "_BLOCK", 100)
    assert str(Digest.of(data)) == str(whole)


def test_edit_report_matches_loop(spark, rows):
    docs = [r for r in rows if r[0] is not None]
    docs = list({r[0]: r for r in docs}.values())
    got = {r["doc_id"]: r for r in fingerprints.edit_report(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    order = sorted(docs)
    for (doc_id, text, _), (_, after, _) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, digest, following = Digest.of(text.encode()), Digest.of(changed.encode()), Digest.of(after.encode())
        row = got[doc_id]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (str(own), str(digest))
        assert (row["near_edited"], row["near_next"]) == (own.likeness(digest), own.likeness(following))


def test_edit_report_keeps_null_and_repeated_ids(spark, rows):
    assert fingerprints.edit_report(frame(spark, rows)).count() == len(rows)
    single = fingerprints.edit_report(frame(spark, [(1, "abcdef", "en")])).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and single["near_next"] == 1
    plain = fingerprints.fingerprint(frame(spark, rows)).collect()
    assert sorted(r["fingerprint"] for r in plain) == sorted(str(Digest.of((t or "").encode())) for _, t, _ in rows)


def test_edited_texts_are_nearer_than_their_neighbours(spark, sf):
    got = phrase_queries.op12_fingerprints(spark, sf).select("near_edited", "near_next").collect()
    assert sum(a > b for a, b in got) > 0.95 * len(got)
    assert all(0 <= x <= 1 for row in got for x in row)


# 13. Resampling by chunks


def plain_resample(rows, target, percent, min_words, max_n, buckets, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    raw, aim = Counter(), Counter()
    for _, text, *_ in rows:
        raw.update(features(text)[1])
    for _, text in target:
        aim.update(features(text)[1])
    s_all, t_all = sum(raw.values()) + buckets, sum(aim.values()) + buckets
    gain = [math.floor(1000 * math.log((aim[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in rows:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(enough[: percent * len(enough) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("max_n,percent,long_bytes", [(2, 25, 1 << 18), (2, 100, 50), (3, 60, 50), (1, 30, 0)])
def test_resample_matches_loop(spark, rows, max_n, percent, long_bytes):
    target = [(1, "w1 w2 the The naïve"), (2, None), (3, "w5 " * 200)]
    items = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(frame(spark, rows), items, percent, 5, max_n, 300, 7, long_bytes)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    want = plain_resample(rows, target, percent, 5, max_n, 300, 7)
    # Rows of equal id and score may change places.
    tied = lambda table: (sorted((r[:4] for r in table), key=repr), {r[4]: (r[0], r[3]) for r in table if r[4]})
    assert tied(got) == tied(want)


@pytest.mark.parametrize("size,carry", [(1, 1), (5, 2), (17, 3), (10**6, 1)])
def test_chunks_own_each_run_once(size, carry):
    text = b"  aa b ccc dddd  e f gg hhhhhhhhhhhhhhhhhh i j "
    words = text.split()
    runs = []
    for own, more in cut_words(text, size, carry):
        kept, seen = own.split(), (own + b" " + more).split()
        runs += [tuple(seen[i : i + carry + 1]) for i in range(len(kept))]
    assert runs == [tuple(words[i : i + carry + 1]) for i in range(len(words))]


def test_empty_tables(spark):
    docs, items = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert collocations.collocations(docs).count() == 0
    assert fingerprints.edit_report(docs).count() == 0
    assert resampling.resample(docs, items).count() == 0
    some = [(1, "a b", "en"), (2, None, "en")]
    assert resampling.resample(frame(spark, some), items, 50, 0).where("rank is not null").count() == 1


def test_registered():
    assert {"op11_collocations", "op12_fingerprints", "op13_resampling"} <= set(queries.queries()) & set(queries.oracle_sql())
