"""Each operator against brute force on small data, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import io
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import bpe, components, decontamination, exact_dedup, line_dedup, quality, queries, sharding, simhash, substring_dedup, url_filter, warc

from ..oracle import assert_same

#: Names that the operators use inside.
CLASHING = "fp long, h long, th long, bytes string, row string, gone string, kept string, seed long, depth int, word string"
EXTRA = (1, 2, 3, "x", "y", "z", "k", 4, 5, "w")


def table(spark, rows):
    """Documents (doc_id, text) with columns of clashing names."""
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], "doc_id long, text string, " + CLASHING)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, None), (None, base[0]), (None, "alone"), (30, base[1]), (30, base[1]), (31, "É " * 3000 + base[2])]
    rows += [(40 + k, base[3][:200] + " extra%d " % k + base[3][200:]) for k in range(5)]
    rows += [(60, "naïve text with\x85odd\x1cspaces " * 3), (61, "a" * 20000)]
    return rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_empty_tables(spark, sf):
    docs = table(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for empty in (
        warc.archive_and_read(spark, pages),
        quality.classify(docs, labels),
        line_dedup.line_dedup(docs),
        exact_dedup.exact_dedup(docs),
        sharding.assign_shards(docs, 10),
        substring_dedup.substring_dedup(docs),
        simhash.simhash_components(docs),
        bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN),
        url_filter.filter_urls(pages, queries.URL_RULES),
        decontamination.report(docs, items),
    ):
        assert empty.count() == 0
    full = spark.read.parquet(f"{sf}/documents.parquet")
    assert decontamination.decontaminate(full, items).count() == full.count()
    assert quality.classify(full, labels).where("kept").count() == full.count()


# 1. WARC


def test_warc_round_trip(spark):
    long = "x" * 150
    rows = [(3, "http://a/ b\r\nEvil: 1", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (7, "u", "é" * 60), (8, "u", "é" * 60), (1, "again", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_path(spark, "test-warc")
    manifest = warc.write_warc(pages, folder, limit=600)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_warc(manifest, folder, with_payload=True).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    for r in got:
        text = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(text), hashlib.sha256(text).hexdigest())
        assert r.payload == (b"" if r.record_type == "revisit" else text)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(1, "response", None): 2, (3, "revisit", 1): 1, (None, "revisit", 1): 1, (2, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (7, "response", None): 1, (8, "revisit", 7): 1})
    assert next(r.url for r in got if r.page_id == 3) == "http://a/%20b%0D%0AEvil:%201"


def test_warc_reader_frames_and_verifies():
    data = warc.encode_record(1, "u", b"p" * 3_000_000, hashlib.sha256(b"p" * 3_000_000).hexdigest(), None, False, "2024")
    two = data + warc.encode_record(2, "u", b"", hashlib.sha256(b"").hexdigest(), None, False, "2024")
    assert [r["payload_bytes"] for r in warc.iterate_records(io.BytesIO(two))] == [3_000_000, 0]
    wrong = warc.encode_record(1, "u", b"body", "00", None, False, "2024")
    assert not next(warc.iterate_records(io.BytesIO(wrong)))["digest_ok"]
    for broken in (data[:-20], two[: len(data) + 40]):
        with pytest.raises(ValueError):
            list(warc.iterate_records(io.BytesIO(broken)))


# 2. Quality


def test_kth_largest_is_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1e6), 5.0, rng.random()]) for _ in range(400)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 200, 399, 400):
        assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_quality_separates_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify(docs, train).join(test, "doc_id").toPandas()
    assert got[(got.quality == 1) & (got.toxic == 0)].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.2


def test_quality_weights_match_brute_force(spark, awkward):
    docs = table(spark, awkward)
    weights = quality.fit(docs, spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int"), buckets=64)
    got = quality.score(docs, weights).collect()
    by_id = {r.doc_id: r for r in got}
    text = dict(awkward)[0].split()
    hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in text]
    pairs = [int(quality.mixed(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
    assert by_id[0].n_grams == len(text) * 2 - 1
    assert abs(by_id[0].log_weight - quality.REFERENCE * np.mean([weights[h % 64] for h in hashes + pairs])) < 1e-6
    assert by_id[20].log_weight == 0 and by_id[21].n_grams == 0
    assert len(got) == len(awkward)


# 3. Lines


def edits(a, b):
    """The edit distance of two lines."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near(a, b, most):
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= most or len(a) < 200 and edits(a, b) <= most


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_line_dedup_matches_brute_force(spark, most):
    rng = random.Random(3 + most)
    lines = ["".join(rng.choice("abé ") for _ in range(n)) + "x" for n in (0, 1, 2, 3, 9, 19, 20, 21, 25, 25, 40, 60, 5, 5)] + ["a" * 30, "a" * 31, "ab" * 12, "ba" * 12, "a", "b", "ab", "é", ".", "12."]
    for line in lines[:11]:
        for _ in range(3):
            i = rng.randrange(len(line))
            lines += [line[:i] + "Z" + line[i:], line[:i] + line[i + 1 :], line[:i] + "Q" + line[i + 1 :]]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(6))) for d in range(25)]
    rows += [(50, None), (51, ""), (52, "\n \n"), (None, lines[0] + "\nnew line of the null id"), (7, rows[7][1]), (7, rows[7][1]), (8, rows[7][1])]
    rows += [(60, "c" * 5000), (61, "c" * 5001)] if most < 2 else []
    rows += [(None, "null id, twice\n\n" + lines[3])] * 2
    got = line_dedup.line_dedup(table(spark, rows), max_edits=most)
    assert got.columns == table(spark, []).columns + ["n_lines", "n_removed"]
    hashes = {t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] for t in {t for _, t in rows}}
    copies = Counter()
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    seen, want = [], Counter((i, t, 0, 0) for i, t in rows if t is None)
    for i, t in order:
        parts, left = t.split("\n"), []
        for line in parts:
            blank = not line.strip(" \t\n\x0b\x0c\r")
            if blank or not any(s == line or near(s, line, most) for s in seen):
                left.append(line)
            if not blank:
                seen.append(line)
        copies[i, t] += 1
        want[i, "\n".join(left), len(parts), len(parts) - len(left)] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want


def test_line_dedup_of_very_many_lines(spark):
    rng = random.Random(8)
    text = "\n".join("line %d of the long text" % rng.randrange(10**9) if k % 2 else "the line that repeats" for k in range(200_000))
    start = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, text), (2, "alone"), (3, None)], "doc_id long, text string")).collect()}
    assert time.time() - start < 60
    assert got[1].n_lines == 200_000 and 99_999 <= got[1].n_removed < 101_000
    assert got[1].text.split("\n")[0] == "the line that repeats" and got[1].text.count("\n") == 199_999 - got[1].n_removed


@pytest.mark.parametrize("name", ["op3_line_dedup", "op5_sharding", "op10_decontamination"])
def test_marked_operators_are_native(spark, sf, name, monkeypatch):
    """Neither the returned plan nor any table written on the way has a Python node."""
    plans = []
    for module in (line_dedup, sharding, decontamination):
        real = module.staged

        def seen(df, label, real=real):
            plans.append(df._jdf.queryExecution().toString())
            return real(df, label)

        monkeypatch.setattr(module, "staged", seen)
    plans.append(queries.queries()[name](spark, sf)._jdf.queryExecution().toString())
    assert len(plans) > 2 and not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas"))


def test_sharding_query_splits(spark, sf):
    depths = {r.depth for r in queries.op5_sharding(spark, sf).select("depth").distinct().collect()}
    assert len(depths) > 1


# 4. Exact


@pytest.mark.parametrize("keep,budget", [("largest", 1 << 28), ("smallest", 2000)])
def test_exact_dedup_matches_brute_force(spark, awkward, keep, budget):
    got = exact_dedup.exact_dedup(table(spark, awkward), keep=keep, budget=budget).collect()
    groups = {}
    for i, t in awkward:
        groups.setdefault(t or "", []).append(i)
    choose = {"largest": max, "smallest": min}[keep]
    want = []
    for i, t in awkward:
        ids = [x for x in groups[t or ""] if x is not None]
        best = choose(ids) if ids else None
        want.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_trie_spills_subtrees():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(40))).encode() for _ in range(500)] + [b"", b"z" * 500]
    trie = exact_dedup.Trie(min, budget=3000)
    for i, t in enumerate(texts):
        trie.add(t, i, 1)
    assert trie.spilled
    want = {t: (texts.index(t), n) for t, n in Counter(texts).items()}
    assert {t: (i, n) for t, i, n in trie.items()} == want


# 5. Shards


@pytest.mark.parametrize("limit,step", [(300, 2), (2000, 12), (10**9, 12), (1, 7)])
def test_shards_match_brute_force(spark, awkward, limit, step):
    got = sharding.assign_shards(table(spark, awkward), limit, step=step).collect()
    rows = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t in awkward]

    def bucket(h):
        for d in range(61):
            inside = [(x, n) for x, n in rows if x >> (60 - d) == h >> (60 - d)]
            if sum(n for _, n in inside) <= limit or d == 60:
                return d, sum(n for _, n in inside), len(inside), "s" + (format(h >> (60 - d), f"0{d}b") if d else "")

    want = Counter((i, len((t or "").encode()), *bucket(h)) for (i, t), (h, _) in zip(awkward, rows))
    assert Counter((r.doc_id, r.n_bytes, r.depth, r.shard_bytes, r.shard_rows, r.shard) for r in got) == want


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 10, "own") for i in range(40)], "doc_id long, text string, doc_of_shard string")
    shards = sharding.write_shards(docs, str(tmp_path / "s"), 100)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.sum(F.length("text")).alias("b")).where("b > 100").count() == 0
    assert shards.count() == spark.read.parquet(str(tmp_path / "s")).count() == 40


# 6. Substrings


@pytest.mark.parametrize("length,anchor", [(35, 8), (5, 8), (10, 3)])
def test_substring_dedup_matches_brute_force(spark, awkward, length, anchor):
    rows = awkward + [(70, "r " * 100), (71, "q r s " * 30)]
    got = substring_dedup.substring_dedup(table(spark, rows), length, anchor=anchor, with_text=True).collect()
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in words for k in range(len(w) - length + 1))
    want = []
    for i, w in words:
        covered = {k + j for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for j in range(length)}
        text = b" ".join(x for k, x in enumerate(w) if k not in covered)
        want.append((i, len(w), len(covered), hashlib.sha256(text).hexdigest(), text.decode()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# 7. SimHash


def fingerprint(text, n=4):
    fold = {c: c + 32 for c in range(65, 91)}
    words = (text or "").translate(fold).encode().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit,groups", [(simhash.CELL_POINTS, None), (2, 5), (30, 8)])
def test_simhash_matches_brute_force(spark, awkward, limit, groups):
    rng = random.Random(4)
    base = dict(awkward)[5].split()
    rows = list(awkward)
    for k in range(60):
        words = list(base) * 3
        words[rng.randrange(len(words))] = f"v{k}"
        rows.append((100 + k, " ".join(words)))
    got = simhash.simhash_components(table(spark, rows), limit=limit, groups=groups).collect()
    marks = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(marks):
        least.setdefault(find(k), []).append(i)
    want = []
    for k, (i, f) in enumerate(marks):
        ids = [x for x in least[find(k)] if x is not None]
        want.append((i, f"{f:016x}", min(ids) if ids else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 500), dtype=np.uint64)
    b = np.concatenate([b[:250], a[250:] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))])
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * s)) & np.uint64(3)).astype(int) for s in range(32)], axis=1)
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=1)
    assert (manhattan == np.bitwise_count(simhash.unary(a) ^ simhash.unary(b))).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_representatives_keep_columns(spark, awkward):
    docs = table(spark, awkward)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sum(r.doc_id in (20, 21, 22, 23) for r in kept.collect()) == 1


# 8. Tokens


def test_bpe_matches_whole_text_encoding(spark, awkward):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder, _ = bpe._coder(ranks, public_tokenizers.PATTERN)
    rows = awkward + [(80, "  a\t\tb  \n\n c's 12ab!?  "), (81, "<|endoftext|> 　 x\x85 y\x1c z")]
    for size in (1, 7, 1 << 16):
        got = bpe.encode_documents(table(spark, rows), ranks, public_tokenizers.PATTERN, size=size)
        texts = Counter((i, tuple(coder.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        assert Counter((r.doc_id, tuple(r.token_ids), r.decoded_sha256) for r in got.collect()) == texts
    back = bpe.decode_documents(got, ranks, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in rows)


# 9. URLs


def test_aliases_spread_blocks_and_allow_wins(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    rows = [
        (1, "http://x.net/a#frag", link("http://bad.com/de/1")),
        (2, "http://y.net/b", '<META http-equiv=refresh content="0; url=http://X.net/a">'),
        (3, "http://y.org/b", link("http://bad.com/de/1")),
        (4, "http://z.net/c", "<p>"),
        (5, None, link("http://bad.com/de/1")),
        (6, "no scheme", None),
        (7, "http://moved.net/", None),
        (8, "HTTP://Sub.Example.ORG/en/12?q", None),
        (4, "http://z.net/c", "<p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://moved.net/", "http://y.net/b"), (None, "x")], "a string, b string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, queries.URL_RULES, redirects).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block"}
    assert got[3].rule == "org/" and got[8].rule == "example.org/en/1" and got[8].host == "sub.example.org"
    assert (got[5].host, got[5].path, got[6].host) == ("", "", "")


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(200, 260)] + [(300, 300), (None, 5), (301, 302), (302, 301)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, classes.values())) == sorted([list(range(61)), [100, *range(200, 260)], [301, 302]])
    assert len(got) == 61 + 61 + 2


# 10. Decontamination


def contaminated(text, item):
    """Lay the item over the text at every offset, also over its ends: row d of ``same`` is the one that starts at word d - m."""
    words = {}
    w, v = (np.array([words.setdefault(x, len(words)) for x in (t or "").lower().encode().split()], np.int64) for t in (text, item))
    m = len(v)
    if not m:
        return False
    width = min(decontamination.WINDOW, m)
    none = np.full(m, -1)
    same = np.lib.stride_tricks.sliding_window_view(np.concatenate([none, w, none]), m) == v
    return any((same[:, s : s + width].sum(axis=1) >= -(-width * 4 // 5)).any() for s in range(m - width + 1))


def test_decontamination_matches_brute_force(spark, awkward):
    rng = random.Random(6)
    words = ["t%d" % i for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((40, 25, 15, 11, 9, 3, 1))] + [(90, None), (91, ""), (None, "q r s")]
    rows = list(awkward)
    for k, (_, item) in enumerate(items[:7] * 6):
        copy = item.split()
        for _ in range(k // 7):
            copy[rng.randrange(len(copy))] = "other"
        rows.append((200 + k, " ".join(["before"] * rng.randrange(3) + copy + ["after"] * rng.randrange(3))))
    rows.append((250, "before " + " ".join(items[0][1].split()[5:30]).upper() + " q r s"))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(table(spark, rows), frame).collect()
    want = Counter()
    per_id = {}
    for i, t in rows:
        per_id.setdefault(i, set()).update(k for k, item in items if k is not None and contaminated(t, item))
    for i, _ in rows:
        want[i, bool(per_id[i]), tuple(sorted(per_id[i]))] += 1
    assert Counter((r.doc_id, r.contaminated, tuple(r.item_ids)) for r in got) == want
    clean = decontamination.decontaminate(table(spark, rows), frame)
    assert clean.columns == table(spark, []).columns and clean.count() == sum(n for (_, bad, _), n in want.items() if not bad)
