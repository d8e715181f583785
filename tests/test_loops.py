"""The queries that have no SQL, against plain loops over the whole smallest tables."""

import hashlib
import re
import unicodedata

from marlstone.functions import cleaning
from marlstone.operators import chunking
from marlstone.plans import registry, search

SPACE = " \t\n\x0b\f\r\u00a0\u3000"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def python(pattern):
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), pattern)


def cleaned(text):
    for pattern in (cleaning.TAG, cleaning.URL, cleaning.EMAIL):
        text = re.sub(pattern, "", text)
    text = unicodedata.normalize("NFKC", text)
    for pattern in (cleaning.CONTROL, cleaning.ZERO_WIDTH):
        text = re.sub(python(pattern), "", text)
    text = re.sub(cleaning.REPEATED, r"\1\1\1", text)
    line = re.compile("(?i)^.{0,20}(%s).{0,20}$" % "|".join(cleaning.BOILERPLATE))
    text = "\n".join(x for x in text.split("\n") if not line.search(x))
    text = re.sub(r"([，。！？；：])[ \t]+", r"\1", re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text)))
    seen, kept = set(), []
    for part in text.split("\n\n"):
        bare = part.strip(SPACE)
        if not bare or bare not in seen:
            kept.append(part)
        seen.add(bare)
    return "\n\n".join(kept).strip(SPACE)


def test_clean_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.queries()["clean_documents"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = cleaned(texts[r.doc_id])
        assert r.cleaned_md5 == md5(want), r.doc_id
        assert r.retention == (round(len(want) / len(texts[r.doc_id]) + 1e-12, 4) if texts[r.doc_id] else 1.0)


def test_chunk_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = registry.queries()["chunk_documents"](spark, sf).collect()
    whole = {(r.doc_id, r.chunk_id): r.text for r in chunking.chunk_documents(docs).collect()}
    assert {(r.doc_id, r.chunk_id): r.text_md5 for r in got} == {k: md5(t) for k, t in whole.items()}
    rows = {}
    for r in got:
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == {i for i, t in texts.items() if t.strip()}
    for i, parts in rows.items():
        parts.sort(key=lambda r: r.chunk_id)
        assert [r.chunk_id for r in parts] == list(range(len(parts))) and {r.chunk_count for r in parts} == {len(parts)}
        ends = [r.chunk_start for r in parts[1:]] + [len(texts[i])]
        for k, (r, end) in enumerate(zip(parts, ends, strict=True)):
            # A chunk is its part of the text behind the last fifty characters of the part before.
            own = texts[i][r.chunk_start : end]
            before = texts[i][parts[k - 1].chunk_start : r.chunk_start][-50:] if k else ""
            assert whole[i, r.chunk_id] == before + own
            assert len(own) <= 550 and (len(own) >= 50 or k == 0)


def test_context_build(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    hits = {}
    for r in search.jaccard_search(spark, sf).collect():
        hits.setdefault(r.query_id, []).append(r)
    want = {}
    for q, rows in hits.items():
        left = 2000
        for r in sorted(rows, key=lambda r: r.rank):
            text = texts[r.key]
            if len(text) <= left:
                used = len(text)
            elif left < 20:
                used = 0
            else:
                ends = [m.end() for m in re.finditer(r"[。！？；!?;.\n]", text[:left])]
                used = ends[-1] if ends else left
            left -= used
            want[q, r.key] = (r.rank, len(text), used, "dropped" if not used else "cut" if used < len(text) else "kept")
    got = registry.queries()["context_build"](spark, sf).collect()
    assert {(r.query_id, r.key): (r.rank, r.n_chars, r.used_chars, r.status) for r in got} == want
    report = {r.query_id: r for r in registry.queries()["context_report"](spark, sf).collect()}
    for q in hits:
        mine = [v for (x, _), v in want.items() if x == q]
        used, whole = sum(v[2] for v in mine), sum(v[1] for v in mine)
        assert (report[q].n_items, report[q].used_chars, report[q].n_cut) == (len(mine), used, sum(v[3] == "cut" for v in mine))
        assert abs(report[q].utilisation - used / 2000) < 1e-4 and abs(report[q].fidelity - used / whole) < 1e-4
