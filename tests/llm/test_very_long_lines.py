"""Near copies of very long lines, against edit distance."""

import random
import time

import pytest

from marlstone.llm import line_dedup


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def kept(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id for r in line_dedup.line_dedup(docs).where("n_removed = 0").collect()}


def edited(rng, text):
    at, sign = rng.randrange(max(1, len(text))), rng.choice("xyzß日")
    return rng.choice([text[:at] + text[at + 1 :], text[:at] + sign + text[at:], text[:at] + sign + text[at + 1 :]])


@pytest.mark.parametrize("seed", range(3))
def test_edits_at_every_place(spark, seed):
    rng = random.Random(seed)
    lines = []
    for size in (1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 24, 25, 26, 50, 101):
        base = "".join(rng.choice("ab" if seed == 1 else "abcdefgh😀") for _ in range(size))
        lines += [base, base + "q", "q" + base, base[:-1] or "k", base[1:] or "l"]
        lines += [edited(rng, base) for _ in range(6)] + [edited(rng, edited(rng, base)) for _ in range(4)]
    lines = [x for x in lines if x.strip()]
    rng.shuffle(lines)
    want = {i for i, x in enumerate(lines) if not any(x == y or distance_one(x, y) for y in lines[:i])}
    assert kept(spark, lines) == want


def test_edits_at_the_ends_of_blocks(spark):
    lines = []
    for size in (15, 16, 17, 20):
        base = "".join(chr(0x100 + size * 40 + k) for k in range(size))
        lines.append(base)
        for at in range(size + 1):
            lines += [base[:at] + "x" + base[at:]] + ([base[:at] + "y" + base[at + 1 :], base[:at] + base[at + 1 :]] if at < size else [])
    # Each within one edit of the first of its size.
    assert len(kept(spark, lines)) == 4


def test_a_million_characters(spark):
    rng = random.Random(7)
    base = "".join(rng.choices("abcdefghij klmnop", k=1_000_000))
    at = 654_321
    lines = [base, base[:at] + "Z" + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + "Z" + base[at:], base[:at] + "ZZ" + base[at + 2 :], base[::-1]]
    start = time.time()
    assert kept(spark, lines) == {0, 5} | ({4} if not any(distance_one(lines[4], x) for x in lines[:4]) else set())
    assert time.time() - start < 90


def test_long_runs_of_one_character(spark):
    start = time.time()
    assert kept(spark, ["a" * 80_000, "a" * 80_001, "a" * 80_003, "a" * 40_000 + "b" + "a" * 39_999]) == {0, 2}
    assert time.time() - start < 60
