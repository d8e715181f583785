"""Every window that agrees in four fifths of its tokens is found, whatever the places."""

import random
from itertools import combinations
from math import ceil

import pytest

from marlstone.llm import decontamination


@pytest.mark.parametrize("width", range(1, decontamination.WINDOW + 1))
def test_masks_find_every_window(width):
    short = [width] if width < decontamination.SPAN else []
    masks = [(n, m) for n, m, only in decontamination._masks(short) if only == (width if short else 0)]
    placed = [{s + o for o in m} for n, m in masks for s in range(width - n + 1)]
    for changed in combinations(range(width), width - ceil(0.8 * width)):
        assert any(not p & set(changed) for p in placed)


def overlaps(text, item):
    """All windows of the item at all places, without seeds; places outside the text disagree."""
    w, v = text.split(), item.split()
    width = min(decontamination.WINDOW, len(v))
    for d in range(-len(v), len(w) + 1):
        same = [0 <= d + i < len(w) and w[d + i] == v[i] for i in range(len(v))]
        if any(10 * sum(same[s : s + width]) >= 8 * width for s in range(len(v) - width + 1)):
            return True
    return False


@pytest.mark.parametrize("most,hot", [(decontamination.BROADCAST_HASHES, 64), (10, 64), (10, 0), (decontamination.BROADCAST_HASHES, 0)])
def test_pairs_match_all_windows_without_seeds(spark, monkeypatch, most, hot):
    monkeypatch.setattr(decontamination, "HOT", hot)
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (*range(1, 23), 40)]
    rows = []
    for n, item in items:
        for _ in range(12):
            copy = item.split()
            for at in rng.sample(range(n), min(n, rng.choice((n // 5, n // 5, n // 5 + 1, 0)))):
                copy[at] = "other"
            cut = rng.choice((0, 0, 1, 2))
            copy = copy[cut:] if rng.random() < 0.5 else copy[: len(copy) - cut]
            rows.append((len(rows), " ".join(["before"] * rng.choice((0, 3)) + copy + ["after"] * rng.choice((0, 3)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    want = {(i, n) for i, t in rows for n, item in items if overlaps(t, item)}
    assert sorted(map(tuple, got)) == sorted(want)


def template_items(n, rng):
    """Items that share a beginning of 30, a middle of 12 and an end of 17 tokens."""
    head, middle, tail = ([f"{k}{i}" for i in range(m)] for k, m in (("h", 30), ("m", 12), ("t", 17)))
    own = lambda m: [f"o{rng.randrange(10**6)}" for _ in range(m)]
    return head, middle, tail, [" ".join(head + own(9) + middle + own(8) + tail) if i % 3 else " ".join(head[:14] + own(6)) for i in range(n)]


@pytest.mark.parametrize("most", [decontamination.BROADCAST_HASHES, 10])
def test_templates_match_all_windows_without_seeds(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "HOT", 8)
    rng = random.Random(4)
    head, middle, tail, items = template_items(45, rng)
    rows = []
    for k in range(90):
        base = rng.choice([head, middle, tail, head[:16], head[3:21], tail[:15], rng.choice(items).split(), rng.choice(items).split()[6:34]])
        copy = list(base)
        for at in rng.sample(range(len(copy)), min(len(copy), rng.choice([0, 0, 1, 2, 3, 4, 6]))):
            copy[at] = "other"
        rows.append((k, " ".join(["before"] * rng.randrange(3) + copy + rng.choice([[], ["after"], rng.choice(items).split()[-9:]]))))
    rows += [(200, None), (200, " ".join(head)), (None, " ".join(head)), (200, " ".join(head))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.contaminated(docs, bench, most=most).collect()
    want = {(i, n) for i, t in rows for n, item in enumerate(items) if overlaps(t or "", item)}
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    left = decontamination.decontaminate(docs, bench, most=most).collect()
    bad = {i for i, _ in want}
    assert sorted(map(tuple, left), key=repr) == sorted((r for r in rows if r[0] not in bad), key=repr)


def test_many_items_of_one_template(spark):
    """Documents that hold the template of 1,500 items do not meet item by item."""
    rng = random.Random(5)
    head, _, _, items = template_items(1500, rng)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
    rows = [(k, f"{text} {' '.join(head)} {k} {text}" if k % 2 else text) for k in range(1000)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    pairs, hot = decontamination._matches(docs, bench, "doc_id", "text", "item_id", "text", decontamination.BROADCAST_HASHES)
    assert hot is not None and pairs.count() == 0
    assert hot[0].select("doc_id").distinct().count() == 500 and hot[0].count() < 500 * 500
    assert decontamination.decontaminate(docs, bench).count() == 500
