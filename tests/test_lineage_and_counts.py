"""Lineage both ways against a loop, first members of synonym groups, counts taken while pools are written."""

import random
from collections import deque

import pytest

from marlstone.operators import ingest, knowledge


def reached(edges, start):
    """(id, other, depth) by breadth-first search."""
    nexts = {}
    for a, b in edges:
        nexts.setdefault(a, set()).add(b)
    out = set()
    for s in start:
        seen, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in nexts.get(x, ()):
                if y is not None and y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
        out |= {(s, y, d) for y, d in seen.items() if d}
    return out


@pytest.mark.parametrize("kind", ["chain", "random", "cycle"])
def test_lineage_matches_a_search(spark, kind):
    rng = random.Random(1)
    edges = {"chain": [(i, i - 1) for i in range(1, 90)], "random": [(rng.randrange(40), rng.randrange(40)) for _ in range(70)], "cycle": [(i, (i + 1) % 45) for i in range(45)] + [(3, 3), (7, 20)]}[kind] + [(5, None), (None, 6)]
    start = [1, 30, 44, 1000]
    table, ids = spark.createDataFrame(edges, "id int, parent int"), spark.createDataFrame([(i,) for i in start + [1]], "id int")
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    up = knowledge.lineage(table, ids)
    assert up.columns == ["id", "ancestor", "depth"] and sorted(map(tuple, up.collect())) == sorted(reached(real, start))
    down = knowledge.lineage(table, ids, downstream=True)
    assert down.columns == ["id", "descendant", "depth"] and sorted(map(tuple, down.collect())) == sorted(reached([(b, a) for a, b in real], start))
    assert knowledge.lineage(table.limit(0), ids).count() == 0


def test_synonyms_lead_to_the_first_member(spark):
    pairs = spark.createDataFrame([("b", 1, 0), ("a", 1, 1), ("c", 2, 5), ("a", 2, 0), ("d", 3, 1)], "term string, group_id int, place int")
    assert {tuple(r) for r in knowledge.first_members(pairs).collect()} == {("b", "b"), ("a", "b"), ("c", "a"), ("d", "d")}


def test_counts_are_taken_in_the_pass_that_writes(spark, tmp_path):
    good = "公司净利润增长" * 20
    rows = [(1, good), (2, None), (3, ""), (4, "短"), (5, "nothing of the kind " * 20), (6, "<p>" + "x" * 400 + "</p>"), (7, good + "<a href='" + "y" * 2000 + "'>"), (8, "<b></b>" * 30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    rules = ingest.Rules(words=["净利润"], kinds={"report": ["净利润"]}, pools={"report": "reports"})
    got = ingest.ingest_to_pools(docs, rules, str(tmp_path / "pools"))
    judged = ingest.ingest(docs, rules).select("doc_id", "reject_reason", "text").collect()
    reasons = [r["reject_reason"] for r in judged]
    assert got["rows"] == 8 and got["accepted"] == reasons.count(None) == 2
    assert {r: got[r] for r in ingest.REASONS} == {r: reasons.count(r) for r in ingest.REASONS}
    before = {i: len(t or "") for i, t in rows}
    shares = {r["doc_id"]: len(r["text"] or "") / before[r["doc_id"]] for r in judged if before[r["doc_id"]]}
    assert got["emptied"] == sum(x == 0 for x in shares.values()) and got["over_cleaned"] == sum(0 < x < 0.3 for x in shares.values()) >= 1
    assert got["retention"] == round(sum(shares.values()) / len(shares), 4)
    stored = spark.read.parquet(str(tmp_path / "pools"))
    assert sorted(r["doc_id"] for r in stored.collect()) == [1, 7] and "chars_before" not in stored.columns
