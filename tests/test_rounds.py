"""Retrieval in rounds against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import rounds

LINKS = [(f"w{i}", f"w{j}", f"s{(i * j) % 3}", round(((i * 7 + j * 5) % 11) / 10, 2)) for i in range(8) for j in range(8) if (i * 3 + j) % 4 == 0 and i != j]


def search_over(links):
    def search(queries):
        return queries.join(links, F.col("query") == F.col("word")).select("query_id", "text", "source", "score")

    return search


def by_loop(asked, links, max_rounds, min_score):
    found, trace, outcome = {}, [], {}
    for qid, query in asked.items():
        seen, past, number, stopped = {}, set(), 0, None
        while stopped is None:
            if not query or query in past:
                stopped = "no query"
            elif number == max_rounds:
                stopped = "rounds"
            else:
                number += 1
                past.add(query)
                hits = [x for x in links if x[0] == query]
                new = {}
                for _, text, source, score in hits:
                    if score >= min_score and text.strip() and text not in seen:
                        new[text] = min(new.get(text, (9, "")), (-score, source))
                seen |= {t: (number, s, -m) for t, (m, s) in new.items()}
                trace.append((qid, number, query, len(hits), len(new)))
                query = min((m, t) for t, (m, _) in new.items())[1] if new else None
                stopped = None if new else "nothing new"
        found |= {(qid, t): v for t, v in seen.items()}
        outcome[qid] = (number, stopped)
    return found, sorted(trace), outcome


@pytest.mark.parametrize(("max_rounds", "min_score"), [(1, 0.0), (2, 0.3), (9, 0.3), (9, 0.6)])
def test_rounds_equal_a_loop(spark, max_rounds, min_score):
    rng = random.Random(3)
    rows = LINKS + rng.sample(LINKS, 5) + [("w0", " ", "s", 1.0), ("w1", "dead", "s", 1.0)]
    links = spark.createDataFrame(rows, "word string, text string, source string, score double")
    asked = {i: f"w{i}" for i in range(8)} | {8: "unknown", 9: "", 10: "dead"}
    queries = spark.createDataFrame([*asked.items(), (None, "w0"), (3, "w3"), (11, None)], "query_id int, query string")
    evidence, trace, outcome = rounds.searched_in_rounds(queries, search_over(links), lambda q, text, source: text, max_rounds, min_score)
    found, steps, ends = by_loop(asked | {11: ""}, rows, max_rounds, min_score)
    assert {(r.query_id, r.text): (r["round"], r.source, r.score) for r in evidence.collect()} == found
    assert sorted((r.query_id, r["round"], r.query, r.n_found, r.n_new) for r in trace.collect()) == steps
    assert {r.query_id: (r.rounds, r.stopped) for r in outcome.collect()} == ends


def test_no_queries(spark):
    links = spark.createDataFrame([], "word string, text string, source string, score double")
    nothing = spark.createDataFrame([], "query_id int, query string")
    for part in rounds.searched_in_rounds(nothing, search_over(links), lambda q, text, source: text):
        assert part.count() == 0
    with pytest.raises(ValueError):
        rounds.searched_in_rounds(nothing, search_over(links), lambda q, text, source: text, 0)
