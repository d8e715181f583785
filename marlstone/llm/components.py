"""Connected components by randomised contraction.

Each round every vertex picks, from itself and its neighbours, the vertex whose
per-round hash is smallest, and the edges are rewritten to those picks. A round
leaves at most about three quarters of the vertices in expectation, so the
number of rounds is logarithmic whatever the diameter (Boegeholz, Brand and
Todor, "In-database connected component analysis", ICDE 2020). Minimum per vertex is a
partial aggregate, so a vertex with very many edges is combined before it is
shuffled, and every step reads written tables, so skewed joins can be split.
Nothing is collected: the driver sees only whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, root) for every vertex of ``edges``.

    ``root`` is the same for two vertices exactly if a path joins them. Edges
    are undirected; repeated edges and self-loops are allowed, and an edge with
    a null end is dropped (its other end keeps its place if other edges name
    it). An empty edge table gives an empty result.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    links = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    used = [links]
    while links.limit(1).count():
        turn = len(maps)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
        picks = staged(
            both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("to")),
            "picks",
        )
        maps.append(picks)
        left = picks.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = picks.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = links.join(left, "a").join(right, "b").where("a2 <> b2")
        links = staged(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        used.append(links)
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root"))
    total = maps[-1]
    for step in reversed(maps[:-1]):
        later = total.select(F.col("node").alias("to"), F.col("to").alias("root"))
        total = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    out = staged(total.select("node", F.col("to").alias("root")), "components")
    discard(*used, *maps)
    return out
