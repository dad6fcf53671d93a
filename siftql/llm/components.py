"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import materialize, release


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``links`` (``a``, ``b``, both long, not null).

    Each round sends every node to its first neighbour in an order (by number in the first two rounds, which settles
    stars around their smallest node; by a fresh hash afterwards, so that a constant share of the nodes is expected to
    go), rewrites the links between what is left and drops loops.  Rounds are written to the shared folder; the driver
    only learns whether links remain.  Aggregation is partial before each shuffle, so a hub does not meet its links in
    one task; joins read tables on both sides, so Spark splits the rows of a label that most nodes have.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    k = 0
    while not edges.isEmpty():
        rank = (lambda c: F.struct(F.col(c).alias("h"), F.col(c).alias("v"))) if k < 2 else (lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v")))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("from"), F.least(rank("a"), F.col("m"))["v"].alias("to"))
        first = materialize(first.where(F.col("from") != F.col("to")), "first")
        new_edges = edges.join(first.select(F.col("from").alias("a"), F.col("to").alias("a2")), "a", "left").join(first.select(F.col("from").alias("b"), F.col("to").alias("b2")), "b", "left")
        new_edges = new_edges.select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y")).where("x <> y")
        new_edges = materialize(new_edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        new_labels = materialize(labels.join(first, labels["label"] == first["from"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for old in (edges, labels, first):
            release(old)
        edges, labels = new_edges, new_labels
        k += 1
    release(edges)
    least = materialize(labels.groupBy("label").agg(F.min("node").alias("component")), "least")
    out = materialize(labels.join(least, "label").select("node", "component"), "components")
    release(labels)
    release(least)
    return out


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that span the same components as ``pairs``."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = top.get(y, y)
            x = y
        return x

    out = []
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out
