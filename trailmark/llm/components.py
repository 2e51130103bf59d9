"""Connected components of an undirected graph, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, written


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, comp: for every node of edges (columns a, b) the smallest node it is connected with.

    Null ends make no edge; an edge from a node to itself is none either, and without edges there are no rows.

    Each round takes the smallest label among a node's neighbours, then that label's own label, so chains halve. Labels
    are written to the shared folder after each round; nothing is gathered on the driver but whether any label changed.
    """
    both = stored(edges.where("a != b").select("a", "b").union(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    edges_at = written[-1]
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "components-labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        pulled = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        roots = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        old = written[-1]
        now = stored(pulled.join(roots, "comp").select("node", F.col("root").alias("comp"), "was"), "components-labels")
        labels = now.select("node", "comp")
        discard(both.sparkSession, [old])
        if now.where("comp != was").isEmpty():
            discard(both.sparkSession, [edges_at])
            return labels
    raise RuntimeError("components did not settle")
