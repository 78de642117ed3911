"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the undirected `edges` (a, b); the root is the smallest node.

    Labels spread to neighbours and then jump to their label's label, so the number of rounds
    grows with the logarithm of a component's diameter. Every round is a stored table; the
    driver sees only whether anything changed.

    Defined results: repeated edges and both directions of one count once; a node linked to
    itself is its own root; edges with a null end link nothing; other columns are not looked
    at; no edges give no rows.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        spread = labels.join(near, "node").select(
            "node", F.col("root").alias("before"), F.least("root", "near").alias("root")
        )
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        after = stored(
            spread.join(jump, "root", "left").select(
                "node", "before", F.least("root", F.coalesce("beyond", "root")).alias("root")
            ),
            "labels",
        )
        labels = after.select("node", "root")
        if after.where("root != before").isEmpty():
            return labels
