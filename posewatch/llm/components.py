"""Connected components of links, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewatch import session


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of `edges` (a, b): rows (node, comp).

    Every step takes the least label of a node and its neighbours and then the label of
    that label, so long chains shrink by halves. It ends with the first step that changes
    nothing; each step is written below the shared folder and read back.
    """
    both = session.materialise(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links"
    )
    labels = session.materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("comp")
        ),
        "labels",
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        least = (
            labels.join(near, F.col("node") == F.col("a"))
            .select("node", "comp", F.least("comp", "near").alias("next"))
        )
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("beyond"))
        step = session.materialise(
            least.join(jump, F.col("next") == F.col("to"), "left").select(
                "node", F.least("next", F.coalesce("beyond", "next")).alias("comp"),
                (F.coalesce("beyond", "next") < F.col("comp")).alias("moved"),
            ),
            "labels",
        )
        labels = step.select("node", "comp")
        if step.where("moved").isEmpty():
            return labels
