"""Connected components of link tables, by least-label passing with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from .common import scratch, written


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node in ``links``
    (columns a, b). Each round a node takes the least label among its own and
    its neighbours', then its label's label; the labels are written to the
    shared folder each round; the edges of a hub and the nodes of a large component
    are dealt over several tasks. An empty table of links has no nodes."""
    with scratch(links.sparkSession):
        return _passed(links)


def _passed(links: DataFrame) -> DataFrame:
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    ends = written(both.groupBy("b").agg(F.count("*").alias("n")), "ends")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = join_unique(both, labels.withColumnRenamed("node", "b"), ["b"], counts=ends).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        step = written(step, "step")
        top = step.select(F.col("node").alias("next"), F.col("next").alias("top"))
        jumped = join_unique(step, top, ["next"], "left").select("node", F.least("next", F.coalesce("top", "next")).alias("label"), (F.least("next", F.coalesce("top", "next")) != F.col("label")).alias("moved"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return written(labels, "components", keep=True)
