"""Connected components of a link table by repeated minimum labels and pointer jumps, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.shared import join_facts, materialise


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): one row (node, label) for each node that has a link; label is the least node of its component.

    A star's centre has very many links and a large component very many nodes, so both joins know how many rows a key has.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels")
    n_links, n_nodes = both.count(), labels.count()
    while True:
        ends = labels.select(F.col("node").alias("b"), F.col("label").alias("l"), "degree")
        near = join_facts(both, ends, "b", "degree", n_links).groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"), "degree")
        step = materialise(step, "label-steps")
        # Jump: a label is itself a node, whose own new label may be lower still.
        sizes = step.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        jump = sizes.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        new = join_facts(step, jump, "label", "size", n_nodes).select("node", F.least("label", "further").alias("label"), "old", "degree")
        new = materialise(new, "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label", "degree")
