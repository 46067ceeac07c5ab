"""Neighbourhoods in the file graph (J14) and connected parts of any graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes one edge away from the seeds, in both directions."""
    out = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour"), "rel")
    back = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbour"), "rel")
    return out.unionByName(back).join(seeds.select("node_id"), "node_id", "left_semi").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Edges per node and relation; partial counts travel, not edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), "rel")
    return ends.groupBy("node_id", "rel").agg(F.count(F.lit(1)).alias("degree"))


def cotagged(edges: DataFrame, min_shared: int = 1) -> DataFrame:
    """Tag pairs and how many files carry both.

    Pairs are formed inside one file's short tag list, so a tag on a third of all files costs one
    row per file and tag pair, not a pair per two files.
    """
    tags = edges.filter("rel = 'TAGGED'").groupBy("src").agg(
        F.array_sort(F.collect_set("dst")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(
        F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("tag_a"), y.alias("tag_b")))))
    return (tags.select(F.inline(pairs)).groupBy("tag_a", "tag_b")
            .agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared))


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``id, label``: the least label among all connected nodes.

    ``labels`` gives each node a label to start with, ``links`` are ``src, dst``. Each round hangs every label on the
    least label next to it and follows two such steps, so a chain of n nodes takes about log n rounds.
    """
    while True:
        ends = (links.join(labels.toDF("src", "_a"), "src").join(labels.toDF("dst", "_b"), "dst").filter("_a <> _b"))
        hang = cut(ends.groupBy(F.greatest("_a", "_b").alias("label")).agg(F.min(F.least("_a", "_b")).alias("below")),
                   "hang")
        if hang.isEmpty():
            return labels
        further = hang.toDF("below", "_next")
        jump = hang.join(further, "below", "left").select("label", F.coalesce("_next", "below").alias("_to"))
        labels = cut(labels.join(jump, "label", "left").select("id", F.coalesce("_to", "label").alias("label")), "labels")
