"""Operators on relation graphs edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def fan_in_out(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct callers and callees of each endpoint; a self edge counts in both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("out"), F.lit(None).cast("string").alias("in")), F.struct(F.col("dst").alias("node"), F.lit(None).cast("string").alias("out"), F.col("src").alias("in")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.countDistinct("in").alias("fan_in"), F.countDistinct("out").alias("fan_out"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no edge's end."""
    return nodes.join(nodes_of(edges), "node", "left_anti")


def first_label(edges: DataFrame, label: str, order: str) -> DataFrame:
    """(src, dst, label): the label of each pair's first edge."""
    return edges.groupBy("src", "dst").agg(F.min_by(label, order).alias(label))


def validated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and refused rows of what is given as nodes(graph, node) and edges(graph, src, dst, kind, pos).

    Both ends of accepted edges are nodes, too; an edge without a kind is direct. Refused,
    as (graph, row, pos, reason), are nodes without a name (pos null) and edges without an
    end, each as often as given; the rest goes on.
    """
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # one pass over the edges marks them, accepted and refused ones are told apart after it
    reason = F.when(lacks("src") & lacks("dst"), "no caller and no callee").when(lacks("src"), "no caller").when(lacks("dst"), "no callee")
    marked = edges.withColumn("reason", reason)
    kept = marked.where("reason IS NULL").select("graph", "src", "dst", F.coalesce(F.nullif("kind", F.lit("")), F.lit("direct")).alias("kind"), "pos")
    named = nodes.where(~lacks("node")).select("graph", "node").union(kept.select("graph", F.explode(F.array("src", "dst")))).distinct()
    refused = nodes.where(lacks("node")).select("graph", F.lit("node").alias("row"), F.lit(None).cast("long").alias("pos"), F.lit("no name").alias("reason"))
    return named, kept, refused.union(marked.where("reason IS NOT NULL").select("graph", F.lit("edge"), F.col("pos").cast("long"), "reason"))
