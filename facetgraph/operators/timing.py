"""Timing flows: what an owner does in order, as charts and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgraph.functions.text import safe_name

# The kinds of events that are counted.
COUNTED = ("await", "parallel_start", "parallel_join", "wait", "sync", "timer", "callback", "periodic")


def charts(flows: DataFrame, events: DataFrame) -> DataFrame:
    """flows(graph, flow, owner, is_async) that have events(graph, flow, ...), with `name`, the owner as a file name."""
    held = flows.join(events.select("graph", "flow").distinct(), ["graph", "flow"], "left_semi")
    return held.select("graph", "flow", safe_name(F.col("owner"), "timing").alias("name"), "owner", "is_async")


def statistics(flows: DataFrame, events: DataFrame) -> DataFrame:
    """(graph, chart_count, async_flow_count, await_count, ...): the flows with events of each graph, and their events by kind; zeros where a graph has none."""
    by_flow = events.groupBy("graph", "flow").agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in COUNTED])
    rows = flows.select("graph", "flow", "is_async").join(by_flow.withColumn("held", F.lit(True)), ["graph", "flow"], "left")
    sums = [F.coalesce(F.sum(f"{kind}_count"), F.lit(0)).alias(f"{kind}_count") for kind in COUNTED]
    return rows.groupBy("graph").agg(F.count("held").alias("chart_count"), F.count_if(F.col("is_async") & F.col("held")).alias("async_flow_count"), *sums)
