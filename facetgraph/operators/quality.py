"""Design metrics and findings of relation graphs: nodes(graph, node) and edges(graph, src, dst)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgraph.operators.partition import partition, partition_statistics
from facetgraph.operators.traverse import all_nodes, simple_cycles, simple_edges, strong_components
from facetgraph.sources.scratch import written

# Metric names in order; for each code its severity, interpretation and note. %s stands for the scope.
METRICS = (
    "node_count",
    "edge_count",
    "strongly_connected_component_count",
    "largest_scc_size",
    "cycle_count",
    "series_count",
    "max_nodes_per_series",
    "avg_nodes_per_series",
    "max_partition_depth",
    "shared_node_count",
    "shared_node_ratio",
    "cross_series_edge_count",
    "cross_series_edge_ratio",
)
FINDINGS = {
    "high-fan-in": ("info", "複数箇所から利用される依存hubです。", "logging、設定、event bus、dependency injection、共通error処理などは高fan-inでも妥当な場合があります。"),
    "high-fan-out": ("warning", "多くのnodeを調整または依存しており、責務が集中している可能性があります。", "大きな調整処理が意図的な場合もありますが、責務の集中を確認してください。"),
    "cycle": ("warning", "%sに依存cycleがあります。", "再帰処理が意図的な場合もあります。依存cycleの影響範囲を確認してください。"),
    "strongly-connected-component": ("warning", "%sに単純な非循環層へ分けられない相互依存領域があります。", "小さなSCCは意図的な再帰の場合があります。大きなSCCは変更影響が相互に伝わるため、設計上の境界を確認してください。"),
    "large-series": ("warning", "再帰分割後も大きな連結seriesが残っています。", "大きなまとまりが妥当な場合もあります。意図したarchitecture境界と比較してください。"),
    "shared-dependency-hubs": ("info", "複数の関係がfan-inの高い共有nodeへ集約しています。", "これらのhubが意図した基盤か、偶発的な結合かを確認してください。"),
    "cross-series-coupling": ("warning", "依存の多くがdiagram seriesの境界を越えており、結合が高く局所性が弱い可能性があります。", "共有調整処理が複数seriesを結ぶ場合もあります。module/component境界と比較してください。"),
}
CALL_NODES, CLASS_NODES, CALL_GRAPH, CLASS_GRAPH = "関数・メソッド", "class", "呼び出しgraph", "class graph"


@dataclass(frozen=True)
class Thresholds:
    high_fan_in: int = 3
    high_fan_out: int = 5
    large_series: int = 8
    high_cross_series_ratio: float = 0.25

    def __post_init__(self) -> None:
        if min(self.high_fan_in, self.high_fan_out, self.large_series) < 1:
            raise ValueError("integer thresholds must be at least 1")
        if not 0 <= self.high_cross_series_ratio <= 1:
            raise ValueError("the cross-series ratio must be within 0 and 1")


def fan_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, fan_in, fan_out): distinct callers and callees, 0 for isolated nodes; a self edge counts in both."""
    links = simple_edges(edges)
    ends = links.select("graph", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("graph", "e.*")
    alone = all_nodes(nodes, edges).select("graph", "node", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return ends.union(alone).groupBy("graph", "node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def high_fan_in(nodes: DataFrame, edges: DataFrame, threshold: int = 3) -> DataFrame:
    """(graph, node, fan_in) of the nodes with threshold distinct callers or more."""
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    return fan_counts(nodes, edges).where(F.col("fan_in") >= threshold).select("graph", "node", "fan_in")


def cyclic_components(parts: DataFrame) -> DataFrame:
    """(graph, members): the sorted members of each component of strong_components() that is cyclic."""
    return parts.where("cyclic").groupBy("graph", "component").agg(F.sort_array(F.collect_list("node")).alias("members")).select("graph", "members")


def kept(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph that several operators read, written once."""
    return written(nodes.select("graph", "node"), "nodes"), written(edges.select("graph", "src", "dst"), "edges")


def design_metrics(nodes: DataFrame, edges: DataFrame, scope: str, high_fan_in: int = 3) -> DataFrame:
    """(graph, scope, metric, value): the thirteen metrics of each graph, as doubles."""
    nodes, edges = kept(nodes, edges)
    stats = partition_statistics(partition(nodes, edges, high_fan_in), edges)
    parts = strong_components(nodes, edges)
    rings = cyclic_components(parts).groupBy("graph").agg(F.count("*").alias("strongly_connected_component_count"), F.max(F.size("members")).alias("largest_scc_size"))
    cycles = simple_cycles(nodes, edges).groupBy("graph").agg(F.count("*").alias("cycle_count"))
    rows = stats.alias("s")
    for other in (rings, cycles):
        rows = rows.join(other.withColumnRenamed("graph", "__graph"), F.col("graph").eqNullSafe(F.col("__graph")), "left").drop("__graph")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("double").alias("value")) for m in METRICS])
    return rows.select("graph", F.lit(scope).alias("scope"), F.explode(values).alias("m")).select("graph", "scope", "m.*")


def _finding(code: str, subject: Column, evidence: Column, scope: str = "", kind: str | None = None) -> list[Column]:
    severity, interpretation, note = FINDINGS[kind or code]
    return [F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.alias("subject"), evidence.alias("evidence"), F.lit(interpretation.replace("%s", scope)).alias("interpretation"), F.lit(note).alias("note")]


def hub_findings(nodes: DataFrame, edges: DataFrame, scope: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """(graph, code, severity, subject, evidence, interpretation, note) for nodes at or beyond a threshold."""
    counts = fan_counts(nodes, edges)
    text = lambda c: F.concat(F.lit(f"{scope}の{c.replace('_', '-')} = "), F.col(c).cast("string"))
    one = counts.where(F.col("fan_in") >= limits.high_fan_in).select("graph", *_finding("high-fan-in", F.col("node"), text("fan_in")))
    two = counts.where(F.col("fan_out") >= limits.high_fan_out).select("graph", *_finding("high-fan-out", F.col("node"), text("fan_out")))
    return one.union(two)


def cycle_findings(cycles: DataFrame, code: str, scope: str) -> DataFrame:
    """A finding for each of cycles(graph, cycle), which are closed arrays."""
    edges = F.greatest(F.size("cycle") - 1, F.lit(1)).cast("string")
    return cycles.select("graph", *_finding(code, F.array_join("cycle", " -> "), F.concat(edges, F.lit("本のedgeを持つcycleを検出しました。")), scope, "cycle"))


def component_findings(parts: DataFrame, scope: str) -> DataFrame:
    """A finding for each cyclic component of strong_components()."""
    evidence = F.concat(F.lit("相互到達するnode数 = "), F.size("members").cast("string"))
    return cyclic_components(parts).select("graph", *_finding("strongly-connected-component", F.array_join("members", ", "), evidence, scope))


def partition_findings(stats: DataFrame, scope: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """Findings on the series of graphs, from partition_statistics()."""
    text = lambda c: F.col(c).cast("string")
    percent = lambda c: F.format_string("%.1f%%", 100 * F.col(c))
    large = stats.where(F.col("max_nodes_per_series") >= limits.large_series).select("graph", *_finding("large-series", F.lit(scope), F.concat(F.lit("最大partitionのnode数 = "), text("max_nodes_per_series"))))
    shared = F.concat(F.lit("shared node = "), text("shared_node_count"), F.lit("; regular series = "), text("series_count"), F.lit("; shared比率 = "), percent("shared_node_ratio"))
    hubs = stats.where("shared_node_count > 0 AND series_count > 0").select("graph", *_finding("shared-dependency-hubs", F.lit(scope), shared))
    cross = F.concat(F.lit("series境界edge = "), text("cross_series_edge_count"), F.lit("; 比率 = "), percent("cross_series_edge_ratio"))
    coupling = stats.where((F.col("cross_series_edge_count") > 0) & (F.col("cross_series_edge_ratio") >= limits.high_cross_series_ratio)).select("graph", *_finding("cross-series-coupling", F.lit(scope), cross))
    return large.union(hubs).union(coupling)


def design_findings(calls: tuple[DataFrame, DataFrame], classes: tuple[DataFrame, DataFrame], limits: Thresholds = Thresholds()) -> DataFrame:
    """(graph, section, code, ...): all findings on a call graph and a class graph, each as nodes and edges; section is their order."""
    calls, classes = kept(*calls), kept(*classes)
    made = [hub_findings(*calls, CALL_NODES, limits), hub_findings(*classes, CLASS_NODES, limits)]
    for (nodes, edges), code, scope in ((calls, "call-cycle", CALL_GRAPH), (classes, "class-cycle", CLASS_GRAPH)):
        made.append(cycle_findings(simple_cycles(nodes, edges), code, scope))
    for (nodes, edges), scope in ((calls, CALL_GRAPH), (classes, CLASS_GRAPH)):
        made.append(component_findings(strong_components(nodes, edges), scope))
    for (nodes, edges), scope in ((calls, CALL_GRAPH), (classes, CLASS_GRAPH)):
        made.append(partition_findings(partition_statistics(partition(nodes, edges, limits.high_fan_in), edges), scope, limits))
    out = None
    for section, df in enumerate(made):
        df = df.select("graph", F.lit(section).alias("section"), "code", "severity", "subject", "evidence", "interpretation", "note")
        out = df if out is None else out.union(df)
    return out
