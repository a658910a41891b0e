"""Resolution of names against known names, as equi-joins.

References keep all their columns. A null reference resolves to null. Known names that
occur twice are ambiguous by their simple name, unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgraph.functions.names import simple_name


def _unique_by(known: DataFrame, keys: list[str], target: str) -> DataFrame:
    return known.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("name").alias(target)).where("__n = 1").drop("__n")


def callables(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs(raw, owner, ...) with `target`: the known name equal to raw; else, for self.x or
    cls.x, owner.x if known; else, for a raw name without dots, the only known name whose
    simple name it is; else raw. known(name)."""
    names = known.select("name").where("name IS NOT NULL")
    once = names.distinct()
    member = F.regexp_extract("raw", r"^(?:self|cls)\.(.+)$", 1)
    refs = refs.withColumn("__owned", F.when((member != "") & (F.col("owner") != ""), F.concat("owner", F.lit("."), member)))
    exact = once.select(F.col("name").alias("raw"), F.lit(True).alias("__exact"))
    owned = once.select(F.col("name").alias("__owned"), F.lit(True).alias("__is_owned"))
    unique = _unique_by(names.withColumn("raw", simple_name(F.col("name"))), ["raw"], "__unique")
    out = refs.join(exact, "raw", "left").join(owned, "__owned", "left").join(unique, "raw", "left")
    target = F.when(F.col("__exact"), F.col("raw")).when(F.col("__is_owned"), F.col("__owned")).when(~F.contains("raw", F.lit(".")), F.coalesce("__unique", "raw")).otherwise(F.col("raw"))
    return out.withColumn("target", target).drop("__exact", "__owned", "__is_owned", "__unique")


def longest_prefix(refs: DataFrame, known: DataFrame, separator: str = ".") -> DataFrame:
    """refs(ref, ...) with `target`: the longest known name that is ref or a proper prefix of its parts, else null.

    Distinct references meet the known names, once a prefix; references that repeat cost
    one join of their own.
    """
    parts = F.split("ref", F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    prefixes = refs.select("ref").where("ref IS NOT NULL").distinct().select("ref", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))).alias("name"))
    found = prefixes.join(known.select("name").distinct(), "name", "left_semi").groupBy("ref").agg(F.max_by("name", F.length("name")).alias("target"))
    return refs.join(found, "ref", "left")


def classes(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs(ref, ...) with `target`: ref if known; else, from its longest dotted prefix to its first
    part, the prefix if known, or the only known name with the prefix's last part as simple
    name; else null."""
    names = known.select("name").where("name IS NOT NULL").distinct()
    parts = F.split("ref", "\\.")
    ends = refs.select("ref").where("ref IS NOT NULL").distinct().select("ref", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("end"))
    candidates = ends.select("ref", "end", F.array_join(F.slice("p", 1, F.col("end")), ".").alias("prefix"), F.element_at("p", F.col("end")).alias("part"))
    simple = _unique_by(names.withColumn("part", simple_name(F.col("name"))), ["part"], "by_part")
    found = candidates.join(names.select(F.col("name").alias("prefix"), F.lit(True).alias("exact")), "prefix", "left").join(simple, "part", "left")
    found = found.withColumn("t", F.when(F.col("exact"), F.col("prefix")).otherwise(F.col("by_part"))).where("t IS NOT NULL")
    return refs.join(found.groupBy("ref").agg(F.max_by("t", "end").alias("target")), "ref", "left")


def called_by(calls: DataFrame) -> DataFrame:
    """(name, callers): the distinct callers of each target of calls(caller, target), sorted."""
    return calls.where("target IS NOT NULL").groupBy(F.col("target").alias("name")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def containing(selectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(selector, workload): workloads whose labels hold all of a selector's pairs; selectors(selector, item), labels(workload, item).

    Relational division: pairs meet by equality and are counted. A selector without items
    selects nothing.
    """
    wanted = selectors.where("item IS NOT NULL").distinct()
    sizes = wanted.groupBy("selector").agg(F.count("*").alias("size"))
    met = wanted.join(labels.where("item IS NOT NULL").distinct(), "item").groupBy("selector", "workload").agg(F.count("*").alias("met"))
    return met.join(sizes, "selector").where("met = size").select("selector", "workload")


def strongest(rows: DataFrame, keys: list[str], rank: str, order: str) -> DataFrame:
    """The row of the highest rank for each key; of equal ranks, the first by `order` (an ascending number)."""
    row = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(rank), -F.col(order))).alias("r")).select(*keys, "r.*")
