"""Helpers that the training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.sources.scratch import written as materialize


#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def id_key(column: Column | str) -> Column:
    """A uniform hex key of a record key; null keys share the key of the empty string."""
    column = F.col(column) if isinstance(column, str) else column
    return F.md5(F.coalesce(column.cast("string"), F.lit("")))


def group_key(column: Column | str) -> Column:
    """A string that is never null and differs for null and every value, so that plain equi-joins serve."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def running_totals(df: DataFrame, group: str, key: str, value: str, order: list[str], before: str, total: str, digits: int = 3) -> DataFrame:
    """Adds `before`, the sum of `value` over a row's predecessors in its group, and `total`, the group's sum.

    Rows are ordered by `key` (uniform hex text), then `order`. The key's first
    `digits` digits cut each group into 16**digits buckets: only the buckets' sums
    meet in a group's window, and rows meet in a bucket's window, so that a group
    holding most of the rows spreads over the cluster. `group` must not hold nulls.
    Rows that share a key share a bucket: add them up before.
    """
    df = df.withColumn("__bucket", F.substring(F.col(key), 1, digits))
    sums = df.groupBy(group, "__bucket").agg(F.sum(value).alias("__sum"))
    by_bucket = Window.partitionBy(group).orderBy("__bucket")
    offsets = sums.select(
        group,
        "__bucket",
        F.coalesce(F.sum("__sum").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
        F.sum("__sum").over(Window.partitionBy(group)).alias(total),
    )
    inside = Window.partitionBy(group, "__bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [group, "__bucket"])
        .withColumn(before, F.col("__offset") + F.col("__inside"))
        .drop("__bucket", "__offset", "__inside")
    )


def digits_for(rows: int, in_bucket: int = 4096) -> int:
    """Hex digits that cut so many rows into buckets of about that size; one at least."""
    return max(1, math.ceil(math.log(max(rows, 1) / in_bucket, 16)))


def join_by_key(rows: DataFrame, few: DataFrame, keys: list[str], cells: Column, salt: Column, most_cells: int = 1_000_000, spread: int = 64) -> DataFrame:
    """rows left join few (one row a key) for keys that may hold a large part of rows.

    few is written and the sum of `cells` over it, its size in values, is looked at: up
    to most_cells it is broadcast; beyond, it is repeated `spread` times and joined on
    the keys and rows' `salt` modulo spread, so that a hot key's rows are dealt out.
    """
    few = materialize(few, "keyed")
    if (few.agg(F.sum(cells)).first()[0] or 0) <= most_cells:
        return rows.join(F.broadcast(few), keys, "left")
    few = few.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(spread)])))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(spread)).cast("int")).join(few, [*keys, "__salt"], "left").drop("__salt")
