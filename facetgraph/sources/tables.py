"""The driver's tables as relation graphs: edges(src, dst, ord) and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pair of events that follow each other within a user: src and dst are event types.

    A user's events are cut into days, so that a user with most of the events is spread;
    the last event of a day is linked through the days' first events, one row a day.
    """
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("src"))
    # days that rise with ts in every time zone; keys are never null, so that a plain join serves
    day = F.unix_date(F.to_date("ts")) if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    user = F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit("null"))
    events = events.withColumns({"__user": user, "__day": F.coalesce(day.cast("long"), F.lit(-(2**40)))})
    by_day = Window.partitionBy("__user", "__day").orderBy("ts", "event_id")
    events = events.withColumns({"dst": F.lead("src").over(by_day), "__last": F.lead(F.lit(1)).over(by_day).isNull()})
    first = events.groupBy("__user", "__day").agg(F.min_by("src", F.struct("ts", "event_id")).alias("__first"))
    first = first.withColumn("__next", F.lead("__first").over(Window.partitionBy("__user").orderBy("__day"))).drop("__first")
    linked = events.join(first, ["__user", "__day"], "left").withColumn("dst", F.when(F.col("__last"), F.col("__next")).otherwise(F.col("dst")))
    return linked.where("dst IS NOT NULL").select("user_id", "event_id", "src", "dst")
