"""Operator 8: weighted rendezvous hashing, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.llm.common import id_key, materialize, running_totals, table, whole_text


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard in 0 .. len(weights) - 1 whose draw -ln(u) / weight is least; u comes from md5(key:shard).

    A shard's draw depends on the key and the shard alone, so a shard that is added
    takes rows only into itself, and one that is dropped sheds only its own.
    """

    def draw(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))

    return F.least(*[draw(s, w) for s, w in enumerate(weights)])["shard"]


def shard_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 24, added_weight: float = 1.0, digits: int = 3) -> DataFrame:
    """id_col, `size`, `text_crc32`, `law` ('key'), `shard`, `slot`, `grown_shard` (with one more shard) for each row.

    The id and the shard weights alone decide the shard; null ids share one. Null text
    counts no bytes. Slots number a shard's rows from 0 by hashed id, then id, size and
    checksum, through distributed prefix sums. Repeated ids go to one shard and have slots of
    their own. Extra columns are ignored; no rows give no rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("__name"))
    rows = materialize(rows.select("*", rendezvous_shard(F.col("__name"), weights).alias("shard"), rendezvous_shard(F.col("__name"), [*weights, added_weight]).alias("grown_shard"), F.lit(1).alias("__one")), "shards")
    rows = running_totals(rows.withColumn("__key", id_key("__id")), "shard", "__key", "__one", ["__id", "size", "text_crc32"], "slot", "__total", digits)
    return rows.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op8_shard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH tbl AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents
), sized AS (
  SELECT doc_id, k, strlen(text) + 8 AS size,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM base CROSS JOIN tbl
), draws AS (
  SELECT doc_id, k, size, text_crc32,
         list_transform(range(25), lambda s: {'draw': -ln((CAST('0x' || substr(md5(k || ':' || CAST(s AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE), 'shard': s}) AS d
  FROM sized
), put AS (
  SELECT doc_id, k, size, text_crc32, list_min(d[1:24]).shard AS shard, list_min(d).shard AS grown_shard FROM draws
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM put
"""
