"""Operator 1: mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Documents are ordered by it within their
source, distributed prefix sums of their sizes are taken, and the order is cut at the
source's exact budget; a budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.llm.common import WORD, digits_for, group_key, id_key, join_by_key, materialize, running_totals, table, whole_text, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """`__group`, `source_size`, `target` for each source of sizes(`__group`, `__source`, `size`).

    Sources by code point, null last, take the weights in turn. A target stops at
    max_epochs times its source's size and the excess is reshared by weight: with the
    sources ordered by cap / weight, the first whose level fits under its cap fixes the
    level of all that follow. One row a source takes part in the windows here, which are
    not partitioned: a million sources are about 100 MB in one task.
    """
    sources = sizes.groupBy("__group", "__source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("__source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    sources = sources.withColumn("__weight", F.get(picks, (F.row_number().over(ordered) - 1) % len(weights))).withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
    sources = sources.withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    rising = Window.orderBy("__ratio", F.col("__source").asc_nulls_last())
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))) / (F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(earlier), F.lit(0.0)))
    sources = sources.withColumn("__level", level).withColumn("__at", F.row_number().over(rising))
    fits = F.when(F.col("__level") <= F.col("__ratio"), F.struct("__at", "__level"))
    sources = sources.withColumn("__common", F.min(fits).over(everything)["__level"])
    target = F.least(F.col("__cap"), F.coalesce(F.col("__common") * F.col("__weight"), F.col("__cap")))
    return sources.select("__group", target.alias("target"))


def mix_plan(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2) -> DataFrame:
    """Adds `source_size`, `target`, `epochs` and `rest` to sizes(`__group`, `__source`, `__key`, `__tie`, `size`, `n`).

    n rows alike are one row here. A row takes `epochs` times its words and its part of
    `rest`, words that the first rows by `__key` and `__tie` share; `__before` says how
    many words the rows before it hold.
    """
    sums = sizes.withColumn("__words", F.col("size") * F.col("n"))
    rows = running_totals(sums, "__group", "__key", "__words", ["__tie"], "__before", "source_size", digits_for(sizes.count()))
    rows = rows.join(source_targets(sums.select("__group", "__source", F.col("__words").alias("size")), weights, share, max_epochs), "__group")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    return rows.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix of docs: id_col, `size`, `source_size`, `target`, `taken` (words taken, repeats counted).

    Null text counts 0 words and takes 0; null sources form one source; rows that share
    an id are separate rows, ordered by size; no rows give no rows. Other columns of
    docs play no part. how: weights, share, max_epochs (see source_targets).
    """
    sizes = docs.select(F.col(id_col).alias("__id"), word_count(text_col).alias("size"), F.col(source_col).alias("__source"))
    # rows of one id, source and size are alike: added up here, they are told apart again below
    sizes = materialize(sizes.groupBy("__id", "__source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = sizes.withColumns({"__group": group_key("__source"), "__key": id_key("__id"), "__tie": F.struct("__id", "size")})
    rows = mix_plan(sizes, **how)
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("__before") - F.col("__k") * F.col("size")))
    return rows.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as the mix takes them, with the columns of docs: a row for each epoch, the one at the cut shortened.

    A text at the cut ends after its last taken word. Rows without words are kept once,
    as they cost nothing. Rows of one id are ordered by size, then by a hash of all their
    columns (128 bits); rows alike in everything are interchangeable, and those at a cut
    are added up and dealt anew. Texts stay where they are: each source's epochs and the
    row at its cut travel to the rows, which compare themselves with it.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashes = F.struct(F.xxhash64(*columns).alias("one"), F.xxhash64(F.lit("two"), *columns).alias("two"))
    sizes = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(text_col).alias("size"), hashes.alias("__hash"))
    sizes = materialize(sizes.groupBy("__id", "__source", "size", "__hash").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = sizes.withColumns({"__group": group_key("__source"), "__key": id_key("__id"), "__tie": F.struct("size", "__hash")})
    plan = mix_plan(sizes.drop("__id"), **how)
    # of each source the first row, by key and tie, that is not taken whole once more
    at_cut = F.when(F.col("__before") + F.col("__words") > F.col("rest"), F.struct("__key", "__tie", "n", "size", (F.col("rest") - F.col("__before")).alias("left")))
    cuts = plan.groupBy("__group").agg(F.max("epochs").alias("__epochs"), F.min(at_cut).alias("__cut"))
    cuts = materialize(cuts, "mix-cuts")

    words = F.regexp_count(whole_text("__text"), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*columns).alias("__row"), F.col(text_col).alias("__text"), id_key(id_col).alias("__key"), hashes.alias("__hash"), group_key(source_col).alias("__group"))
    rows = join_by_key(rows, cuts, ["__group"], F.lit(12), F.xxhash64("__hash"))
    # a text's words are counted only where the key alone does not decide
    tie, cut = F.struct(words.alias("size"), F.col("__hash")), F.col("__cut")
    side = F.when(F.col("__key") < cut["__key"], -1).when(F.col("__key") > cut["__key"], 1).when(tie < cut["__tie"], -1).when(tie == cut["__tie"], 0).otherwise(1)
    rows = rows.withColumn("__side", F.coalesce(side, F.lit(1)))
    whole = lambda n: F.array_repeat(F.lit(-1).cast("long"), n.cast("int"))
    part = F.when(cut["left"] % cut["size"] > 0, F.array(cut["left"] % cut["size"])).otherwise(F.array().cast("array<long>"))
    alone = F.when(~F.coalesce(F.col("__text").rlike(WORD), F.lit(False)), whole(F.lit(1))).when(F.col("__side") == 0, F.concat(whole(F.col("__epochs")), part)).otherwise(whole(F.col("__epochs") + (F.col("__side") < 0).cast("int")))
    apart = (F.col("__side") == 0) & (cut["n"] > 1)
    out = rows.where(~apart).select("__row", "__text", F.explode(alone).alias("__words"))
    if not cuts.where("__cut.n > 1").isEmpty():
        alike = rows.where(apart).groupBy("__group", "__hash").agg(*[F.any_value(c).alias(c) for c in ("__row", "__text", "__epochs", "__cut")])
        again = F.concat(whole(F.col("__epochs") * cut["n"] + F.floor(cut["left"] / cut["size"])), part)
        out = out.union(alike.select("__row", "__text", F.explode(again)))
    shorter = F.col("__words") >= 0
    shown = F.array_join(F.slice(F.regexp_extract_all("__text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), "")
    out = out.withColumn("__shown", F.when(shorter, shown).otherwise(F.col("__text")))
    names = {text_col: F.col("__shown")}
    if "n_chars" in docs.columns:
        # a count of characters that describes the text follows it
        names["n_chars"] = F.when(shorter, F.length("__shown").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return out.select(*[names.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM src
), leveled AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM capped
), shared AS (SELECT arg_min(lvl, pos) AS lvl FROM leveled WHERE lvl <= ratio),
targets AS (
  SELECT l.source, l.source_size, least(l.cap, coalesce(c.lvl * l.weight, l.cap)) AS target FROM leveled l CROSS JOIN shared c
), rows_ AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM rows_
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM cut
"""
