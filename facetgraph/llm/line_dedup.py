"""Operator 7: line dedup by site-relative frequency, with DataFrame operations only.

A line of a host is boilerplate if it stands on more than `ratio` of the host's pages
and on `least_pages` of them at least. A page is a distinct text of the host: copies of
one text count once, so that a page which was crawled often keeps its lines.
With a language column, a line that passes both bounds among the host's pages in a
document's language goes from that document too: a menu in a language of few pages
never reaches the share of the whole host.

As a page counts a line once, a host has at most (lines a page / ratio) such lines.
Those few travel to the documents; texts are never taken apart across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.llm.common import WORD, group_key, join_by_key, materialize, table, whole_text

RATIO, LEAST_PAGES = 0.1, 5


def _in_language(host: Column, lang: Column) -> Column:
    """The key of a host's pages in a language, from two group keys; unlike every host's own key."""
    return F.concat(F.lit("@"), F.length(lang).cast("string"), lang, host)


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, lang_col: str | None = None) -> DataFrame:
    """(__host, __lines): the hashes of each host's boilerplate lines, for hosts that have any; with lang_col, of each host and language too.

    Lines are compared by a 64-bit hash; lines without a word never count. Counts are
    added up by (host, line) on the map side first, so a hot host is spread by its lines.
    """
    text = whole_text(text_col)
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)))
    lang = [group_key(lang_col).alias("__lang")] if lang_col else []
    pages = docs.select(group_key(host_col).alias("__host"), F.xxhash64(text, F.length(text)).alias("__page"), lines.alias("__own"), *lang)
    langs = [F.collect_set("__lang").alias("__langs")] if lang_col else []
    pages = materialize(pages.groupBy("__host", "__page").agg(F.any_value("__own").alias("__own"), *langs), "line-pages")
    if lang_col:
        sites = F.concat(F.array("__host"), F.transform("__langs", lambda x: _in_language(F.col("__host"), x)))
        pages = pages.select(F.explode(sites).alias("__host"), "__own")
    totals = pages.groupBy("__host").agg(F.count("*").alias("__pages"))
    counts = pages.select("__host", F.explode("__own").alias("__line")).groupBy("__host", "__line").agg(F.count("*").alias("__on"))
    common = counts.where(F.col("__on") >= least_pages).join(totals, "__host").where(F.col("__on") > F.lit(float(ratio)) * F.col("__pages"))
    return common.groupBy("__host").agg(F.collect_set("__line").alias("__lines"))


def _split_lines(docs: DataFrame, text_col: str, host_col: str, ratio: float, least_pages: int, lang_col: str | None = None) -> DataFrame:
    """Adds __all and __rest, a text's lines and those that stay."""
    bad = boilerplate_lines(docs, text_col, host_col, ratio, least_pages, lang_col)
    rows = docs.withColumn("__host", group_key(host_col))
    if lang_col:
        bad = materialize(bad, "line-sites")
        rows = rows.withColumn("__lang", _in_language(F.col("__host"), group_key(lang_col)))
    rows = join_by_key(rows, bad, ["__host"], F.size("__lines") + 1, F.xxhash64(text_col))
    if lang_col:
        of_lang = bad.select(F.col("__host").alias("__lang"), F.col("__lines").alias("__more"))
        rows = join_by_key(rows, of_lang, ["__lang"], F.size("__more") + 1, F.xxhash64(text_col))
        both = F.concat(F.coalesce("__lines", F.array().cast("array<bigint>")), F.coalesce("__more", F.array().cast("array<bigint>")))
        rows = rows.withColumn("__lines", both)
    rows = rows.withColumn("__all", F.split(whole_text(text_col), "\n", -1))
    rest = F.filter("__all", lambda x: ~F.array_contains("__lines", F.xxhash64(x)))
    return rows.withColumn("__rest", F.when(F.col("__lines").isNull(), F.col("__all")).otherwise(rest))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, lang_col: str | None = None) -> DataFrame:
    """id_col, `n_lines`, `n_dropped`, `text` without boilerplate lines, for each row of docs.

    Null text is an empty text of one empty line. Null hosts are one host, null languages
    one language. Rows that share an id are treated one by one; no rows give no rows.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(host_col).alias("__site"), *([F.col(lang_col).alias("__tongue")] if lang_col else []))
    rows = _split_lines(own, "__text", "__site", ratio, least_pages, lang_col and "__tongue")
    return rows.select(F.col("__id").alias(id_col), F.size("__all").cast("long").alias("n_lines"), (F.size("__all") - F.size("__rest")).cast("long").alias("n_dropped"), F.array_join("__rest", "\n").alias("text"))


def without_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, lang_col: str | None = None) -> DataFrame:
    """docs with boilerplate lines cut from their texts, and n_chars (if there) following. Null texts stay null."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"), F.col(host_col).alias("__site"), *([F.col(lang_col).alias("__tongue")] if lang_col else []))
    rows = _split_lines(own, "__text", "__site", ratio, least_pages, lang_col and "__tongue")
    changed = F.size("__rest") < F.size("__all")
    rows = rows.select("__row", changed.alias("__changed"), F.when(changed, F.array_join("__rest", "\n")).otherwise(F.col("__text")).alias("__shown"))
    shown = {text_col: F.col("__shown")}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(F.col("__changed"), F.length("__shown").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return rows.select(*[shown.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), lang_col="lang")


OP7_SQL = r"""
WITH pages AS (SELECT DISTINCT source, lang, coalesce(text, '') AS text FROM documents),
sites AS (
  SELECT DISTINCT source, NULL AS lang, false AS of_lang, text FROM pages
  UNION ALL SELECT source, lang, true, text FROM pages
), totals AS (SELECT source, lang, of_lang, count(*) AS pages FROM sites GROUP BY ALL),
lines AS (
  SELECT source, lang, of_lang, line, count(*) AS n
  FROM (SELECT source, lang, of_lang, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM sites)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), bad AS (
  SELECT l.source, l.lang, l.of_lang, list(l.line) AS drop FROM lines l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source AND l.lang IS NOT DISTINCT FROM t.lang AND l.of_lang = t.of_lang
  WHERE l.n >= 5 AND l.n > 0.1::DOUBLE * t.pages GROUP BY ALL
), split AS (
  SELECT d.doc_id, string_split(coalesce(d.text, ''), chr(10)) AS al, list_concat(coalesce(b.drop, []), coalesce(c.drop, [])) AS dr
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source AND NOT b.of_lang
  LEFT JOIN bad c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND c.of_lang
), rest AS (SELECT doc_id, al, list_filter(al, lambda x: NOT list_contains(dr, x)) AS re FROM split)
SELECT doc_id, CAST(len(al) AS BIGINT) AS n_lines, CAST(len(al) - len(re) AS BIGINT) AS n_dropped, array_to_string(re, chr(10)) AS text FROM rest
"""
