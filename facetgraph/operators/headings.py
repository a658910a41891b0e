"""Headings and sections of Markdown texts.

Lines are cut into blocks, and what a line needs of those before it (the last heading,
whether a code block is open) is carried over block ends, one row a block: a document of
any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetgraph.functions.text import trimmed

#: Lines that a window sees at once.
BLOCK = 1000

# What a section's title holds, in any case, the first that it holds counts; the form of a heading.
SECTIONS = (
    ("goal", ("goal", "目的", "概要")),
    ("required", ("required", "requirement", "要件", "必須", "基本方針")),
    ("acceptance", ("acceptance", "完了条件", "completion")),
    ("out_of_scope", ("out of scope", "deferred", "対象外", "今回はやらない")),
)
HEADING = r"(?U)^(#{1,4})\s+(.+?)\s*$"
_LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def lines(documents: DataFrame) -> DataFrame:
    """(doc, n, line): the lines of documents(doc, text) from 1 on; a last line end begins no line."""
    whole = F.regexp_replace("text", rf"(?:{_LINE_END})\z", "")
    rows = documents.where("text != ''").select("doc", F.posexplode(F.split(whole, _LINE_END, -1)).alias("n", "line"))
    return rows.withColumn("n", F.col("n") + 1)


def heading_index(documents: DataFrame) -> DataFrame:
    """(doc, n, level, title): headings of one to four signs, anywhere in a text, without white space at their ends."""
    found = lines(documents).where(F.col("line").rlike(HEADING))
    return found.select("doc", "n", F.length(F.regexp_extract("line", HEADING, 1)).cast("long").alias("level"), F.regexp_extract("line", HEADING, 2).alias("title"))


def _carried(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows(doc, n, ...) with `out`, the last value that is not null up to this line, carried over block ends."""
    rows = rows.withColumn("__block", F.floor(F.col("n") / BLOCK))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("doc", "__block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("doc", "__block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("n"))).alias("__end"))
    before = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(Window.partitionBy("doc").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("__own", own).join(before.select("doc", "__block", "__before"), ["doc", "__block"]).withColumn(out, F.coalesce("__own", "__before")).drop("__own", "__before", "__block")


def _counted(rows: DataFrame, keys: list[str], flag: str, out: str) -> DataFrame:
    """rows(*keys, n, ...) with `out`, how many lines of its key up to this one bear the flag, counted by blocks."""
    rows = rows.withColumn("__block", F.floor(F.col("n") / BLOCK))
    own = F.count_if(F.col(flag)).over(Window.partitionBy(*keys, "__block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*keys, "__block").agg(F.count_if(F.col(flag)).alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("__own", own).join(before.select(*keys, "__block", "__before"), [*keys, "__block"]).withColumn(out, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__own", "__before", "__block")


def section_name(title: Column) -> Column:
    """The section that a title stands for; empty for any other."""
    out = F.lit("")
    for name, words in reversed(SECTIONS):
        out = F.when(F.lower(title).rlike("|".join(words)), name).otherwise(out)
    return out


def clean_line(line: Column) -> Column:
    """A line without its list sign and with links as their texts."""
    out = F.regexp_replace(F.regexp_replace(trimmed(line), r"(?U)^[-*+]\s+", ""), r"(?U)^\d+[.)]\s+", "")
    out = F.regexp_replace(out, r"(?U)^- \[[ xX]\]\s*", "")
    return F.regexp_replace(out, r"\[(.*?)\]\([^)]*\)", "$1")


def shortened(text: Column, limit: int) -> Column:
    """A text of over `limit` characters cut to that many, the last one an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def _compact(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(*keys, text): the rows(*keys, n, line) of each key outside code blocks, cleaned, in one line."""
    marked = _counted(rows.withColumn("fence", trimmed(F.col("line")).rlike("^```")), keys, "fence", "fences").where("NOT fence AND fences % 2 = 0")
    kept = marked.select(*keys, "n", F.when(trimmed(F.col("line")) != "", clean_line(F.col("line"))).alias("line")).where("line IS NOT NULL")
    joined = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "line"))), lambda x: x["line"]), " ").alias("line")
    blocks = kept.groupBy(*keys, F.floor(F.col("n") / BLOCK).alias("block")).agg(joined("n"))
    whole = blocks.groupBy(*keys).agg(joined("block"))
    text = trimmed(F.regexp_replace("line", r"(?U)\s+", " "))
    return whole.select(*keys, shortened(text, limit).alias("text")).where("text != ''")


def sections(documents: DataFrame, limit: int = 700) -> DataFrame:
    """(doc, section, text): what stands below headings that name a section, all its places together, cleaned and shortened."""
    rows = lines(documents)
    heading = trimmed(F.col("line")).rlike(r"(?U)^#{1,6}\s+\S")
    title = trimmed(F.regexp_replace(trimmed(F.col("line")), r"(?U)^#{1,6}\s+", ""))
    rows = _carried(rows.withColumn("named", F.when(heading, section_name(title))), "named", "section")
    return _compact(rows.where("named IS NULL AND section != ''").select("doc", "section", "n", "line"), ["doc", "section"], limit)


def compact_bodies(documents: DataFrame, limit: int = 900) -> DataFrame:
    """(doc, text): whole texts in one line, heading signs and code blocks left out, shortened; a sentence says where nothing is left."""
    rows = lines(documents).withColumn("line", F.regexp_replace("line", r"(?U)^#{1,6}\s*", ""))
    found = documents.join(_compact(rows, ["doc"], limit).withColumnRenamed("text", "__text"), "doc", "left")
    none = F.when(F.coalesce("text", F.lit("")) == "", "No description provided.").otherwise("No usable description provided.")
    return found.select("doc", F.coalesce("__text", none).alias("text"))
