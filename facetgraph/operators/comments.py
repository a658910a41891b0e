"""Comments for declarations, and copies of sources that hold them.

A source is taken apart into numbered lines, comments join by line, and lines are put
together in blocks, then blocks in order: only a file's text, one value anyway, is ever
in one place. Sources without comments are not taken apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgraph.functions import text as T
from facetgraph.functions.names import name_words

# What is commented on, and the sign of a comment by language.
COMMENTED = ("class", "function", "method")
COMMENT_SIGNS = {"python": "#", "gdscript": "#", "csharp": "//", "cpp": "//", "go": "//", "java": "//"}

#: Lines that are put together before blocks are.
BLOCK = 1000


def candidates(entities: DataFrame) -> DataFrame:
    """entities(path, ord, kind, name, line, indent, docstring, calls) as comments (path, ord, target, name, line, indent, text, error).

    Only classes, functions and methods without a docstring; indent is white space. error
    says why a place or a name is refused, and text is null then.
    """
    rows = entities.where(F.col("kind").isin(*COMMENTED) & (F.coalesce("docstring", F.lit("")) == ""))
    depth = F.coalesce("indent", F.lit(0))
    error = F.when(F.coalesce("name", F.lit("")) == "", "a declaration has no name").when((F.coalesce("line", F.lit(0)) < 1) | (depth < 0), F.concat(F.lit("no such place: "), "name"))
    words = name_words(F.col("name"))
    text = T.comment_text(F.col("name"), words, F.col("kind"), F.coalesce(F.size("calls"), F.lit(0)) > 0)
    return rows.select("path", "ord", F.col("kind").alias("target"), "name", "line", F.repeat(F.lit(" "), F.greatest(depth, F.lit(0)).cast("int")).alias("indent"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line, source): the lines of files(path, text) from 1 on with their own line ends; after a last line end comes an empty line."""
    return files.select("path", F.posexplode(F.split("text", "(?<=\n)", -1)).alias("line", "source")).withColumn("line", F.col("line") + 1)


def commented(files: DataFrame, comments: DataFrame) -> DataFrame:
    """files(path, language, text) as (path, text, error): each comment above its line, with the line's own line end, in order of `ord`.

    A file whose language has no known comments, or with a comment that is refused, that
    has no line or an empty one, or that is itself empty or of several lines, has no text:
    error names the first reason. Paths are distinct and not null; a null text is empty.
    """
    signs = F.create_map(*[F.lit(x) for pair in COMMENT_SIGNS.items() for x in pair])
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"), F.try_element_at(signs, F.coalesce("language", F.lit(""))).alias("sign"), F.concat(F.lit("no comments for the language "), F.coalesce("language", F.lit("null"))).alias("unknown"))
    held = files.join(comments.select("path").distinct(), "path", "left_semi")
    lines = source_lines(held.where("sign IS NOT NULL"))
    placed = comments.join(lines.withColumn("there", F.lit(True)), ["path", "line"], "left")
    named = F.coalesce("name", F.lit(""))
    wrong = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("there").isNull(), F.concat(F.lit("outside the source: "), named))
        .when(T.trimmed(F.col("source")) == "", F.concat(F.lit("at an empty line: "), named))
        .when((F.coalesce("text", F.lit("")) == "") | F.col("text").rlike("[\r\n]"), F.concat(F.lit("no text of one line: "), named))
    )
    faults = placed.select("path", "ord", wrong.alias("wrong")).where("wrong IS NOT NULL").groupBy("path").agg(F.min_by("wrong", "ord").alias("wrong"))

    own = comments.groupBy("path", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "indent", "text"))), lambda c: F.struct(c["indent"].alias("indent"), c["text"].alias("text"))).alias("above"))
    sign = held.select("path", "sign")
    end = F.when(F.endswith("source", F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))
    above = F.array_join(F.transform("above", lambda c: F.concat(c["indent"], F.col("sign"), F.lit(" "), c["text"], end)), "")
    drawn = lines.join(own, ["path", "line"], "left").join(sign, "path").select("path", "line", F.concat(F.coalesce(above, F.lit("")), "source").alias("out"))
    joined = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "out"))), lambda x: x["out"]), "").alias("out")
    blocks = drawn.groupBy("path", F.floor(F.col("line") / BLOCK).alias("block")).agg(joined("line"))
    whole = blocks.groupBy("path").agg(joined("block"))
    rows = files.join(whole, "path", "left").join(faults, "path", "left")
    error = F.when(F.col("sign").isNull(), F.col("unknown")).otherwise(F.col("wrong"))
    return rows.select("path", F.when(error.isNull(), F.coalesce("out", "text")).alias("text"), error.alias("error"))
