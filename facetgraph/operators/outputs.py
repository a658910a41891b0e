"""Where generated texts belong, and which tasks are ready to be worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions by format; the headings that a task's text needs, by what they stand for; those that set limits.
EXTENSIONS = {"mermaid": ".mmd", "plantuml": ".puml", "markdown": ".md", "csv": ".csv", "source": ".txt"}
NEEDED = {"goal": ("goal",), "required": ("required", "required constraints"), "acceptance": ("acceptance", "acceptance criteria"), "working_set": ("working set", "required context")}
LIMITS = ("out of scope", "deferred")


def output_paths(outputs: DataFrame) -> DataFrame:
    """outputs(category, relative_dir, name, format, ...) with `path` and `duplicate`, whether another row has the path, too.

    relative_dir is an array of folders, null as none. Rows of a path are counted before
    they are joined, so that a frequent path moves no rows.
    """
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    extension = F.coalesce(F.try_element_at(known, F.coalesce("format", F.lit(""))), F.lit(".txt"))
    folders = F.concat(F.array("category"), F.coalesce("relative_dir", F.array().cast("array<string>")))
    rows = outputs.withColumn("path", F.concat(F.array_join(folders, "/"), F.lit("/"), F.coalesce("name", F.lit("")), extension))
    repeated = rows.groupBy("path").agg(F.count("*").alias("__n")).where("__n > 1")
    return rows.join(repeated, "path", "left").withColumn("duplicate", F.col("__n").isNotNull()).drop("__n")


def exploration_status(text: Column) -> Column:
    """Whether a task's text has a heading of two signs for each of NEEDED, as a struct of booleans, with `ready`, `missing` and `out_of_scope_present`."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?dmU)^##\s+(.+?)\s*$"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    has = {name: F.arrays_overlap(found, F.array(*[F.lit(t) for t in titles])) for name, titles in NEEDED.items()}
    missing = F.array_compact(F.array(*[F.when(~met, F.lit(name)) for name, met in has.items()]))
    limits = F.arrays_overlap(found, F.array(*[F.lit(t) for t in LIMITS]))
    return F.struct(*[met.alias(name) for name, met in has.items()], (F.size(missing) == 0).alias("ready"), missing.alias("missing"), limits.alias("out_of_scope_present"))


def label_rank(labels: Column, title: Column, ranks: dict[str, int], title_rank: str, default: int = 50) -> Column:
    """The least rank of a task's labels (an array, in any case); without a ranked one the number that the pattern title_rank finds in the title, else the default."""
    known = F.create_map(*[x for name, rank in ranks.items() for x in (F.lit(name), F.lit(rank))])
    least = F.array_min(F.transform(labels, lambda x: F.try_element_at(known, F.lower(F.trim(x)))))
    told = F.regexp_extract(F.coalesce(title, F.lit("")), title_rank, 1)
    return F.coalesce(least, F.nullif(told, F.lit("")).cast("int"), F.lit(default))


def unknown_names(disabled: DataFrame, available: DataFrame) -> DataFrame:
    """(name): the distinct names of disabled(name) that are not available(name)."""
    return disabled.select("name").where("name IS NOT NULL").distinct().join(available.select("name").distinct(), "name", "left_anti")
