"""Queries on a repository's files: paths, texts and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Directories that a scan leaves out, languages by extension, names of deployment files, and file roles by the first rule that holds.
SKIPPED = (".git", ".dev", ".codex", ".venv", "venv", "build", "dist", "__pycache__")
LANGUAGES = {".py": "python", ".gd": "gdscript", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".java": "java", ".go": "go", ".yml": "yaml", ".yaml": "yaml"}
DEPLOYMENT_NAMES = ("compose.yml", "compose.yaml", "docker-compose.yml", "docker-compose.yaml")
ROLES = (
    ("source", r"^Src/"),
    ("tests", r"^tests/"),
    ("docs", r"^(docs|specification)/|^(README|AI_CONTEXT|AGENTS)\.md$"),
    ("tooling", r"^tools/|(?i)\.(bat|sh)$"),
    ("config", r"^\.github/|(^|/)(pyproject\.toml|\.gitignore)$"),
    ("other", ""),
)

#: Rules of a validation plan, which are tried one by one on each path.
MAX_RULES = 10_000


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, text) of all files below root, paths relative to it; texts are whole files in UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    return files.select(F.substr(inside, F.lit(len(root.rstrip("/")) + 2)).alias("path"), "length", F.decode("content", "UTF-8").alias("text"))


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part with its dot, else empty."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def project_files(files: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """files(path, ...) outside skipped directories, with `language`."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return files.where(~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skipped]))).withColumn("language", language(F.col("path")))


def source_files(files: DataFrame) -> DataFrame:
    """The project files in a programming language."""
    return project_files(files).where("language NOT IN ('unknown', 'yaml')")


def deployment_files(files: DataFrame) -> DataFrame:
    """The project files that configure a deployment: dockerfiles, compose files and all YAML."""
    name = F.lower(F.substring_index("path", "/", -1))
    return project_files(files).where(F.startswith(name, F.lit("dockerfile")) | name.isin(*DEPLOYMENT_NAMES) | (F.col("language") == "yaml"))


def role(path: Column, rules: tuple[tuple[str, str], ...] = ROLES) -> Column:
    """The name of the first rule, a pattern, that the path meets."""
    out = F.lit(None).cast("string")
    for name, rule in rules:
        out = F.coalesce(out, F.when(path.rlike(rule), F.lit(name)))
    return out


def role_map(files: DataFrame, samples: int = 20) -> DataFrame:
    """(role, count, samples) of each role, also of those that no file has: how many files have it, and the first of them by path."""
    rows = files.select("path", role(F.col("path")).alias("role"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("role").orderBy("path"))).where(F.col("n") <= samples)
    shown = first.groupBy("role").agg(F.sort_array(F.collect_list("path")).alias("samples"))
    roles = files.sparkSession.createDataFrame([(name,) for name, _ in ROLES], "role string")
    found = rows.groupBy("role").agg(F.count("*").alias("count")).join(shown, "role")
    return roles.join(found, "role", "left").select("role", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def profile(files: DataFrame) -> DataFrame:
    """(suffix, files, lines, tokens) over files(path, text): tokens are a quarter of the characters, rounded down in each file."""
    lines = F.size(F.split(F.regexp_replace("text", r"\r\n|\r|\n$", "\n"), "\n")) - F.when(F.col("text").rlike(r"(^|[\r\n])$"), 1).otherwise(0)
    counted = files.select(extension(F.col("path")).alias("suffix"), lines.alias("l"), F.floor(F.length("text") / 4).alias("t"))
    return counted.groupBy("suffix").agg(F.count("*").alias("files"), F.sum("l").alias("lines"), F.sum("t").alias("tokens"))


def search(files: DataFrame, key: str, query: str, regex: bool = False, case_sensitive: bool = False, max_results: int = 40, max_bytes: int = 500_000) -> DataFrame:
    """(key, line, text, truncated): the first lines, by key, that query hits in files(key, text, ...) of max_bytes or fewer.

    Lines count from 1; their text is trimmed and cut to 240 characters. truncated says,
    on each row, that max_results were reached.
    """
    pattern = ("" if case_sensitive else "(?i)") + (query if regex else "".join("\\" + c if not c.isalnum() and c != " " else c for c in query))
    lines = files.where(F.octet_length("text") <= max_bytes).select(key, F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "text"))
    hits = lines.where(F.col("text").rlike(pattern)).select(key, (F.col("line") + 1).alias("line"), F.substring(F.trim("text"), 1, 240).alias("text"))
    few = hits.orderBy(key, "line").limit(max_results)
    return few.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= max_results)


def find_paths(files: DataFrame, pattern: str, max_results: int = 80) -> DataFrame:
    """(path, truncated): the first paths that a glob matches or, without * ? or [, that hold the pattern in any case."""
    if any(c in pattern for c in "*?["):
        rule = "".join({"*": ".*", "?": ".", "[": "[", "]": "]", "!": "!"}.get(c, c if c.isalnum() or c in "-_" else "\\" + c) for c in pattern)
        hit = F.col("path").rlike("(?s)^" + rule.replace("[!", "[^") + "$")
    else:
        hit = F.contains(F.lower("path"), F.lit(pattern.lower()))
    few = files.where(hit).select("path").orderBy("path").limit(max_results)
    return few.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= max_results)


def compact_log(lines: DataFrame, log: str, rule: str, max_lines: int = 80, tail_lines: int = 20) -> DataFrame:
    """(log, line, text, truncated): of each log of lines(log, line, text), line from 1, those that hit rule and the last ones.

    Texts are cut to 400 characters; beyond max_lines the later ones go, and truncated is true.
    """
    last = lines.groupBy(log).agg(F.max("line").alias("__last"))
    kept = lines.join(last, log).where(F.col("text").rlike(rule) | (F.col("line") > F.col("__last") - tail_lines))
    by = Window.partitionBy(log)
    ranked = kept.select(log, "line", F.substring("text", 1, 400).alias("text"), F.row_number().over(by.orderBy("line")).alias("n"), F.count("*").over(by).alias("all"))
    return ranked.where(F.col("n") <= max_lines).select(log, "line", "text", (F.col("all") > max_lines).alias("truncated"))


def first_diagnostics(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """rows, only the first of those that share keys; order should tell all of them apart."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("first")).select(*keys, "first.*").select(*rows.columns)


def most_urgent(issues: DataFrame, rank: str, number: str, actionable: str) -> DataFrame:
    """The one issue of lowest rank, then number, among the actionable ones; among all if none is."""
    return issues.orderBy(F.when(F.col(actionable), 0).otherwise(1), rank, number).limit(1)


def validation_plan(changes: DataFrame, rules: DataFrame, group: str) -> DataFrame:
    """(group, order, command): the commands whose rule some changed path of a group meets, each once, in the rules' order.

    changes(group, path); rules(order, pattern, command), MAX_RULES at most (else a
    ValueError), are broadcast and tried on each distinct path.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    paths = changes.select("path").distinct().join(F.broadcast(rules), F.expr("path RLIKE pattern"))
    met = changes.select(group, "path").join(paths, "path")
    return met.groupBy(group, "command").agg(F.min("order").alias("order")).select(group, "order", "command")
