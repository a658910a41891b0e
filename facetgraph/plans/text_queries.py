"""Registered queries on names, texts and paths, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.functions import names, text
from facetgraph.operators import repository
from facetgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _text(*parts: object) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _one_of(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


@query(r"WITH n AS (SELECT *, p_brand || ' / ' || p_name || '#' AS logical FROM part), m AS (SELECT *, regexp_replace(substr(regexp_replace(regexp_replace(logical, '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), 1, 80), '[_-]+$', '') AS safe FROM n) SELECT p_partkey, 'state_' || substr(sha256(logical), 1, 10) || '_' || CASE WHEN safe = '' THEN 'state' ELSE safe END AS output_name, regexp_replace(p_brand || '.' || p_name, '^.*\.', '') AS simple_name, coalesce(nullif(p_brand, ''), '<module>') || ':' || p_name AS object_key FROM m")
def fn1_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    logical = F.concat("p_brand", F.lit(" / "), "p_name", F.lit("#"))
    return table(spark, sf_dir, "part").select("p_partkey", names.stable_output_name("state", logical, "state").alias("output_name"), names.simple_name(names.qualified_name(F.col("p_brand"), F.col("p_name"))).alias("simple_name"), names.object_key(F.col("p_brand"), F.col("p_name")).alias("object_key"))


@query(r"SELECT c_custkey, array_to_string(list_transform(list_filter(string_split(regexp_replace(c_name || '_' || c_mktsegment || 'Buyer__X', '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_'), lambda x: x <> ''), lambda x: lower(x)), ' ') AS words FROM customer")
def fn3_name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.lit("_"), "c_mktsegment", F.lit("Buyer__X"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(names.name_words(name), " ").alias("words"))


_HANDLER = "CASE WHEN value < 10 THEN 'Panel' || user_id || '.on_' || event_type || '_clicked' WHEN value < 30 THEN 'handle_' || event_type || '__by_user_changed' WHEN value < 60 THEN 'Box.do_' || event_type ELSE 'on_' END"


@query(f"""WITH h AS (SELECT *, {_HANDLER} AS handler FROM events) SELECT event_id, CASE WHEN value < 5 THEN event_type WHEN value < 10 THEN upper(substr(event_type, 1, 1)) || substr(event_type, 2)
 WHEN value < 30 THEN upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' by user' WHEN value < 60 THEN upper(substr(event_type, 1, 1)) || substr(event_type, 2) ELSE 'User action' END AS name, CASE WHEN handler = 'on_' THEN 'on' ELSE handler END AS file FROM h""")
def fn4_use_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    handler = F.when(value < 10, _text("Panel", F.col("user_id"), ".on_", kind, "_clicked")).when(value < 30, _text("handle_", kind, "__by_user_changed")).when(value < 60, _text("Box.do_", kind)).otherwise("on_")
    label = F.when(value < 5, _text("\t ", kind, " \n"))
    return table(spark, sf_dir, "events").select("event_id", text.use_case_name(label, handler).alias("name"), text.safe_name(handler, "use_cases").alias("file"))


_IMAGES = ["postgres:16", "library/Redis", "rabbitmq-x", "nginx", "memcached", "my-mongo"]


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'database' WHEN 1 THEN 'cache' WHEN 2 THEN 'message-queue' WHEN 4 THEN 'cache' WHEN 5 THEN 'database' ELSE 'service' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS rank FROM supplier")
def fn7_service_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as services with an image by their number; FN7 and FN9."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.service_kind(F.col("s_name"), _one_of(_IMAGES, key % 6)).alias("kind"), text.confidence_rank(_one_of(["confirmed", "inferred", "unknown"], key % 3)).alias("rank"))


@query("SELECT p_partkey, 'A' || p_size || ',K' || (p_partkey % 7) AS secrets, 'E_' || (p_size % 5) AS environment FROM part")
def fn10_context_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _text('run: echo ${{ secrets.A', F.col("p_size"), " }} ${{ secrets['K", F.col("p_partkey") % 7, "'] }} mysecrets.no ${{ env.E_", F.col("p_size") % 5, " }} secrets.A", F.col("p_size"))
    joined = lambda context: F.array_join(text.context_references(shown, context), ",")
    return table(spark, sf_dir, "part").select("p_partkey", joined("secrets").alias("secrets"), joined("env").alias("environment"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'cache' WHEN 1 THEN 'cache-restore' WHEN 2 THEN 'cache-save' WHEN 3 THEN 'artifact-upload' WHEN 4 THEN 'artifact-download' END AS kind FROM part")
def fn13_resource_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = ["Actions/cache@v4", "actions/cache/restore@v4", "actions/cache/save", "actions/upload-artifact@v3", "actions/download-artifact@x@y", "actions/checkout@v4"]
    return table(spark, sf_dir, "part").select("p_partkey", text.resource_kind(_one_of(actions, F.col("p_size") % 6)).alias("kind"))


@query(r"""SELECT doc_id, replace(replace(text, '\', '\\'), '"', '\"') AS quoted, replace(replace(replace(text, chr(13), ' '), chr(10), ' '), '|', '\|') AS cell, replace(replace(replace(text, chr(10), ' '), chr(13), ' '), ':', '-') AS label, replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '"', '''') AS object FROM documents""")
def fn15_escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.quoted(t).alias("quoted"), text.table_cell(t).alias("cell"), text.message_label(t).alias("label"), text.object_label(t).alias("object"))


@query("SELECT page_id, 'pkg_' || regexp_replace(url, '[^0-9A-Za-z_]', '_', 'g') AS node, 'c_' || substr(sha1(url), 1, 10) AS hashed FROM pages")
def fn16_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.node_id(F.col("url"), "pkg_").alias("node"), text.hashed_id(F.col("url"), "c_").alias("hashed"))


@query("SELECT p_partkey, 'python:' || p_size || ',' || replace(p_name, ' ', '-') AS images FROM part")
def fn18_base_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = _text("FROM python:", F.col("p_size"), "\n# from nothing\nRUN x from y\n  from --a=b --c ", F.replace("p_name", F.lit(" "), F.lit("-")), " AS b\nFROM\n")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.base_images(file), ",").alias("images"))


# --- paths ---------------------------------------------------------------------------

_FOLDERS = ["Src/languages/", "tests/", "docs/en/", "tools/", "Src/build/", ".github/workflows/", "", "venv/lib/", "go/internal/"]
_SUFFIXES = [".py", ".GO", ".yaml", ".md", ".cs", ".tar.gz", "", ".cpp"]
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_FILES = f"""f AS (SELECT p_partkey, {_list(_FOLDERS)}[1 + p_size % 9] || CASE p_partkey % 17 WHEN 0 THEN 'docker-compose.yml' WHEN 1 THEN 'Dockerfile.' || p_partkey ELSE replace(p_name, ' ', '_') || p_partkey || {_list(_SUFFIXES)}[1 + p_partkey % 8] END AS path,
  p_name || chr(10) || p_type || chr(13) || chr(10) || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE '' END AS text FROM part),
g AS (SELECT *, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\\.[^.]*)$', 1)) AS ext FROM f),
h AS (SELECT *, CASE ext WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.cs' THEN 'csharp' WHEN '.cpp' THEN 'cpp' WHEN '.yaml' THEN 'yaml' WHEN '.yml' THEN 'yaml' ELSE 'unknown' END AS language FROM g WHERE NOT regexp_matches(path, '(^|/)(build|venv)/'))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a project."""
    key = F.col("p_partkey")
    plain = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), key.cast("string"), _one_of(_SUFFIXES, key % 8))
    name = F.when(key % 17 == 0, "docker-compose.yml").when(key % 17 == 1, _text("Dockerfile.", key)).otherwise(plain)
    shown = F.concat("p_name", F.lit("\n"), "p_type", F.lit("\r\n"), "p_brand", F.when(F.col("p_size") % 2 == 0, "\n").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(_one_of(_FOLDERS, F.col("p_size") % 9), name).alias("path"), shown.alias("text"))


@query(f"WITH {_FILES} SELECT p_partkey, path, language FROM h")
def sc1_project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files outside skipped directories with their language; SC1 and SC2."""
    return repository.project_files(_files(spark, sf_dir)).select("p_partkey", "path", "language")


@query(f"WITH {_FILES} SELECT p_partkey, path, language FROM h WHERE language NOT IN ('unknown', 'yaml')")
def sc3_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.source_files(_files(spark, sf_dir)).select("p_partkey", "path", "language")


@query(f"WITH {_FILES} SELECT p_partkey, path FROM h WHERE language = 'yaml' OR regexp_matches(path, '(^|/)Dockerfile[^/]*$')")
def sc4_deployment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.deployment_files(_files(spark, sf_dir)).select("p_partkey", "path")


@query(f"WITH {_FILES} SELECT ext AS suffix, count(*) AS files, CAST(sum(3) AS BIGINT) AS lines, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM g GROUP BY ext")
def ag15_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.profile(_files(spark, sf_dir))


@query(f"WITH {_FILES}, r AS (SELECT path, CASE WHEN starts_with(path, 'Src/') THEN 'source' WHEN starts_with(path, 'tests/') THEN 'tests' WHEN starts_with(path, 'docs/') THEN 'docs' WHEN starts_with(path, 'tools/') THEN 'tooling' WHEN starts_with(path, '.github/') THEN 'config' ELSE 'other' END AS role FROM f) SELECT v.role, count(path) AS count, coalesce(array_to_string((list(path ORDER BY path) FILTER (WHERE path IS NOT NULL))[1:20], ','), '') AS samples FROM (VALUES ('source'), ('tests'), ('docs'), ('tooling'), ('config'), ('other')) v(role) LEFT JOIN r ON r.role = v.role GROUP BY v.role")
def ag16_role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.role_map(_files(spark, sf_dir)).select("role", "count", F.array_join("samples", ",").alias("samples"))


@query(f"WITH {_FILES}, m AS (SELECT path FROM f WHERE regexp_matches(path, '^tools/.*\\.p.$') ORDER BY path LIMIT 80) SELECT path, (SELECT count(*) FROM m) >= 80 AS truncated FROM m")
def so5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 paths that a glob matches, which is a limit of the feature."""
    return repository.find_paths(_files(spark, sf_dir).select("path"), "tools/*.p?")


@query(f"WITH {_FILES} SELECT p_partkey, CASE WHEN regexp_matches(path, '/__init__\\.[^./]*$') THEN '' ELSE replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') END AS module FROM f WHERE NOT starts_with(path, '.')")
def fn17_module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("path NOT LIKE '.%'").select("p_partkey", names.module_name(F.col("path")).alias("module"))


_RULES = [(1, r"^tools/|\.(bat|sh)$", "check the tools"), (2, r"^Src/languages/", "check the parsers"), (3, r"^(docs|Src)/", "check the rules"), (4, r"^\.github/", "build it"), (5, r"(?<!\.md)$", "run all tests")]


@query(f"WITH {_FILES}, m AS (SELECT DISTINCT p_brand, path FROM part JOIN f USING (p_partkey)), r AS (SELECT p_brand, 1 AS \"order\", 'check the tools' AS command FROM m WHERE starts_with(path, 'tools/') UNION SELECT p_brand, 2, 'check the parsers' FROM m WHERE starts_with(path, 'Src/languages/') UNION SELECT p_brand, 3, 'check the rules' FROM m WHERE starts_with(path, 'docs/') OR starts_with(path, 'Src/') UNION SELECT p_brand, 4, 'build it' FROM m WHERE starts_with(path, '.github/') UNION SELECT p_brand, 5, 'run all tests' FROM m WHERE NOT ends_with(path, '.md')) SELECT * FROM r")
def ev12_validation_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as changes of their files: what has to be run for each."""
    rules = spark.createDataFrame(_RULES, "order int, pattern string, command string")
    return repository.validation_plan(_files(spark, sf_dir), rules, "p_brand")


# --- texts ---------------------------------------------------------------------------


@query("WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS t, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS line FROM documents WHERE strlen(text) <= 500000), h AS (SELECT doc_id, line, substr(trim(t), 1, 240) AS text FROM l WHERE regexp_matches(t, '(?i)copyright|license') ORDER BY doc_id, line LIMIT 40) SELECT doc_id, CAST(line AS INT) AS line, text, (SELECT count(*) FROM h) >= 40 AS truncated FROM h")
def so4_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 lines that name a license, which is a limit of the feature."""
    return repository.search(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "copyright|license", regex=True)


@query("WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS line, doc_id FROM documents) SELECT line, count(*) AS n, min(doc_id) AS first_doc FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1")
def ag14_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed lines that stand more than once in all documents."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.where("line != ''").groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), m AS (SELECT doc_id, max(line) AS last FROM l GROUP BY doc_id), k AS (SELECT l.doc_id, line, t, row_number() OVER (PARTITION BY l.doc_id ORDER BY line) AS n, count(*) OVER (PARTITION BY l.doc_id) AS c FROM l JOIN m ON m.doc_id = l.doc_id WHERE regexp_matches(t, '[0-9]') OR line > last - 2) SELECT doc_id, CAST(line AS BIGINT) AS line, substr(t, 1, 400) AS text, c > 5 AS truncated FROM k WHERE n <= 5")
def so7_compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the lines with a digit and the last two, five at most, as of a log."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))
    return repository.compact_log(lines, "doc_id", "[0-9]", max_lines=5, tail_lines=2)


@query("SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def so8_first_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind and user, as of repeated diagnostics."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return repository.first_diagnostics(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderpriority, o_orderkey LIMIT 1")
def so6_most_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open order of highest priority, the smallest number of equals; one row is the feature."""
    orders = table(spark, sf_dir, "orders").withColumn("open", F.col("o_orderstatus") == "O")
    return repository.most_urgent(orders, "o_orderpriority", "o_orderkey", "open").select("o_orderkey", "o_orderpriority")
