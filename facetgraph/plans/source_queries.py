"""Registered queries on comments, headings and timing, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.functions import text as T
from facetgraph.operators import comments, graph, headings, outputs, render, timing
from facetgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _one_of(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- comments ---------------------------------------------------------------------------

_FIRST = [*T.COMMENT_VERBS, "handle", "HTTPLoad"]
_SAID = ", ".join(f"('{verb}', '{said}')" for verb, said in T.COMMENT_VERBS.items())


@query(f"""WITH p AS (SELECT p_partkey AS id, {_list(_FIRST)}[1 + p_partkey % {len(_FIRST)}] AS verb, string_split(p_name, ' ')[1] AS word FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 5 < 2),
v(verb, said) AS (VALUES {_SAID}), n AS (SELECT p.*, said, CASE WHEN id % 7 = 0 THEN '' ELSE ' ' || word END AS tail, CASE verb WHEN 'HTTPLoad' THEN 'httpload' ELSE verb END AS low FROM p LEFT JOIN v USING (verb))
SELECT id::VARCHAR AS path, ['class', 'function', 'method'][1 + id % 4] AS target, verb || CASE WHEN id % 7 = 0 THEN '' ELSE '_' || upper(word) END AS name, id % 9 AS line, repeat(' ', (id % 3)::INT) AS indent,
CASE WHEN id % 9 > 0 THEN CASE WHEN id % 4 = 0 THEN low || tail || 'に関する状態と処理をまとめます。' WHEN said IS NOT NULL THEN CASE tail WHEN '' THEN '処理' ELSE substr(tail, 2) END || said WHEN id % 2 = 0 THEN low || tail || 'の処理を実行し、関連処理を連携させます。' ELSE low || tail || 'の処理を行います。' END END AS text,
CASE WHEN id % 9 = 0 THEN 'no such place: ' || verb || CASE WHEN id % 7 = 0 THEN '' ELSE '_' || upper(word) END END AS error FROM n""")
def gn14_comment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on parts as declarations: all known verbs and some others, some documented, some at no place."""
    key = F.col("p_partkey")
    name = F.concat_ws("_", _one_of(_FIRST, key), F.when(key % 7 != 0, F.upper(F.substring_index("p_name", " ", 1))))
    entities = table(spark, sf_dir, "part").select(
        key.cast("string").alias("path"),
        key.alias("ord"),
        _one_of(["class", "function", "method", "branch"], key).alias("kind"),
        name.alias("name"),
        (key % 9).alias("line"),
        (key % 3).alias("indent"),
        F.when(key % 5 == 0, "").when(key % 5 > 1, "Told.").alias("docstring"),
        F.when(key % 2 == 0, F.array(F.lit("call"))).alias("calls"),
    )
    return comments.candidates(entities).drop("ord")


_LANGUAGES = ["python", "go", "gdscript", "java", "cobol"]


@query(f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text, {_list(_LANGUAGES)}[1 + doc_id % 5] AS language, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, language, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM s), m AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS last FROM l),
d AS (SELECT doc_id, n, CASE WHEN n % 3 = 1 AND regexp_matches(line, '[A-Za-z]') THEN repeat(' ', (n % 4)::INT) || CASE WHEN language IN ('go', 'java') THEN '//' ELSE '#' END || ' line ' || n || CASE WHEN n < last AND ends_with(line, chr(13)) THEN chr(13) || chr(10) ELSE chr(10) END ELSE '' END || line AS out FROM m),
w AS (SELECT doc_id, string_agg(out, chr(10) ORDER BY n) AS out FROM d GROUP BY doc_id)
SELECT doc_id::VARCHAR AS path, CASE WHEN language != 'cobol' AND doc_id % 11 != 5 THEN sha256(out) END AS text_sha256, CASE WHEN language = 'cobol' THEN 'no comments for the language cobol' WHEN doc_id % 11 = 5 THEN 'outside the source: beyond' END AS error FROM s JOIN w USING (doc_id)""")
def gn17_commented_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sources, a comment above each third line that has a letter; each eleventh has a comment beyond its end."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), _one_of(_LANGUAGES, F.col("doc_id")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.col("line")
    above = comments.source_lines(docs).where((n % 3 == 1) & F.col("source").rlike("[A-Za-z]"))
    none = F.lit(None).cast("string")
    notes = above.select("path", n.cast("long").alias("ord"), F.lit("n").alias("name"), "line", F.repeat(F.lit(" "), (n % 4).cast("int")).alias("indent"), F.concat(F.lit("line "), n.cast("string")).alias("text"), none.alias("error"))
    beyond = docs.where("cast(path AS long) % 11 = 5").select("path", F.lit(0).cast("long"), F.lit("beyond"), F.lit(2**30), F.lit(""), F.lit("x"), none)
    return comments.commented(docs, notes.union(beyond)).select("path", F.sha2("text", 256).alias("text_sha256"), "error")


# --- headings ---------------------------------------------------------------------------

_TITLES = ["Goal and more", "Required", "Notes", "Deferred", "完了条件"]
_MARKED = f"""WITH s AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS ls FROM documents WHERE text != ''), l AS (SELECT doc, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS raw FROM s),
m AS (SELECT doc, n, CASE WHEN n % 6 = 1 THEN repeat('#', (1 + n % 5)::INT) || ' ' || {_list(_TITLES)}[1 + (doc + n // 6) % 5] || ' ' WHEN n % 11 = 4 THEN '```' WHEN n % 4 = 3 THEN '- ' || raw ELSE raw END AS line FROM l)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Markdown: each sixth line a heading, some lines list items or ends of code blocks."""
    docs = table(spark, sf_dir, "documents").where("text != ''").select(F.col("doc_id").alias("doc"), F.split("text", "\n", -1).alias("ls"))

    def line(raw: Column, i: Column) -> Column:
        n = i + 1
        title = F.concat(F.repeat(F.lit("#"), (1 + n % 5).cast("int")), F.lit(" "), _one_of(_TITLES, F.col("doc") + F.floor(n / 6)), F.lit(" "))
        return F.when(n % 6 == 1, title).when(n % 11 == 4, "```").when(n % 4 == 3, F.concat(F.lit("- "), raw)).otherwise(raw)

    return docs.select("doc", F.array_join(F.transform("ls", line), "\n").alias("text"))


@query(f"{_MARKED} SELECT doc, n, length(regexp_extract(line, '^#+')) AS level, trim(ltrim(line, '#')) AS title FROM m WHERE regexp_matches(line, '^#{{1,4}}\\s+\\S')")
def fn19_heading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headings.heading_index(_marked(spark, sf_dir))
    return rows.withColumn("n", F.col("n").cast("long"))


@query(rf"""{_MARKED}, h AS (SELECT *, CASE WHEN n % 6 = 1 THEN ['goal', 'required', '', 'out_of_scope', 'acceptance'][1 + (doc + n // 6) % 5] END AS named FROM m),
c AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n) AS section FROM h), k AS (SELECT *, trim(line) LIKE '```%' AS fence FROM c WHERE named IS NULL AND section != ''),
f AS (SELECT *, count(*) FILTER (WHERE fence) OVER (PARTITION BY doc, section ORDER BY n) AS fences FROM k),
g AS (SELECT doc, section, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(line), '^[-*+]\s+', ''), '^\d+[.)]\s+', ''), '^- \[[ xX]\]\s*', ''), '\[(.*?)\]\([^)]*\)', '\1', 'g') AS line FROM f WHERE NOT fence AND fences % 2 = 0 AND trim(line) != ''),
t AS (SELECT doc, section, trim(regexp_replace(string_agg(line, ' ' ORDER BY n), '\s+', ' ', 'g')) AS text FROM g GROUP BY doc, section)
SELECT doc, section, CASE WHEN length(text) > 700 THEN rtrim(substr(text, 1, 699)) || '…' ELSE text END AS text FROM t WHERE text != ''""")
def fn19_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.sections(_marked(spark, sf_dir))


# --- timing -----------------------------------------------------------------------------

_KINDS = [*render.TIMING_KINDS, "odd"]
_FLOWS = f"""WITH e AS (SELECT user_id::VARCHAR AS graph, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS flow, event_id AS pos, {_list(_KINDS)}[1 + event_id % {len(_KINDS)}] AS kind,
CASE WHEN event_id % 3 > 0 THEN event_type END AS target, CASE WHEN event_id % 4 = 0 THEN 'at ' || (event_id % 9) END AS detail, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS number FROM events),
f AS (SELECT DISTINCT graph, flow, 'user ' || flow AS owner, graph::BIGINT % 2 = 0 AS is_async FROM e)"""


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A flow for each user and day, a graph for each user; events are of all kinds by turns."""
    key, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    user = F.col("user_id").cast("string")
    events = table(spark, sf_dir, "events").select(user.alias("graph"), F.concat(user, F.lit(":"), day).alias("flow"), "ts", key.alias("pos"), _one_of(_KINDS, key).alias("kind"), F.when(key % 3 > 0, F.col("event_type")).alias("target"), F.when(key % 4 == 0, F.concat(F.lit("at "), (key % 9).cast("string"))).alias("detail"))
    events = events.withColumn("number", F.row_number().over(Window.partitionBy("flow").orderBy("ts", "pos")).cast("long")).drop("ts")
    flows = events.select("graph", "flow").distinct().select("graph", "flow", F.concat(F.lit("user "), "flow").alias("owner"), (F.col("graph").cast("long") % 2 == 0).alias("is_async"))
    return flows, events


@query(f"{_FLOWS} SELECT graph, flow, 'user_' || replace(flow, ':', '_') AS name, owner, is_async FROM f")
def gn7_timing_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.charts(*_flows(spark, sf_dir))


@query(f"{_FLOWS} SELECT f.graph, count(DISTINCT f.flow) AS chart_count, count(DISTINCT f.flow) FILTER (WHERE is_async) AS async_flow_count, {', '.join(f'''count(*) FILTER (WHERE kind = '{k}') AS {k}_count''' for k in timing.COUNTED)} FROM f JOIN e ON e.flow = f.flow GROUP BY f.graph")
def ag6_timing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.statistics(*_flows(spark, sf_dir))


_ARROWS = ", ".join(f"('{k}', '{arrow}', '{sent}', '{noted}')" for k, (arrow, sent, noted) in render.TIMING_KINDS.items())


@query(f"""{_FLOWS}, a(kind, arrow, sent, noted) AS (VALUES {_ARROWS}), t AS (SELECT flow, target, 'p' || row_number() OVER (PARTITION BY flow ORDER BY target) AS box FROM (SELECT DISTINCT flow, target FROM e WHERE target IS NOT NULL)),
x AS (SELECT e.*, box, coalesce(e.detail, e.target, e.kind) AS shown, arrow, sent, coalesce(noted, e.kind) AS noted FROM e LEFT JOIN a ON a.kind = e.kind LEFT JOIN t ON t.flow = e.flow AND t.target = e.target),
ln AS (SELECT flow, 0 AS part, 0 AS p, '    participant p0 as "' || owner || '"' AS line FROM f UNION ALL SELECT flow, 1, substr(box, 2)::BIGINT, '    participant ' || box || ' as "' || target || '"' FROM t UNION ALL SELECT flow, 2, 0, '    Note over p0: async flow' FROM f WHERE is_async
UNION ALL SELECT flow, 3, number, CASE WHEN box IS NOT NULL AND arrow != '' THEN '    p0' || arrow || box || ': ' || number || '. ' || sent || ' ' || shown || CASE kind WHEN 'await' THEN chr(10) || '    ' || box || '-->>p0: resume' ELSE '' END ELSE '    Note over p0: ' || number || '. ' || noted || ' ' || shown END FROM x)
SELECT flow AS graph, 'sequenceDiagram' || chr(10) || string_agg(line, chr(10) ORDER BY part, p) || chr(10) AS text FROM ln GROUP BY flow""")
def rn7_timing_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows, events = _flows(spark, sf_dir)
    by_flow = lambda df: df.drop("graph").withColumnRenamed("flow", "graph")
    return render.timing_chart(by_flow(flows), by_flow(events.withColumn("pos", F.col("number"))))


# --- validation, outputs, tasks -----------------------------------------------------------

_GIVEN = "WITH e AS (SELECT user_id::VARCHAR AS graph, CASE WHEN event_id % 7 > 0 THEN event_type ELSE '' END AS src, CASE WHEN event_id % 11 > 0 THEN event_type || (event_id % 3) END AS dst, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'async' END AS kind, event_id AS pos FROM events), n AS (SELECT user_id::VARCHAR AS graph, CASE WHEN event_id % 13 > 0 THEN 'at ' || event_type END AS node FROM events)"


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as nodes and edges of users' graphs, some without names or ends."""
    key, user = F.col("event_id"), F.col("user_id").cast("string").alias("graph")
    events = table(spark, sf_dir, "events")
    nodes = events.select(user, F.when(key % 13 > 0, F.concat(F.lit("at "), "event_type")).alias("node"))
    return nodes, events.select(user, F.when(key % 7 > 0, F.col("event_type")).otherwise("").alias("src"), F.when(key % 11 > 0, F.concat("event_type", (key % 3).cast("string"))).alias("dst"), F.when(key % 4 == 0, "").when(key % 4 == 1, "async").alias("kind"), key.alias("pos"))


@query(f"{_GIVEN} SELECT graph, 'edge' AS row, pos, CASE WHEN src = '' AND dst IS NULL THEN 'no caller and no callee' WHEN src = '' THEN 'no caller' ELSE 'no callee' END AS reason FROM e WHERE src = '' OR dst IS NULL UNION ALL SELECT graph, 'node', NULL, 'no name' FROM n WHERE node IS NULL")
def gr2_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.validated(*_given(spark, sf_dir))[2]


@query(f"{_GIVEN}, k AS (SELECT graph, src, dst, coalesce(nullif(kind, ''), 'direct') AS kind FROM e WHERE src != '' AND dst IS NOT NULL), a AS (SELECT graph, src AS node FROM k UNION SELECT graph, dst FROM k UNION SELECT graph, node FROM n WHERE node IS NOT NULL) SELECT a.graph, node, coalesce(any_value(c), 0) AS calls, coalesce(any_value(d), 0) AS direct FROM a LEFT JOIN (SELECT graph, src, count(*) AS c, count(*) FILTER (WHERE kind = 'direct') AS d FROM k GROUP BY graph, src) x ON x.graph = a.graph AND x.src = a.node GROUP BY a.graph, node")
def gr2_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted nodes, with how many of the accepted edges leave them and how many of these are direct."""
    nodes, edges, _ = graph.validated(*_given(spark, sf_dir))
    sums = edges.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("calls"), F.count_if(F.col("kind") == "direct").alias("direct"))
    return nodes.join(sums, ["graph", "node"], "left").na.fill(0, ["calls", "direct"])


_FORMATS = [*outputs.EXTENSIONS, "other"]


@query(f"WITH o AS (SELECT p_partkey, string_split(p_type, ' ')[-1] || '/' || CASE WHEN p_size % 2 = 0 THEN p_brand || '/' ELSE '' END || string_split(p_type, ' ')[1] || {_list([*outputs.EXTENSIONS.values(), '.txt'])}[1 + p_size % {len(_FORMATS)}] AS path FROM part) SELECT p_partkey, path, count(*) OVER (PARTITION BY path) > 1 AS duplicate FROM o")
def sk5_output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_type", " ", -1).alias("category"), F.when(size % 2 == 0, F.array("p_brand")).alias("relative_dir"), F.substring_index("p_type", " ", 1).alias("name"), _one_of(_FORMATS, size).alias("format"))
    return outputs.output_paths(rows).select("p_partkey", "path", "duplicate")


_HEADS = [" Goal", "  required constraints ", " Acceptance", " Working Set", " Deferred", "Goal"]


@query("WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS g, doc_id % 3 = 0 AS r, doc_id % 5 > 0 AS a, doc_id % 7 > 0 AS w, doc_id % 11 = 0 AS o FROM documents) SELECT doc_id, g AND r AND a AND w AS ready, concat_ws(',', CASE WHEN NOT g THEN 'goal' END, CASE WHEN NOT r THEN 'required' END, CASE WHEN NOT a THEN 'acceptance' END, CASE WHEN NOT w THEN 'working_set' END) AS missing, o AS out_of_scope_present FROM d")
def ev13_exploration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks, below whose texts headings come by turns."""
    key = F.col("doc_id")
    shown = [key % 2 == 0, key % 3 == 0, key % 5 > 0, key % 7 > 0, key % 11 == 0, F.lit(True)]
    text = F.concat_ws("\n", "text", *[F.when(cond, F.lit("##" + head)) for cond, head in zip(shown, _HEADS)])
    status = table(spark, sf_dir, "documents").select("doc_id", outputs.exploration_status(text).alias("s"))
    return status.select("doc_id", "s.ready", F.array_join("s.missing", ",").alias("missing"), "s.out_of_scope_present")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR (o_orderkey % 3 = 0 AND o_orderpriority = '2-HIGH') THEN 10 WHEN o_orderpriority = '2-HIGH' THEN 20 WHEN o_orderkey % 3 = 0 THEN 10 WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 ELSE 50 END AS rank FROM orders")
def j18_label_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, ranked by their labels, then by their titles."""
    key = F.col("o_orderkey")
    labels = F.array_compact(F.array(F.concat(F.lit(" "), "o_orderpriority"), F.when(key % 3 == 0, "Blocker"), F.when(key % 5 == 0, "other")))
    title = F.when(key % 4 == 0, F.concat(F.lit("["), (key % 90).cast("string"), F.lit("] order")))
    return table(spark, sf_dir, "orders").select("o_orderkey", outputs.label_rank(labels, title, {"1-urgent": 10, "blocker": 10, "2-high": 20}, r"^\[(\d+)\]").cast("long").alias("rank"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS name FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def se6_unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with pending orders and without an urgent one."""
    rows = table(spark, sf_dir, "orders").withColumn("name", F.col("o_custkey").cast("string"))
    return outputs.unknown_names(rows.where("o_orderstatus = 'P'"), rows.where("o_orderpriority = '1-URGENT'"))


@query("""WITH t AS (SELECT conv_id::VARCHAR AS graph, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, lead(1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS more FROM conversations),
l AS (SELECT graph, 0 AS part, pos, '    act_t_' || pos || CASE role WHEN 'user' THEN '{' || role || '}' ELSE '[' || role || ']' END AS line FROM t UNION ALL SELECT graph, 1, pos, '    act_t_' || pos || ' -->' || CASE WHEN role = 'user' AND pos % 4 = 1 THEN '|Yes|' ELSE '' END || ' act_t_' || (pos + 1) FROM t WHERE more = 1)
SELECT graph, 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, pos) || chr(10) AS text FROM l GROUP BY graph""")
def rn9_activity_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as activities: a step for each turn, a decision where the user speaks."""
    by = Window.partitionBy("graph").orderBy(F.asc_nulls_last("turn"), "label", "text")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("graph"), "turn", F.col("role").alias("label"), "text")
    name = lambda n: F.concat(F.lit("t "), n.cast("string"))
    pos, user = F.col("pos"), F.col("label") == "user"
    steps = turns.withColumns({"pos": F.row_number().over(by), "more": F.lead(F.lit(1)).over(by)})
    nodes = steps.select("graph", name(pos).alias("node"), "label", F.when(user, "decision").otherwise("activity").alias("kind"), "pos")
    edges = steps.where("more = 1").select("graph", name(pos).alias("src"), name(pos + 1).alias("dst"), F.when(user & (pos % 4 == 1), "Yes").alias("label"), "pos")
    return render.activity_flowchart(nodes, edges)
