"""Operator 6: secret scans over an incremental blob ledger, with DataFrame operations only.

A text is a blob, named by its SHA-256; a row of documents is a path to a blob. The
ledger keeps what each rule version found in each blob. A scan reads only the pairs of
blob and rule version that the ledger lacks, appends them, and joins the ledger's
findings back to every path, so that a copy, or a version seen in an earlier run, costs
no scan.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.llm.common import materialize, table, whole_text
from facetgraph.sources.scratch import remove, shared_dir


@dataclass(frozen=True)
class SecretRule:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` has `least` characters. base: of the fixed set."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: In the order in which kinds that start together are listed. A run of 16 or more hex
#: digits (18 or more characters from AKIA on) is what is left of all runs when those
#: that are too short are dropped, so that the length stands in the pattern.
RULES = (
    SecretRule("assign", 1, "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    SecretRule("access", 1, "AKIA[A-Z0-9]{14,}", base=True),
    SecretRule("hex", 1, "[0-9a-f]{16,}", base=True),
    SecretRule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("hubtoken", 1, "gh[opsur]_[A-Za-z0-9]{36,}"),
    SecretRule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _hits(text: Column, rule: SecretRule) -> Column:
    """For each match: the characters since the last one, its own, and whether it is long enough. Null if none."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else matches
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("all"), checked.alias("part"))
    hits = F.transform(F.slice(parts, 1, F.size(matches)), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("len"), (F.length(x["part"]) >= rule.least).alias("ok")))
    return F.when(text.rlike(rule.pattern), hits)


def _unseen(blobs: DataFrame, past: DataFrame | None, rules: tuple[SecretRule, ...]) -> DataFrame:
    """One row (blob, text, todo) for each blob that some rule version has not read; todo holds those."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    todo = keys
    if past is not None:
        seen = past.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("__seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(keys, F.coalesce("__seen", F.array().cast("array<string>")))
    blobs = blobs.select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)
    return blobs.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("todo").alias("todo"))


def scan_new_blobs(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Appends to the ledger what is new in docs, and returns the ledger: (blob, rules, found)."""
    spark = docs.sparkSession
    try:
        past = spark.read.parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        past = None
    text = whole_text(text_col)
    blobs = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    found = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains("todo", r.key), _hits(F.col("text"), r)).alias("hits")) for r in rules])
    scans = _unseen(blobs, past, rules).select("blob", F.col("todo").alias("rules"), F.filter(found, lambda x: x["hits"].isNotNull()).alias("found"))
    scans.write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger)


def findings(ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, kind, start, end, __nth) of what the rules' current versions found; code points, end exclusive."""
    names = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(r.kind).alias("kind"), F.lit(i).alias("nth")))])
    each = ledger.select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin([r.key for r in rules]))
    # scans that ran at once, or again after a failure, may have listed a blob twice
    each = each.groupBy("blob", F.col("f.rule").alias("rule")).agg(F.any_value("f.hits").alias("hits"))
    each = each.select("blob", names[F.col("rule")].alias("r"), F.posexplode("hits").alias("pos", "h"))
    upto = F.sum(F.col("h.gap") + F.col("h.len")).over(Window.partitionBy("blob", "r.nth").orderBy("pos"))
    placed = each.select("blob", F.col("r.kind").alias("kind"), (upto - F.col("h.len")).alias("start"), upto.alias("end"), F.col("r.nth").alias("__nth"), F.col("h.ok").alias("ok"))
    return placed.where("ok").drop("ok")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Each row's id_col, counts by base kind, `base_sha256` and `spans` (kind:start:end).

    ledger: the folder of an earlier ledger, or of a new one; without one nothing is
    kept for later scans. Null text is the empty blob. Rows that share an id, or a text, each get their
    text's findings; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    folder = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = findings(scan_new_blobs(own, folder, "__text", rules), rules)
    found = materialize(found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "__nth", "end", "kind"))).alias("__found")), "findings")
    if not ledger:
        remove(spark, folder)
    paths = own.select("__id", F.unhex(F.sha2(whole_text("__text").cast("binary"), 256)).alias("blob"))
    rows = paths.join(found, "blob", "left").withColumn("__found", F.coalesce("__found", F.array().cast(found.schema["__found"].dataType)))
    base = [i for i, r in enumerate(rules) if r.base]
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda i: F.size(F.filter("__found", lambda x: x["__nth"] == i)).cast("long")
    return rows.select(
        F.col("__id").alias(id_col),
        *[of_kind(i).alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(shown(F.filter("__found", lambda x: x["__nth"].isin(base))), 256).alias("base_sha256"),
        shown(F.col("__found")).alias("spans"),
    )


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents against the ledger in the folder that spark.facetgraph.secrets.ledger names, if it is set."""
    return scan_secrets(table(spark, sf_dir, "documents"), ledger=spark.conf.get("spark.facetgraph.secrets.ledger", None))


def _sql() -> str:
    quote = lambda x: x.replace("'", "''")
    parts = " UNION ALL ".join(
        f"SELECT rid, {i} AS nth, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{quote(r.pattern)}') AS gaps, "
        f"regexp_extract_all(text, '{quote(r.pattern)}', 0) AS hits, regexp_extract_all(text, '{quote(r.pattern)}', {r.group}) AS parts FROM docs"
        for i, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({parts}),
each AS (
  SELECT rid, nth, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM matched WHERE len(hits) > 0
), placed AS (
  SELECT rid, nth, kind, length(parts[i]) >= least AS ok, length(hits[i]) AS n,
         sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY rid, nth ORDER BY i) AS stop
  FROM each
), spans AS (
  SELECT rid, nth, kind, CAST(stop - n AS BIGINT) AS start, kind || ':' || CAST(CAST(stop - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span FROM placed WHERE ok
), summed AS (
  SELECT rid, {counts}, string_agg(span, ',' ORDER BY start, nth) AS spans, string_agg(span, ',' ORDER BY start, nth) FILTER (WHERE kind IN ({base})) AS base FROM spans GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (rid)
"""


OP6_SQL = _sql()
