"""Operator 2: quality rules with adaptive thresholds, with DataFrame operations only.

Each rule compares a measure of a document with what is usual for its language and
source. What is usual comes from mergeable quantile sketches: histograms of the measure
on a logarithmic integer grid, which are counted on the map side, added up by key, and
resolved to a grid step of less than one part in 128, at any size. A threshold stands
`fence` spreads beyond the median; the upper one takes the distance from the tenth
percentile to the median for a spread, the lower one that from the median to the
ninetieth, so that contamination on one side does not widen its own fence. A measure
that is zero in most documents is judged by the documents where it is not. Nothing is
rejected by a number, or a share, that is fixed beforehand: a group whose spread is zero,
or that has few documents, takes its language's threshold, then that of all documents,
and without a spread there either the rule rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.llm.common import WORD, group_key, join_by_key, materialize, table, whole_text


@dataclass(frozen=True)
class Rule:
    """measure: SQL over the base counts, a natural number. side: 1 rejects above the upper fence, -1 below the lower, 0 both.

    Documents of fewer than least_words words are not judged and not counted. With
    nonzero the percentiles are those of the documents whose measure is not zero.
    """

    name: str
    measure: str
    side: int
    fence: float
    least_words: int = 0
    nonzero: bool = False


#: ASCII signs that are neither letters nor digits: a measure that is zero almost nowhere, unlike that of symbols alone.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
RULES = (
    Rule("punctuation", "(10000 * n_punct) div greatest(word_chars, 1)", 1, 10.0, 40),
    Rule("dup_lines", "(1000 * n_dup_lines) div greatest(n_lines, 1)", 1, 2.5, nonzero=True),
    Rule("word_length", "(100 * word_chars) div greatest(n_words, 1)", 0, 12.0, 40),
)
#: Groups of fewer documents take their language's threshold, and small languages that of all documents.
LEAST_GROUP = 60


def grid_step(number: str) -> str:
    """SQL of a natural number cut to its eight leading binary digits."""
    cut = f"greatest(0, length(bin({number})) - 8)"
    return f"shiftleft(shiftright({number}, {cut}), {cut})"


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_punct, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Five-word windows are compared by a 64-bit hash within their document. Only a text
    that has equal windows sorts them to find which words they cover, so that the work
    is n log n in the length of a text. Null text counts as empty.
    """
    text = whole_text(text_col)
    spaces = F.lit(r"[\x20\x09-\x0D]")
    docs = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    docs = docs.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    docs = docs.withColumn("n_words", F.size("__words").cast("long"))
    docs = docs.withColumn("__coded", F.transform("__words", lambda w: F.xxhash64(w)))
    after = lambda i, k: F.get("__coded", i + k)
    windows = F.transform("__coded", lambda w, i: F.xxhash64(w, after(i, 1), after(i, 2), after(i, 3), after(i, 4)))
    docs = docs.withColumn("__windows", F.slice(windows, 1, F.greatest(F.lit(0), F.size("__coded") - 4)))
    return docs.select(
        *[c for c in docs.columns if c not in ("__words", "__lines", "__coded", "__windows")],
        (F.length(text) - F.length(F.regexp_replace(text, spaces, F.lit("")))).alias("__space_chars"),
        F.length(text).alias("__chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(PUNCTUATION)).cast("long").alias("n_punct"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.lit(0)).otherwise(_covered("__windows")).cast("long").alias("n_repeat_words"),
    ).withColumns(
        {
            "word_chars": (F.col("__chars") - F.col("__space_chars")).cast("long"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    ).drop("__chars", "__space_chars")


def _covered(windows: str) -> Column:
    """Words within the five-word windows that occur twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, k: F.coalesce(F.get(s, k)["h"], F.lit(None))

    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: x["h"].eqNullSafe(F.when(k > 0, same(s, k - 1))) | x["h"].eqNullSafe(same(s, k + 1)))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def union(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5)))), F.lit(0), lambda a, b: a + b)

    # each intermediate array is bound once, as the element of an array of one
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return bound(placed, lambda s: bound(repeated(s), union))


def sketches(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(__lang, __source, rule, bin, n): a histogram of each rule's measure for each language and source.

    Sketches add up: those of two sets of documents, summed by key, are the sketch of both.
    """
    measured = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.when(_judged(r), F.expr(grid_step(r.measure))).alias("bin")) for r in rules])
    rows = counts.select(group_key("lang").alias("__lang"), group_key("source").alias("__source"), F.explode(measured).alias("m"))
    return rows.where("m.bin IS NOT NULL").groupBy("__lang", "__source", F.col("m.rule").alias("rule"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n"))


def _judged(rule: Rule) -> Column:
    judged = F.col("n_words") >= rule.least_words
    return judged & (F.expr(rule.measure) > 0) if rule.nonzero else judged


def thresholds(sketch: DataFrame, rules: tuple[Rule, ...] = RULES, least_group: int = LEAST_GROUP) -> DataFrame:
    """(__lang, __source, <rule>_low, <rule>_high, <rule>_level): the fences in force for each language and source, null where none is, and whose they are: 0 its own, 1 its language's, 2 those of all."""
    of = {r.name: r for r in rules}
    pick = lambda f: F.coalesce(*[F.when(F.col("rule") == n, F.lit(f(r))) for n, r in of.items()])

    def fences(keys: list[str]) -> DataFrame:
        bins = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        up = Window.partitionBy(*keys, "rule").orderBy("bin")
        bins = bins.withColumn("__upto", F.sum("n").over(up)).withColumn("__all", F.sum("n").over(Window.partitionBy(*keys, "rule")))
        at = lambda tenths: F.min(F.when(F.col("__upto") * 10 >= F.col("__all") * tenths, F.col("bin")))
        q = bins.groupBy(*keys, "rule").agg(F.max("__all").alias("n"), at(1).alias("p10"), at(5).alias("p50"), at(9).alias("p90")).where(F.col("n") >= least_group)
        low = F.when((pick(lambda r: r.side) <= 0) & (F.col("p90") > F.col("p50")), F.col("p50") - pick(lambda r: r.fence) * (F.col("p90") - F.col("p50")))
        high = F.when((pick(lambda r: r.side) >= 0) & (F.col("p50") > F.col("p10")), F.col("p50") + pick(lambda r: r.fence) * (F.col("p50") - F.col("p10")))
        return q.select(*keys, "rule", F.struct(low.alias("low"), high.alias("high")).alias(f"__{len(keys)}"))

    groups = sketch.select("__lang", "__source").distinct().select("*", F.explode(F.array(*[F.lit(n) for n in of])).alias("rule"))
    used = groups.join(fences(["__lang", "__source"]), ["__lang", "__source", "rule"], "left").join(fences(["__lang"]), ["__lang", "rule"], "left").join(fences([]), "rule", "left")
    first = lambda side: F.coalesce(*[F.col(f"__{i}")[side] for i in (2, 1, 0)])
    # the level of the upper fence, or of the lower one of a rule that has no other
    whose = F.coalesce(*[F.when(F.coalesce(F.col(f"__{i}.high"), F.col(f"__{i}.low")).isNotNull(), F.lit(2 - i)) for i in (2, 1, 0)])
    fenced = used.select("__lang", "__source", "rule", first("low").alias("low"), first("high").alias("high"), whose.alias("level"))
    side = lambda n, c: F.max(F.when(F.col("rule") == n, F.col(c))).alias(f"{n}_{c}")
    return fenced.groupBy("__lang", "__source").agg(*[side(n, c) for n in of for c in ("low", "high", "level")])


def verdict(counts: DataFrame, rules: tuple[Rule, ...] = RULES, least_group: int = LEAST_GROUP) -> DataFrame:
    """Adds `kept` to counts (see base_counts), which is read twice and so should be written already.

    A document fails a rule only beyond a fence; a measure that a short document lacks
    fails nothing. The thresholds are broadcast if they are few; else a hot source's rows
    are salted.
    """
    limits = thresholds(sketches(counts, rules), rules, least_group)
    rows = counts.withColumns({"__lang": group_key("lang"), "__source": group_key("source")})
    rows = join_by_key(rows, limits, ["__lang", "__source"], F.lit(3 * len(rules)), F.struct("n_words", "word_chars"))
    out = F.lit(False)
    for r in rules:
        value = F.expr(grid_step(r.measure))
        beyond = F.coalesce(value < F.col(f"{r.name}_low"), F.lit(False)) | F.coalesce(value > F.col(f"{r.name}_high"), F.lit(False))
        out = out | ((F.col("n_words") >= r.least_words) & beyond)
    return rows.withColumn("kept", ~F.col("base_failed") & ~out).drop("__lang", "__source", *[f"{r.name}_{c}" for r in rules for c in ("low", "high", "level")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col, the base counts, `base_failed` and `kept` for each row of docs (with lang and source).

    Null text is an empty text and fails the base. Null languages and sources are groups
    of their own. Rows that share an id are judged one by one; other columns are ignored;
    no rows give no rows.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), "lang", "source")
    counts = materialize(base_counts(own, "__text").drop("__text"), "quality-counts")
    return verdict(counts, rules).select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"), "lang", "source")
    counts = materialize(base_counts(own, "__text").drop("__text"), "quality-rows")
    return verdict(counts, rules).where("kept").select("__row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, lang IS NULL AS no_lang, coalesce(source, '') AS source, source IS NULL AS no_source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5
), hashed AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM wins
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM hashed) WHERE c >= 2
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), counts AS (
  SELECT words.rid, doc_id, lang, no_lang, source, no_source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) AS BIGINT) AS n_punct, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (rid)
), base AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
), raw AS (
  SELECT rid, lang, no_lang, source, no_source, 'punctuation' AS rule, (10000 * n_punct) // greatest(word_chars, 1) AS v FROM base WHERE n_words >= 40
  UNION ALL SELECT rid, lang, no_lang, source, no_source, 'dup_lines', (1000 * n_dup_lines) // greatest(n_lines, 1) FROM base WHERE (1000 * n_dup_lines) // greatest(n_lines, 1) > 0
  UNION ALL SELECT rid, lang, no_lang, source, no_source, 'word_length', (100 * word_chars) // greatest(n_words, 1) FROM base WHERE n_words >= 40
), measured AS (
  SELECT rid, lang, no_lang, source, no_source, rule, (v >> greatest(0, length(bin(v)) - 8)) << greatest(0, length(bin(v)) - 8) AS bin FROM raw
), rules(rule, side, fence) AS (VALUES ('punctuation', 1, 10.0::DOUBLE), ('dup_lines', 1, 2.5::DOUBLE), ('word_length', 0, 12.0::DOUBLE)),
usual AS (
  SELECT 2 AS level, lang, no_lang, source, no_source, rule, count(*) AS n, quantile_disc(bin, 0.1) AS p10, quantile_disc(bin, 0.5) AS p50, quantile_disc(bin, 0.9) AS p90 FROM measured GROUP BY ALL
  UNION ALL SELECT 1, lang, no_lang, NULL, NULL, rule, count(*), quantile_disc(bin, 0.1), quantile_disc(bin, 0.5), quantile_disc(bin, 0.9) FROM measured GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, NULL, NULL, rule, count(*), quantile_disc(bin, 0.1), quantile_disc(bin, 0.5), quantile_disc(bin, 0.9) FROM measured GROUP BY ALL
), fences AS (
  SELECT level, lang, no_lang, source, no_source, rule,
         CASE WHEN side <= 0 AND p90 > p50 THEN p50 - fence * (p90 - p50) END AS low, CASE WHEN side >= 0 AND p50 > p10 THEN p50 + fence * (p50 - p10) END AS high
  FROM usual JOIN rules USING (rule) WHERE n >= 60
), failed AS (
  SELECT DISTINCT m.rid FROM measured m
  LEFT JOIN fences o ON o.level = 2 AND o.rule = m.rule AND o.lang = m.lang AND o.no_lang = m.no_lang AND o.source = m.source AND o.no_source = m.no_source
  LEFT JOIN fences l ON l.level = 1 AND l.rule = m.rule AND l.lang = m.lang AND l.no_lang = m.no_lang
  LEFT JOIN fences a ON a.level = 0 AND a.rule = m.rule
  WHERE m.bin < coalesce(o.low, l.low, a.low) OR m.bin > coalesce(o.high, l.high, a.high)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM failed) AS kept FROM base
"""
