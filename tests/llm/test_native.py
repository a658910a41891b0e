"""Operators with SQL, on whole tables and on odd rows."""

import pytest

from facetgraph.llm import line_dedup, mixing, quality, secrets, sharding
from facetgraph.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"
ODD = [
    (1, None, None, None, 0, 7, "x"),
    (2, "", "en", "a", 0, 7, "x"),
    (None, "one two three", "en", "a", 13, 7, None),
    (None, "one two three", "en", "a", 13, 7, None),
    (3, "w " * 30000, "en", "b", 60000, 7, "x"),
    (3, "password = abcdefghijklmnop\nline\nline", "de", "a", 37, 7, "x"),
]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("operator", [mixing.mix_sources, mixing.mixed_documents, quality.quality_rules, quality.kept_documents, line_dedup.dedup_lines, line_dedup.without_boilerplate, sharding.shard_records, secrets.scan_secrets])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_rows_mix(odd):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 6 and all(0 <= r.taken <= 2 * r.size for r in rows)
    taken = {}
    for r in rows:
        taken.setdefault(r.source_size, [0, r.target])[0] += r.taken
    assert all(abs(t - target) <= 1 for t, target in taken.values())
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_odd_rows_quality(odd):
    rows = {(r.doc_id, r.n_words): r for r in quality.quality_rules(odd).collect()}
    assert rows[(1, 0)].base_failed and rows[(3, 30000)].n_repeat_words == 30000 and rows[(3, 5)].n_dup_lines == 1
    assert quality.kept_documents(odd).columns == odd.columns


def test_thresholds_follow_language_and_source(spark):
    signs = lambda n: " ".join(f"word{k}" + "#" * (n // 40 + (k < n % 40)) for k in range(40))
    docs = [(i, signs(60 + i % 7 if s == "code" else 3 + i % 5), "en", s) for i in range(120) for s in ("code", "news")]
    docs += [(900, signs(63), "en", "news"), (901, signs(9), "en", "news"), (902, signs(200), "en", "code"), (903, signs(63), "en", "new source")]
    out = {(r.doc_id, r.n_symbols): r.kept for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert out[(5, 65)] and out[(5, 3)] and not out[(900, 63)] and out[(901, 9)] and not out[(902, 200)]
    assert out[(903, 63)]  # a source of one document is judged by its language, which holds code


@pytest.mark.parametrize("number", [0, 1, 255, 256, 511, 40_000, 10**12])
def test_grid_is_fine_at_any_size(spark, number):
    step = spark.sql(f"SELECT {quality.grid_step(f'{number}L')}").first()[0]
    assert step <= number and (number - step) * 128 <= number


def test_thresholds_adapt_on_given_tables(spark):
    counts = quality.base_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).drop("text").cache()
    rows = quality.thresholds(quality.sketches(counts)).collect()
    assert len(rows) == 80
    for name in ("punctuation", "dup_lines", "word_length"):
        assert all(r[f"{name}_high"] is not None for r in rows) and len({r[f"{name}_high"] for r in rows}) >= 3
    # most English groups have their own thresholds of the measures that all documents have
    assert sum(r.punctuation_level == 0 for r in rows) >= 20 and len({r.punctuation_high for r in rows}) > 20
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").select("doc_id")
    good = quality.verdict(counts).join(labels, "doc_id").where("NOT base_failed").groupBy("kept").count().collect()
    good = {r.kept: r["count"] for r in good}
    counts.unpersist()
    assert good.get(False, 0) <= 0.005 * good[True]


def test_copies_do_not_make_boilerplate(spark):
    docs = [(i, "a long page\nof two lines", "en", "a") for i in range(50)] + [(100 + i, f"menu of the site\nown line {i}", "en", "a") for i in range(30)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert out[7] == "a long page\nof two lines" and out[103] == "own line 3"


def test_shards_move_into_the_new_one_only(odd):
    rows = sharding.shard_records(odd).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_ledger_scans_unseen_pairs_only(spark, odd, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = {(r.doc_id, r.spans) for r in secrets.scan_secrets(odd, ledger=ledger).collect()}
    assert (3, "assign:0:27") in first
    size = spark.read.parquet(ledger).count()
    again = odd.union(spark.createDataFrame([(9, "token: 0123456789abcdef0123", "en", "a", 1, 1, "")], SCHEMA))
    second = {(r.doc_id, r.spans) for r in secrets.scan_secrets(again, ledger=ledger).collect()}
    assert first <= second and (9, "assign:0:27,hex:7:27") in second
    assert spark.read.parquet(ledger).count() == size + 1


def test_ledger_of_a_setting_is_scanned_on(spark, same, data, tmp_path):
    """A first scan of some rows, then the query on the same ledger: only unseen blobs are read, findings are those of all."""
    ledger = f"{tmp_path}/ledger"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    secrets.scan_new_blobs(docs.where("doc_id < 90"), ledger)
    before = {bytes(r.blob) for r in spark.read.parquet(ledger).select("blob").collect()}
    spark.conf.set("spark.facetgraph.secrets.ledger", ledger)
    try:
        same(QUERIES["op6_secret_scans"], ORACLE_SQL["op6_secret_scans"])
    finally:
        spark.conf.unset("spark.facetgraph.secrets.ledger")
    after = [bytes(r.blob) for r in spark.read.parquet(ledger).select("blob").collect()]
    assert before < set(after) and len(after) == len(set(after)) == docs.select("text").distinct().count()
