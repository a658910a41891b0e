import pytest

from facetgraph.functions import names, text
from facetgraph.operators import graph, quality
from facetgraph.plans.queries import ORACLE_SQL, QUERIES


#: These work on the same partitions or cycles as others that are tested here, and take long; all queries are compared at each round's end.
REPEATED = {"j15_boundary_references", "ag4_series_statistics", "ev1_order_metrics", "ev3_class_cycles", "gr14_boundary_edges", "gr13_series_entries", "ev5_series_findings", "ag3_class_graph_counts", "gr22_cycle_edges", "rn5_package_diagrams"}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - REPEATED))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry_imports(spark, data):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["node", "fan_in", "fan_out"]


def test_fan_counts_distinct_ends_and_self_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string")
    assert {tuple(r) for r in graph.fan_in_out(edges).collect()} == {("a", 0, 1), ("b", 1, 1), ("c", 2, 1)}


def test_thresholds_are_validated():
    for wrong in ({"high_fan_in": 0}, {"large_series": 0}, {"high_cross_series_ratio": 1.1}, {"high_cross_series_ratio": float("nan")}):
        with pytest.raises(ValueError):
            quality.Thresholds(**wrong)


def test_names(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Worker.state", "Customer#01", "Panel.on_save_clicked", None), ("###", "HTTPServer_v2Go", "on_a__b", " \t Open\n"), ("x" * 90 + "_", "_", "handle", "")], "n string, w string, h string, label string")
    got = rows.select(names.stable_output_name("state", F.col("n"), "state"), F.array_join(names.name_words(F.col("w")), " "), text.use_case_name(F.col("label"), F.col("h"))).collect()
    assert [tuple(r)[1:] for r in got] == [("customer#01", "Save"), ("httpserver v2 go", "Open"), ("", "User action")]
    assert got[0][0] == "state_60f8674639_Worker_state" and got[1][0].endswith("_state") and got[2][0].endswith("_" + "x" * 80)


def test_texts(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        text.responsibility(F.lit(None).cast("string"), F.array(F.lit("service")), F.array(F.lit("Process"))).alias("a"),
        text.responsibility(F.lit(" First.\nMore"), F.array(F.lit("x")), F.array().cast("array<string>")).alias("b"),
        text.service_kind(F.lit("my-Postgres"), F.lit("redis")).alias("c"),
        F.array_join(text.context_references(F.lit("secrets.B secrets['A-1'] env.C xsecrets.D"), "secrets"), ",").alias("d"),
        F.array_join(text.base_images(F.lit("from --platform=x a:1 AS b\n#FROM c\nFROM\n FROM d")), ",").alias("e"),
    ).first()
    assert tuple(row) == ("Coordinates service processing.", "First.", "database", "A-1,B", "a:1,d")


def test_event_steps_are_taken_by_day(spark, tmp_path):
    from datetime import datetime, timedelta

    from facetgraph.sources.tables import event_steps

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i * i % 977), 1, f"t{i % 5}" if i % 11 else None) for i in range(300)]
    rows += [(500 + i, start + timedelta(hours=23 * i), None, f"n{i}") for i in range(6)]
    rows += [(600, None, 2, "first"), (601, start, 2, "a"), (602, start, 2, "b"), (603, start + timedelta(days=400), 2, "late"), (604, start, 3, "only")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    want = []
    for user in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] or datetime.min, r[0]))
        want += [(user, a[0], a[3], b[3]) for a, b in zip(own, own[1:]) if b[3] is not None]
    steps = event_steps(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, steps.collect()))) == sorted(map(str, want))
    windows = [x for x in steps._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [lead(src" in x]
    assert windows and all("__day" in x for x in windows)
