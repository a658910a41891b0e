"""Rules on continuous-integration workflows: steps(graph, job, i, name?, command?, action?) and jobs(graph, job, needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a step's text holds if it tests, and if it builds.
TEST_WORDS = ("test", "pytest", "unittest")
BUILD_WORDS = ("build", "package", "compile")


def marked_steps(steps: DataFrame) -> DataFrame:
    """steps with is_test and is_build, by the lower-case text of name, command and action."""
    text = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "command", "action") if c in steps.columns]))
    return steps.withColumns({"is_test": text.rlike("|".join(TEST_WORDS)), "is_build": text.rlike("|".join(BUILD_WORDS))})


def test_before_build(steps: DataFrame) -> DataFrame:
    """(graph, job, tests, builds, tested_first): what a job does, and whether its first build step is a test too or comes after one."""
    first = lambda c: F.min(F.when(F.col(c), F.col("i")))
    jobs = marked_steps(steps).groupBy("graph", "job").agg(first("is_test").alias("t"), first("is_build").alias("b"))
    return jobs.select("graph", "job", F.col("t").isNotNull().alias("tests"), F.col("b").isNotNull().alias("builds"), F.coalesce(F.col("t") <= F.col("b"), F.lit(False)).alias("tested_first"))


def known_needs(jobs: DataFrame) -> DataFrame:
    """(graph, job, need): the needs that are jobs of the workflow; need is null for a job without any, which the trigger starts."""
    wanted = jobs.select("graph", "job", F.explode_outer("needs").alias("need"))
    real = wanted.join(jobs.select("graph", F.col("job").alias("need")).distinct(), ["graph", "need"], "left_semi").select("graph", "job", "need").distinct()
    roots = jobs.select("graph", "job").distinct().join(real, ["graph", "job"], "left_anti").select("graph", "job", F.lit(None).cast("string").alias("need"))
    return real.union(roots)


def untested_builds(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """(graph, job) of the jobs that build, need no job that tests, and do not test first, in workflows that test at all."""
    done = test_before_build(steps)
    tests = done.where("tests").select("graph", F.col("job").alias("need"))
    after = jobs.select("graph", "job", F.explode("needs").alias("need")).join(tests, ["graph", "need"], "left_semi").select("graph", "job")
    builds = done.where("builds AND NOT tested_first").select("graph", "job")
    return builds.join(tests.select("graph").distinct(), "graph", "left_semi").join(after, ["graph", "job"], "left_anti")


def repeated_commands(steps: DataFrame) -> DataFrame:
    """(graph, command, jobs): trimmed commands that stand on more than one step, with the sorted jobs, one for each step."""
    grouped = steps.where("command != ''").groupBy("graph", F.trim("command").alias("command"))
    return grouped.agg(F.sort_array(F.collect_list("job")).alias("jobs")).where(F.size("jobs") > 1)


def findings(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """(graph, code, severity, message) for each workflow of jobs."""
    text = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
    tested = test_before_build(steps).where("tests").select("graph").distinct()
    missing = jobs.select("graph").distinct().join(tested, "graph", "left_anti").select("graph", F.lit("missing-test").alias("code"), F.lit("error").alias("severity"), F.lit("No CI step appears to run tests.").alias("message"))
    builds = untested_builds(steps, jobs).select("graph", F.lit("build-without-test-dependency"), F.lit("warning"), text("Build job '", F.col("job"), "' is not preceded by tests in the same job and does not depend on a test job."))
    repeats = repeated_commands(steps).select("graph", F.lit("duplicate-command"), F.lit("warning"), text("Command '", F.col("command"), "' is repeated in jobs: ", F.array_join("jobs", ", "), "."))
    return missing.union(builds).union(repeats)
