"""Workflow facts: known answers, fields of two types, odd documents, words of commands against a plain reading."""

import json
import re

import pytest
from pyspark.sql import functions as F

from facetgraph.operators import ci

FILE = {
    "name": "Contract",
    "on": ["push", "pull_request", 3],
    "env": {"Z": "${{ secrets.TOP }}", "A": "${{ env.B }}"},
    "jobs": {
        "test": {
            "defaults": {"run": {"working-directory": "./work/"}},
            "env": {"K": "${{ secrets['J-1'] }}"},
            "strategy": {"fail-fast": False, "max-parallel": 2, "matrix": {"os": ["a", 3, {"x": 1}, None], "none": [], "x": "no", "include": [{"os": "b", "deep": [1]}, 4, {"v": True}]}},
            "steps": [
                {"name": "Tests", "run": "python -m pytest tests/unit/test_service.py 'a b.py' --x=1 $HOME/x http://a/b tests", "env": {"Q": 1, "B": "${{ secrets.S1 }} env.secret secrets.secrets"}},
                {"uses": "actions/cache@v4", "with": {"path": " a\n\n b c ", "key": "k"}, "continue-on-error": True, "timeout-minutes": 1.5},
                {"uses": "./local/act", "working-directory": "$X", "timeout-minutes": "${{ 3 }}", "if": "always()"},
                {"shell": "none"},
                "text",
            ],
        },
        "build": {"needs": ["test", "gone", 1], "name": "Build it", "continue-on-error": "x", "steps": [{"uses": "actions/upload-artifact@v4", "with": {"name": "n", "path": ["p", " ", 1]}}, {"name": "Build", "run": "python -m build"}]},
        "all": {"needs": "build", "strategy": {"matrix": "${{ fromJSON(x) }}"}},
        "bad": 3,
    },
}


@pytest.fixture(scope="module")
def files(spark):
    odd = {"null": None, "empty": " ", "array": "[]", "broken": "{", "jobs": '{"jobs": [1]}', "nojobs": '{"true": {"push": 1, "a": 2}, "jobs": null}'}
    return spark.createDataFrame([("f", json.dumps(FILE)), *odd.items()], "graph string, json string").cache()


def test_workflows(files):
    got = {r["graph"]: tuple(r)[1:] for r in ci.workflows(files).collect()}
    assert got["f"] == ("Contract", ["push", "pull_request"], ["Z", "A"], ["B"], ["TOP"], None)
    assert got["null"] == got["empty"] == (None, [], [], [], [], None) and got["nojobs"] == (None, ["push", "a"], [], [], [], None)
    assert {g: r[-1] for g, r in got.items() if r[-1]} == {"array": "workflow root must be a mapping", "broken": "workflow root must be a mapping", "jobs": "jobs must be a mapping"}


def test_jobs_and_matrices(files):
    got = [tuple(r) for r in ci.jobs(files).orderBy("job_pos").drop("job_pos").collect()]
    assert got == [
        ("f", "test", None, [], None, None, None, "false", "2", None, ["K"], [], ["J-1"]),
        ("f", "build", "Build it", ["test", "gone"], None, '"x"', None, None, None, None, [], [], []),
        ("f", "all", None, ["build"], None, None, None, None, None, "${{ fromJSON(x) }}", [], [], []),
    ]
    cells = sorted((tuple(r)[2:] for r in ci.matrix_values(files).collect()), key=str)
    assert cells == sorted([("axis", None, "os", 0, '"a"'), ("axis", None, "os", 1, "3"), ("axis", None, "os", 2, "null"), ("axis", None, "none", -1, None), ("include", 0, "os", 0, '"b"'), ("include", 1, "v", 0, "true")], key=str)


def test_steps_hints_and_chart(files):
    steps = ci.steps(files)
    got = [tuple(r)[2:] for r in steps.orderBy("job_pos", "step_pos").collect()]
    assert [(g[0], g[2]) for g in got] == [("test", "Tests"), ("test", "uses"), ("test", "uses"), ("build", "uses"), ("build", "Build")]
    assert [g[5] for g in got] == [["work", "tests/unit/test_service.py", "a b.py", "tests"], ["work"], ["local/act"], [], []]
    assert got[0][9:12] == (["Q", "B"], ["secret"], ["S1", "secrets"]) and [g[6:9] for g in got[1:3]] == [(None, "true", None), ("always()", None, '"${{ 3 }}"')]
    assert [g[12:] for g in got] == [(None,) * 4, ("cache", None, "k", ["a", "b c"]), (None,) * 4, ("artifact-upload", "n", None, ["p"]), (None,) * 4]
    hints = [tuple(r)[1:4] for r in ci.path_hints(steps).orderBy("job_pos", "step_pos", "path_pos").collect()]
    assert hints == [("test", "Tests", p) for p in got[0][5]] + [("test", "uses", "work"), ("test", "uses", "local/act")]
    charts = {r["graph"]: r["text"] for r in ci.workflow_chart(ci.workflows(files), ci.jobs(files), steps).collect()}
    assert charts["f"] == 'flowchart LR\n    ci_trigger["push, pull_request"]\n    ci_test["test<br/>Tests<br/>uses<br/>uses"]\n    ci_build["build<br/>uses<br/>Build"]\n    ci_all["all"]\n    ci_trigger --> ci_test\n    ci_test --> ci_build\n    ci_build --> ci_all\n'
    assert charts["empty"] == 'flowchart LR\n    ci_trigger["workflow"]\n' and "broken" not in charts


def test_words_against_a_plain_reading(spark):
    words = ["./", ".", "..", "../x", ".\\a\\b", "a.py", ".py", "a.py.", "A.PY", "x/.py", "src", "SRC/", "a:b", "a:b/c", "a:b/c.go", "*", "a?", "[x]", "(a/b);", "-x/y", "$x/y", "://", "'q'", "\"'a.c'\"", ",;", "//", "a//", "héé/x", "plain", "./lib", "lib,", "(tools)"]

    def plain(word):
        raw = word.strip().strip("\"'").strip("(),;")
        if not raw or raw[0] in "-$" or "://" in raw:
            return None
        path = raw.replace("\\", "/")
        path = (path[2:] if path.startswith("./") else path).rstrip("/") or "."
        last = path.rsplit("/", 1)[-1]
        dot = last.rfind(".")
        suffix = last[dot:].lower() if 0 < dot < len(last) - 1 else ""
        looks = path == "." or raw.startswith(("./", "../")) or ("/" in path and ":" not in path) or re.search(r"[*?\[]", path)
        return path if looks or path.lower() in ci.PROJECT_DIRECTORIES or suffix in ci.PATH_SUFFIXES else None

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.get(ci.path_hints_of(F.array("w")), 0).alias("p")).collect()
    assert {r["w"]: r["p"] for r in rows} == {w: plain(w) for w in words}
