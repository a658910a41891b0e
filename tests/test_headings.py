"""Headings, sections and timing charts: against plain readings over block ends, and known answers."""

import random
import re

from facetgraph.operators import headings, render, timing


def _clean(lines, limit):
    out, code = [], False
    for line in map(str.strip, lines):
        if line.startswith("```"):
            code = not code
        elif line and not code:
            line = re.sub(r"^\d+[.)]\s+", "", re.sub(r"^[-*+]\s+", "", line))
            out.append(re.sub(r"\[(.*?)\]\([^)]*\)", r"\1", re.sub(r"^- \[[ xX]\]\s*", "", line)))
    text = re.sub(r"\s+", " ", " ".join(out)).strip()
    return text if len(text) <= limit else text[: limit - 1].rstrip() + "…"


def _sections(text, limit):
    found, now = {}, None
    for line in text.splitlines():
        if m := re.match(r"^#{1,6}\s+(.+?)\s*$", line.strip()):
            now = next((name for name, words in headings.SECTIONS if any(w in m.group(1).lower() for w in words)), None)
        elif now:
            found.setdefault(now, []).append(line)
    return {k: t for k, v in found.items() if (t := _clean(v, limit))}


def test_against_a_plain_reading(spark, monkeypatch):
    monkeypatch.setattr(headings, "BLOCK", 5)
    rng = random.Random(3)
    bits = ["# Goal", "## Out of Scope ", " ### Acceptance and goal", "# 要件", "##### x", "#Goal", "#  ", "####\tdeep  title ", "```", "``` py", "- item [a](b) c", "* - [x] done", "12. twelve", "- [ ] open", "plain  text　 x", "", "  ", "q" * 50]
    texts = ["".join(rng.choice(bits) + rng.choice(["\n", "\n", "\r\n", "\r", "\u2028"]) for _ in range(rng.choice([0, 3, 40]))) + rng.choice(["", "end"]) for _ in range(50)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc long, text string")
    got = {}
    for r in headings.sections(docs, 60).collect():
        got.setdefault(r["doc"], {})[r["section"]] = r["text"]
    assert got == {i: s for i, t in enumerate(texts) if (s := _sections(t, 60))}
    index = sorted(tuple(r) for r in headings.heading_index(docs).collect())
    assert index == [(i, n, len(m.group(1)), m.group(2)) for i, t in enumerate(texts) for n, x in enumerate(t.splitlines(), 1) if (m := re.match(r"^(#{1,4})\s+(.+?)\s*$", x))]
    bodies = {r["doc"]: r["text"] for r in headings.compact_bodies(docs, 60).collect()}
    plain = lambda t: _clean([re.sub(r"^#{1,6}\s*", "", x) for x in t.splitlines()], 60) or "No usable description provided." if t else "No description provided."
    assert bodies == {**{i: plain(t) for i, t in enumerate(texts)}, 99: "No description provided."}


def test_timing(spark):
    flows = spark.createDataFrame([("m", "a", "Worker.load-data", True), ("m", "e", "empty", False), ("n", "x", "...", True)], "graph string, flow string, owner string, is_async boolean")
    events = spark.createDataFrame([("m", "a", 0, 2, "await", "fetch", "timeout=1"), ("m", "a", 1, 1, "callback", "done", None), ("m", "a", 2, 3, "parallel_start", None, None), ("m", "a", 3, 4, "parallel_join", "", ""), ("m", "a", 4, 5, "call", "fetch", 'a"b'), ("m", "a", 5, 6, "odd", "done", "x\ny"), ("m", "a", 6, 7, "sync_wait", None, "l"), ("m", "a", 7, 8, "timer", None, None)], "graph string, flow string, pos int, number int, kind string, target string, detail string")
    assert [tuple(r) for r in timing.charts(flows, events).collect()] == [("m", "a", "Worker.load-data", "Worker.load-data", True)]
    got = {r["graph"]: r.asDict() for r in timing.statistics(flows, events).collect()}
    ones = {"chart_count", "async_flow_count", "await_count", "parallel_start_count", "parallel_join_count", "callback_count", "timer_count"}
    assert {k for k, v in got["m"].items() if v == 1} == ones and set(got["n"].values()) == {"n", 0}
    text = render.timing_chart(flows.where("graph = 'm'").drop("graph").withColumnRenamed("flow", "graph"), events.drop("graph").withColumnRenamed("flow", "graph")).collect()
    assert [r["graph"] for r in text] == ["a"]
    assert text[0]["text"].split("\n") == [
        "sequenceDiagram",
        '    participant p0 as "Worker.load-data"',
        '    participant p1 as "done"',
        '    participant p2 as "fetch"',
        "    Note over p0: async flow",
        "    p0->>p2: 2. await timeout=1",
        "    p2-->>p0: resume",
        "    p0-)p1: 1. callback done",
        "    Note over p0: 3. parallel_start parallel_start",
        "    Note over p0: 4. join parallel_join",
        '    p0->>p2: 5. call a\\"b',
        "    Note over p0: 6. odd x y",
        "    Note over p0: 7. sync wait l",
        "    Note over p0: 8. timer timer",
        "",
    ]
