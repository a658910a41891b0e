"""Comments: known answers, round trips, line ends, refused places, against a plain insertion."""

import random

from facetgraph.operators import comments

ENTITY = "path string, ord long, kind string, name string, line int, indent int, docstring string, calls array<string>"


def test_candidates(spark):
    rows = [("class", "ReportBuilder", 1, None, None, None), ("method", "build_report", 2, 4, "", None), ("function", "loadConfig", 8, 0, None, []), ("function", "documented", 10, 0, "Told.", None), ("function", "handle_event", 12, None, None, ["dispatch"]), ("branch", "if_ready", 14, 0, None, None), ("function", "get", 3, 0, None, None), ("method", "___", 3, 0, None, None), ("function", None, 1, 0, None, None), ("method", "x", 0, 0, None, None), ("method", "y", 1, -1, None, None), (None, "z", 1, 0, None, None)]
    got = comments.candidates(spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], ENTITY)).orderBy("ord").collect()
    assert [(r["target"], r["name"], r["line"], r["indent"], r["text"]) for r in got[:6]] == [
        ("class", "ReportBuilder", 1, "", "report builderに関する状態と処理をまとめます。"),
        ("method", "build_report", 2, "    ", "reportを構築します。"),
        ("function", "loadConfig", 8, "", "configを読み込みます。"),
        ("function", "handle_event", 12, "", "handle eventの処理を実行し、関連処理を連携させます。"),
        ("function", "get", 3, "", "処理を取得します。"),
        ("method", "___", 3, "", "___の処理を行います。"),
    ]
    assert [r["error"] for r in got[6:]] == ["a declaration has no name", "no such place: x", "no such place: y"] and all(r["text"] is None for r in got[6:])


def test_insertion_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(comments, "BLOCK", 7)
    rng = random.Random(5)
    files, notes, want = [], [], {}
    for i in range(60):
        text = "".join(rng.choice(["a = 1", "  b", "", " \t", "　", "c\rd"]) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rng.randrange(40))) + rng.choice(["", "end", " "])
        language, path = rng.choice(["python", "go", "go", "cobol" if i % 9 == 0 else "java"]), f"f{i}"
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + lines[-1:]
        good = [n for n, x in enumerate(lines, 1) if x.strip()]
        own = [(path, k, f"n{k}", rng.choice(good), " " * rng.randrange(3), f"text {k}", None) for k in range(rng.randrange(6))] if good else []
        if i % 10 == 3:
            own.insert(rng.randrange(len(own) + 1), (path, 50, "bad", rng.choice([0, len(lines) + 1]), "", "t", None))
        if i % 10 == 4:
            own.append((path, 60, "bad", good[0] if good else 1, "", rng.choice(["", "x\ny", "x\r", None]), None))
        sign = comments.COMMENT_SIGNS.get(language)
        files.append((path, language, text))
        notes += own
        if sign is None:
            want[path] = (None, f"no comments for the language {language}")
        elif bad := [n for n in sorted(own, key=lambda n: n[1]) if n[2] == "bad"]:
            line = bad[0][3]
            why = "outside the source" if not 1 <= line <= len(lines) else "at an empty line" if not lines[line - 1].strip() else "no text of one line"
            want[path] = (None, f"{why}: bad")
        else:
            out = ""
            for n, x in enumerate(lines, 1):
                for note in sorted((c for c in own if c[3] == n), key=lambda c: c[1]):
                    out += f"{note[4]}{sign} {note[5]}" + ("\r\n" if x.endswith("\r\n") else "\n")
                out += x
            want[path] = (out, None)
    files.append(("null", "go", None))
    want["null"] = ("", None)
    got = comments.commented(spark.createDataFrame(files, "path string, language string, text string"), spark.createDataFrame(notes, "path string, ord long, name string, line int, indent string, text string, error string"))
    assert {r["path"]: (r["text"], r["error"]) for r in got.collect()} == want
    assert comments.commented(spark.createDataFrame(files, "path string, language string, text string"), spark.createDataFrame([], "path string, ord long, name string, line int, indent string, text string, error string")).where("error IS NULL").count() == sum(f[1] in comments.COMMENT_SIGNS for f in files)
