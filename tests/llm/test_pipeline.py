"""The stages of the corpus pipeline on planted documents."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from facetgraph.llm import quality
from tests.llm.test_free import _brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


def test_boilerplate_of_a_minority_language(spark):
    rows = [(i, f"English page {i}\nmenu" if i < 40 else f"English page {i}", "en", "a") for i in range(200)]
    rows += [(1000 + i, f"page {i}\n" + ("mentions du site\n" if i < 8 else "") + ("bonjour\n" if i < 4 else "") + ("menu" if i == 9 else "fin " + str(i)), "fr", "a") for i in range(20)]
    rows += [(2000, "mentions du site\nseule", "de", "a"), (2001, "mentions du site\nseule", "fr", "b"), (2002, None, None, None)]
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup_stage(spark, documents(spark, rows), "").collect()}
    assert out[1003].text == "page 3\nbonjour\nfin 3" and out[1003].n_chars == len(out[1003].text)
    assert out[1007].text == "page 7\nfin 7"  # 8 of 20 French pages, under 4 % of the host's
    assert out[3].text == "English page 3" and out[1009].text == "page 9"  # a line of the whole host goes in every language
    assert out[2000].text == out[2001].text == "mentions du site\nseule" and out[2002].text is None


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_quality(rows):
    """The rows that stay: no base failure, and no measure beyond its fence."""
    judged = []
    for row in rows:
        text, words = row["text"] or "", words_of(row["text"])
        lines = [x for x in text.split("\n") if words_of(x)]
        at = defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i : i + 5])].append(i)
        covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
        chars = sum(map(len, words))
        measures = {"dup_lines": 1000 * (len(lines) - len(set(lines))) // max(len(lines), 1)}
        if len(words) >= 40:
            measures["punctuation"] = 10000 * sum(c in string.punctuation for c in text) // chars
            measures["word_length"] = 100 * chars // len(words)
        measures = {name: v >> max(0, v.bit_length() - 8) << max(0, v.bit_length() - 8) for name, v in measures.items()}
        judged.append((row, len(words) < 10 or 100 * len(covered) > 20 * len(words), measures))
    values = defaultdict(list)
    for row, _, measures in judged:
        for name, value in measures.items():
            if value or name != "dup_lines":
                for group in ((row["lang"], row["source"]), (row["lang"],), ()):
                    values[name, group].append(value)

    def fences(name, group):
        usual = sorted(values[name, group])
        if len(usual) < quality.LEAST_GROUP:
            return None, None
        low, mid, high = (usual[math.ceil(len(usual) * tenths / 10) - 1] for tenths in (1, 5, 9))
        fence = {"punctuation": 10, "dup_lines": 2.5, "word_length": 12}[name]
        return mid - fence * (high - mid) if high > mid and name == "word_length" else None, mid + fence * (mid - low) if mid > low else None

    stay = []
    for row, failed, measures in judged:
        for name, value in measures.items():
            levels = [fences(name, g) for g in ((row["lang"], row["source"]), (row["lang"],), ())]
            low, high = (next((x[i] for x in levels if x[i] is not None), None) for i in (0, 1))
            failed |= low is not None and value < low or high is not None and value > high
        if not failed:
            stay.append(row)
    return stay


def plain_lines(rows):
    """The rows, without lines common in their source or in their source's pages in their language."""
    pages, holding = defaultdict(set), Counter()
    for row in rows:
        for site in ((row["source"],), (row["source"], row["lang"])):
            pages[site].add(row["text"] or "")
    for site, texts in pages.items():
        holding.update((site, line) for text in texts for line in set(text.split("\n")) if words_of(line))
    common = lambda site, line: holding[site, line] >= 5 and holding[site, line] > 0.1 * len(pages[site])
    out = []
    for row in rows:
        lines = (row["text"] or "").split("\n")
        rest = [x for x in lines if not common((row["source"],), x) and not common((row["source"], row["lang"]), x)]
        text = "\n".join(rest)
        out.append(row if len(rest) == len(lines) else {**row, "text": text, "n_chars": len(text)})
    return out


def plain_mix(rows):
    """The rows as often as their source's budget takes them, the last one cut."""
    order = lambda source: (source is None, source or "")
    size, weight = Counter(), {}
    for row in rows:
        size[row["source"]] += len(words_of(row["text"]))
    for i, source in enumerate(sorted(size, key=order)):
        weight[source] = (3.0, 1.0, 2.0)[i % 3]
    target, left, weights = {}, 1.5 * sum(size.values()), sum(weight.values())
    for source in sorted(size, key=lambda s: (2 * size[s] / weight[s], order(s))):
        if left / weights <= 2 * size[source] / weight[source]:
            target |= {s: min(2.0 * size[s], left / weights * weight[s]) for s in size if s not in target}
            break
        target[source] = 2.0 * size[source]
        left, weights = left - target[source], weights - weight[source]
    out = []
    for source in size:
        own = [r for r in rows if r["source"] == source]
        key = lambda r: (hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), len(words_of(r["text"])))
        budget = math.floor(target[source] + 0.5)
        epochs, rest = divmod(budget, size[source]) if size[source] else (0, 0)
        for row in sorted(own, key=key):
            n = len(words_of(row["text"]))
            cut = max(0, min(n, rest))
            rest -= cut
            out += [row] * (epochs + (cut == n)) if n else [row]
            if 0 < cut < n:
                text = "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", row["text"])[:cut])
                out.append({**row, "text": text, "n_chars": len(text)})
    return out


def bag(rows):
    return Counter(tuple(sorted(r.items(), key=lambda x: x[0])) for r in rows)


def planted():
    rng = random.Random(11)
    vocabulary = {lang: [lang + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)] for lang in ("en", "fr", "?")}
    rows = []

    def add(i, text, lang, source):
        # columns that the stages have names like, too
        rows.append((i, text, lang, source, None if text is None else len(text), i and i % 7, f"k{i}", f"r{i}"))

    some = lambda lang, n: " ".join(rng.choice(vocabulary[lang or "?"]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    for i in range(150):
        lang, source = ("en", "fr", None)[(i % 10 > 6) + (i % 10 > 8)], ("a", "b", None)[(i % 7 > 3) + (i % 7 > 5)]
        text = some(lang, rng.randint(40, 90)) + "\n" + some(lang, 12)
        if lang == "fr" and i % 3:
            text += "\nmentions"
        if lang == "en" and i % 4 == 0:
            text = "menu of all\n" + text
        add(i, text, lang, source)
        if i % 12 == 0:
            add(1000 + i, text.replace(text.split()[-1], "other"), lang, "b")  # a near copy
        if i % 15 == 0:
            add(i, some(lang, 30 + i % 37), lang, source)  # an id twice
    for i in range(8):
        add(2000 + i, "the same notice on ten or more words which says it all", "en", f"s{i}" if i < 4 else "a")
    add(2100, "#" * 300 + some("en", 50), "en", "a")
    add(2101, "\n".join(["one line again"] * 9 + [some("en", 60)]), "en", "a")
    add(2102, "five words that come again " * 8, "en", "a")
    add(2103, " ".join("x" * 40 + str(k) for k in range(60)), "en", "b")
    for text in (None, "", "too short"):
        add(2200, text, "en", "a")
        add(None, text, None, None)
    add(None, some("en", 33), "en", "a")
    add(None, some("en", 44), "en", "a")
    return rows


def test_run_equals_plain_stages(spark, tmp_path, monkeypatch):
    rows = planted()
    spark.createDataFrame(rows, SCHEMA + ", size int, kept string, row string").write.parquet(str(tmp_path / "documents.parquet"))
    written, write = {}, corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, label: written.setdefault(label, write(df, label)))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    names = ["doc_id", "text", "lang", "source", "n_chars", "size", "kept", "row"]
    assert [f"stage-{name}" for name, _ in corpus_pipeline.STAGES[:-1]] == list(written) and corpus_pipeline.STAGES[-1][0] == "packing"
    assert all(df.columns == names for df in written.values())
    stage = {label[6:]: [r.asDict() for r in df.collect()] for label, df in written.items()}

    docs = [dict(zip(names, r)) for r in rows]
    assert bag(stage["quality_rules"]) == bag(plain_quality(docs))
    assert {2100, 2101, 2102, 2103, 2200}.isdisjoint(r["doc_id"] for r in stage["quality_rules"]) and len(stage["quality_rules"]) > 150
    assert bag(stage["line_dedup"]) == bag(plain_lines(stage["quality_rules"]))
    assert not any("mentions" in r["text"] for r in stage["line_dedup"] if r["source"] in ("a", "b"))
    before = stage["line_dedup"]
    roots, _ = _brute([r["text"] for r in before], 5, 80)
    group = defaultdict(list)
    for row, root in zip(before, roots):
        group[root].append(tuple(row.values()))
    kept = [tuple(r.values()) for r in stage["near_dedup"]]
    of = {row: root for root, members in group.items() for row in members}
    assert sorted(of[row] for row in kept) == sorted(group) and len(group) < len(before)
    mixed = plain_mix(stage["near_dedup"])
    assert bag(stage["mixing"]) == bag(mixed) and len(mixed) > len(kept)

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda r: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    want = Counter((r["doc_id"], 0, len(t), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in t)), len(t)) for r in mixed for t in [ids(r)])
    assert max(x[2] for x in want) < 512  # each document is one piece
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    fill = defaultdict(list)
    for p in pieces:
        fill[p.sequence_id].append((p.offset, p.length))
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
