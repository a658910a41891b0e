"""Language identification: code lengths against a plain coder, odd rows, slices, held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetgraph.llm import language


class Plain:
    """A context tree in dictionaries, asked one byte at a time."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for text in texts:
            data = b"\n\n\n" + text.encode()
            for i in range(3, len(data)):
                for k in range(4):
                    self.after[data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data, out = b"\n\n\n" + text.encode(), 0.0
        for i in range(3, len(data)):
            ruled_out = set()
            for k in (3, 2, 1, 0):
                seen = {b: n for b, n in self.after.get(data[i - k : i], {}).items() if b not in ruled_out}
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    out -= math.log2(seen[data[i]] / total)
                    break
                out -= math.log2(len(seen) / total)
                ruled_out |= set(seen)
            else:
                out += math.log2(256 - len(ruled_out))
        return out


TRAIN = [("en", "the cat sat on the mat, the end"), ("en", "that is the other thing"), ("de", "die Katze saß auf der Matte"), ("de", "das ist das andere Ding, und so weiter"), ("", "zzz")]
ODD = [(1, None, None), (2, "", "x"), (3, "12 34 ... !", "x"), (None, "the other cat", "x"), (None, "und die andere Katze", None), (4, "日本語 ß", "x"), (5, "the mat " * 5000, "x"), (6, "z", "x")]


@pytest.mark.parametrize("slice_strings", [language.SLICE, 20])
def test_code_lengths_equal_a_plain_coder(spark, monkeypatch, slice_strings):
    docs = spark.createDataFrame([(100 + i, t, lang) for i, (lang, t) in enumerate(TRAIN)] + ODD + [(200, "none", None)], "doc_id long, text string, lang string").withColumn("bits", F.lit("clash"))
    trees = {lang: Plain([t for x, t in TRAIN if x == lang]) for lang in ("en", "de", "")}
    got = language.identify_languages(docs, F.col("doc_id") >= 100, slice_strings=slice_strings)
    rows, texts = got.collect(), Counter()
    assert len(rows) == 14
    want = defaultdict(list)
    for i, text, _ in ODD:
        bits = {lang: tree.bits(text or "") for lang, tree in trees.items()}
        want[i].append((text, sorted((b, x) for x, b in bits.items())))
    for r in rows:
        if r.doc_id is not None and r.doc_id >= 100:
            continue
        bits = [x.bits for x in r.bits]
        text, near = min(want[r.doc_id], key=lambda x: abs(x[1][0][0] - bits[0]))
        texts[text] += 1
        assert np.allclose([b for b, _ in near], bits)
        if any(c.isalpha() for c in text or ""):
            assert r.lang_pred == near[0][1] and abs(r.score - 1 / sum(2 ** (bits[0] - b) for b in bits)) < 1e-9
        else:
            assert (r.lang_pred, r.score) == ("und", 0)
    assert len(texts) == len(ODD)


def test_texts_are_coded_in_pieces(spark, monkeypatch):
    text = "the cat sat on the mat, the end; " * 40
    pieces = lambda: language._strings(list(language._pieces(text)))
    whole = pieces()
    monkeypatch.setattr(language, "PORTION", 7)
    assert (pieces() == whole).all() and len(whole) == len(text)
    assert language._slices({0: 5, 3: 5, 4: 20, 255: 1}, 10) == [(0, 3), (4, 254), (255, 255)]
    assert language._slices({}, 10) == [(0, 255)]


def test_nothing_taught_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    rows = language.identify_languages(docs, F.lit(True)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score, r.bits) for r in rows) == [(1, "und", 0.0, []), (2, "und", 0.0, [])]
    assert language.identify_languages(docs.limit(0), F.lit(True)).collect() == []


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    rows = language.op13_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
