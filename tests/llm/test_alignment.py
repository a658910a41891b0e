"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from facetgraph.llm import alignment

ODD = [
    (1, None, "x"),
    (1, "", None),
    (None, "don't stop, don't stop", "x"),
    (None, "don't stop, don't stop", "y"),
    (2, "  two  spaces\n\n\ttab 12345 ", "x"),
    (3, "<|endoftext|> </s> <s> <0x0A> <unk>", "x"),
    (4, "日本語 naïve Ünïcödé 🙂🙂 ﬁ ｆ ▁ \x00 \x85", "x"),
    (5, "ab" * 3000 + "a" * 3001, "x"),
    (6, "word " * 4000, "x"),
    (7, " " * 6000 + "x", "x"),
    (8, " " * 20_000, "x"),
]


def _plain(texts):
    """Rows as the operator gives them, from one token at a time."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    names, sign = {i: t for t, i in a.get_vocab().items()}, alignment.byte_of_sign()
    bytes_a = lambda i: bytes(sign[c] for c in names[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, held = [], []
    for text in texts:
        x, y, groups = [], [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if not (" " + text).encode() == b"".join(map(bytes_a, x)) == b"".join(map(bytes_b, y)):
                x, y = [], []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((bytes_a, x), (bytes_b, y))]
        cuts, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
        for cut in cuts:
            m, n = i, j
            while i < len(x) and ends[0][i] <= cut:
                i += 1
            while j < len(y) and ends[1][j] <= cut:
                j += 1
            groups.append((x[m:i], y[n:j]))
        links = Counter()
        for p, q in groups:
            for u, v in ((u, v) for u in Counter(p).items() for v in Counter(q).items()):
                links[u[0], v[0]] += u[1] * v[1]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        rows.append([len(x), len(y), len(groups), sum(len(p) * len(q) for p, q in groups), hashlib.sha256(text.encode()).hexdigest() if x else ""])
        held.append(links)
    docs = Counter(pair for links in held for pair in links)
    most = defaultdict(int)
    for (u, _), n in docs.items():
        most[u] = max(most[u], n)
    return [(*row[:4], sum(n for (u, v), n in links.items() if docs[u, v] == most[u]), sum(n * docs[p] for p, n in links.items()), row[4]) for row, links in zip(rows, held)]


@pytest.mark.parametrize("rows, slice_pairs", [(1000, alignment.SLICE), (40, 1500)])
def test_alignment_equals_plain_version(spark, data, rows, slice_pairs):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").limit(rows)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, pairs string").unionByName(docs.withColumnRenamed("source", "pairs"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = alignment.align_documents(docs, slice_pairs=slice_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, [(i, *x) for (i, _), x in zip(rows, _plain([t for _, t in rows]))]))


def test_slices():
    assert alignment._slices([(7, 3), (1, 2), (3, 1), (9, 9), (10, 1)], 3) == [(1, 3), (7, 7), (9, 9), (10, 10)]
    assert alignment._slices([], 3) == []


def test_groups_of_intervals():
    assert alignment.coalesce(np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 9, 2, 5, 9])).tolist() == [0, 0, 1, 0, 0, 1]
    assert alignment.coalesce(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_links_are_expanded_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    group_a, group_b = np.sort(rng.integers(0, 9, 400)), np.sort(rng.integers(0, 9, 300))
    a, b = rng.integers(0, 50, 400), rng.integers(0, 40, 300)
    want = Counter((int(g), int(x) * 40 + int(y)) for g, x in zip(group_a, a) for h, y in zip(group_b, b) if g == h)
    for at_once in (7, 10**6):
        monkeypatch.setattr(alignment, "EXPANDED", at_once)
        got = Counter()
        for g, pair, n in alignment._pairs(group_a, a, group_b, b, 40):
            for k, p, w in zip(g.tolist(), pair.tolist(), n.tolist()):
                got[k, p] += w
        assert got == want


def test_no_rows_and_nothing_to_align(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(none).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align_documents(blank).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
