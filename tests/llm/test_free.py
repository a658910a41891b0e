"""Operators that SQL cannot express, against plain versions and planted cases."""

import json
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetgraph.llm import html_text, near_dup, packing, top_k, toxicity
from facetgraph.llm.labelled_pages import PAGES
from facetgraph.sources.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_packing_is_a_round_trip(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [(-1, None), (-2, ""), (-3, "Don't, stop. <|endoftext|> ***, éA. \x1c x"), (-4, "word " * 9000)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.pack_documents(docs).toPandas()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own = pieces[pieces.doc_id == r.doc_id].sort_values("start")
        assert own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == list(own.ids_crc32)
    pieces = pieces.sort_values(["sequence_id", "offset"])
    assert (pieces.offset == pieces.groupby("sequence_id").length.cumsum() - pieces.length).all()
    fill = pieces.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and fill.sum() > 0.9 * 2048 * len(fill)


def test_differencing_balances():
    sizes = np.random.default_rng(1).integers(1, 512, 300)
    fill = np.bincount(packing.differencing(sizes, 40), sizes, 40)
    assert fill.sum() == sizes.sum() and fill.max() - fill.min() < 60


def test_max_score_equals_brute_force():
    rng = np.random.default_rng(2)
    rows, query, ids = rng.integers(-9, 9, (5000, 12)).astype(float), rng.integers(-9, 9, 12).astype(float), np.arange(5000)
    got = top_k.max_score(ids, rows, rows.min(0), rows.max(0), 7, query, 5)
    scores = rows @ query
    want = sorted(((-s, i) for i, s in enumerate(scores) if i != 7))[:5]
    assert list(zip(-got[1], got[0])) == want


def test_top_k_leaves_out_what_is_not_finite(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0]), (51, None), (52, [float("nan"), 1.0]), (53, [1.0, None]), (54, [])]
    vectors = top_k.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {tuple(r) for r in top_k.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()}
    assert got == {(0, 1, 50, 65536), (0, 2, 54, 0), (50, 1, 0, 65536), (50, 2, 54, 0)}


def _brute(texts, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "a b", "A b", "one"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for _ in range(12):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice((0, 0.01, 0.03, 0.06)) else w for w in base]
            texts.append(" ".join(copy))
    roots, sizes = _brute(texts, words, percent)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, words=words, percent=percent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = near_dup.one_of_each_group(docs.union(docs), words=words, percent=percent)
    assert kept.columns == docs.columns and kept.where("text <> ''").count() == len({r for r, t in zip(roots, texts) if t})


def test_hot_shingles_are_dealt_out(spark, monkeypatch):
    # prefixes hold the shared elements, in several components, the largest of 20
    rng = random.Random(4)
    sets = [(i, i % 5 if i < 40 else (99 if i < 60 else i), sorted({*rng.sample(range(30), 18), *([777] if i % 3 else [])})) for i in range(100)]
    frame = spark.createDataFrame([(i, s) for i, _, s in sets], "num long, list array<long>")
    placed = spark.createDataFrame([(i, c) for i, c, _ in sets], "num long, comp long")
    scratch = Scratch(spark, "hot-shingles")
    near = {(j, i) for i, c, s in sets for j, d, t in sets if i < j and c != d and 100 * len({*s} & {*t}) >= 60 * len({*s} | {*t})}
    plain = {tuple(r) for r in near_dup.prefix_pairs(frame, placed, 60, scratch).collect()}
    monkeypatch.setattr(near_dup, "HOT_ROWS", 10)
    assert near and near <= plain == {tuple(r) for r in near_dup.prefix_pairs(frame, placed, 60, scratch).collect()}
    rows = spark.range(3000).select(F.col("id").alias("num"), F.explode(F.array(F.lit(-1).cast("long"), "id")).alias("token"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = near_dup.join_by_token(rows, rows.groupBy("token").agg(F.count("*").alias("df")), "df").where("token = -1")
        by_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(by_task) == 3000 == joined.select("num").distinct().count() and max(by_task) < 3000 / 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_id_of_two_texts(spark):
    rng = random.Random(5)
    a, b = (" ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(2))
    rows = [(3, a), (3, b), (1, a + " x"), (2, b + " y"), (None, b), (None, None), (4, "alone here, as it is")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out.collect())
    assert got == [(0, 0, None, False), (0, 58, 2, False), (1, 59, 1, True), (2, 59, 2, True), (3, 58, 1, False), (3, 58, 2, False), (4, 3, 4, True)]


def test_near_duplicates_of_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dup.near_duplicates(empty).collect() == near_dup.one_of_each_group(empty).collect() == []


def test_texts_of_a_template_do_not_all_meet(spark):
    # 3,000 texts of one template, each with own words: similar to 0.79 at most, nothing to link but the two planted pairs
    rng = random.Random(6)
    template = [f"t{i}" for i in range(48)]
    texts = [" ".join([*template, *[f"u{rng.randrange(10**9)}" for _ in range(6)]]) for _ in range(3000)]
    texts[17], texts[19] = texts[16] + " end", texts[18] + " end"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = near_dup.near_duplicates(docs).where("doc_id <> component_id").select("doc_id", "component_id").collect()
    assert sorted(tuple(r) for r in out) == [(17, 16), (19, 18)]
    with Scratch(spark, "template") as scratch:
        sets = near_dup._sketched(docs.withColumnRenamed("doc_id", "id"), 5, 80, True).select(F.col("id").alias("num"), "list")
        placed = spark.range(3000).select(F.col("id").alias("num"), F.col("id").alias("comp"))
        assert near_dup.prefix_pairs(sets, placed, 80, scratch).count() <= 10


def test_main_text_of_pages():
    model = html_text.train(PAGES)
    page = '<html><body><nav><a href="/">Home</a></nav><script>var t="</p>";</script><article><h1>A &amp; B</h1><p>First<br> line, of  the text.<p>Second one.</article><div class="comments"><p>I was there, too. It is so.</p></div><footer>Terms.</footer></body></html>'
    assert html_text.main_text(page, model) == "A & B\nFirst line, of the text.\nSecond one."
    assert html_text.main_text(None, model) == html_text.main_text("<p", model) == ""


def test_marginals_equal_enumeration():
    from itertools import product
    from math import exp

    model = html_text.train(PAGES[:3], steps=10)
    nodes, _ = html_text.parse("<body><div class='ad'><p>x</p></div><p>Some text.</p></body>")
    weigh = [sum(model.weights.get(f, 0.0) for f in n.features) for n in nodes]
    total, main = 0.0, [0.0] * len(nodes)
    for y in product((0, 1), repeat=len(nodes)):
        p = exp(sum(w * v for w, v in zip(weigh, y)) + sum(model.edges[n.kind][y[n.parent]][y[i]] for i, n in enumerate(nodes) if i))
        total += p
        main = [m + p * v for m, v in zip(main, y)]
    assert html_text.marginals(nodes, model)[0] == pytest.approx([m / total for m in main])


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfgklmn" for b in ("ora", "ette", "ingal", "uster")]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[rng.randrange(40)] = rng.choice(("grobian", "lout", "oaf"))
        rows.append((i, " ".join(text), "en", "a", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    rows.append((5000, None, "en", "a", 0))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.training_sample(docs, known))
    held = [r for r in toxicity.score_documents(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held if r.doc_id < 5000) >= 0.97 * len([r for r in held if r.doc_id < 5000])
    texts = {r[0]: r[1] for r in rows}
    hit = next(r for r in held if r.spans)
    assert texts[hit.doc_id][hit.spans[0].start : hit.spans[0].end] in ("grobian", "lout", "oaf")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, model).collect())


def test_toxicity_learns_from_every_token_of_the_sample():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfgklmn" for b in ("ora", "ette", "ingal", "uster")]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    short = [(" ".join([*some(4), "oaf"]), 1) for _ in range(60)]
    # three words that are only suspect come first, and the toxic one late
    late = [(" ".join(["hmpf", "hmpf", "hmpf", *some(60), "grobian", *some(20)]), 1) for _ in range(60)]
    clean = [(" ".join([*(["hmpf"] if i % 10 == 0 else []), *some(6 if i % 2 else 80)]), 0) for i in range(600)]
    model = toxicity.fit([*short, *late, *clean], 0.1)
    assert model.weights["=oaf"] > 1 and model.weights["=grobian"] > 1
    again = toxicity.fit([*clean, *late[::-1], *short], 0.1)
    assert again.weights == pytest.approx(model.weights)
    scorer = toxicity.Scorer(model)
    assert all(scorer.score(t)[1] for t, _ in [*short, *late])
    assert not any(scorer.score(t)[1] for t, _ in clean)


def _pieces_of(texts, tokenizer_file=None):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    return next(iter(packing._cutter(tokenizer_file, 10**9, 10**9)(iter([batch])))).to_pydict()


def _invented(n, letters="abcdefghijklmnopqrstuvwxyzäéßÉÈA", seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", "", ",", ".", "!!", "&&&", "'"]) for _ in range(n)]


def test_odd_words_have_the_ids_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = "".join(chr(c) for c in range(0x250) if chr(c).isalpha())
    texts = ["<|ENDOFTEXT|> <|endoftext|> a<|EndOfText|>é <|STARTOFTEXT|>.", "ÀÉÎ×÷ µªº ǅ İ ı ſ ŉ ĸ Ÿ é Å Åb ẹ́", f"{letters} {'é' * 99}. {'a' * 201} {'É' * 5000}!", "  \x1c\x85 a\x0bb\x0c c\xa0d \n", "don't 'S I'LL x'' ''s Ünï-cödé 3D日本語 Привет, мир!", None, "", " ", " ".join(_invented(20_000)), " ".join(_invented(5_000, letters)), " ".join(packing.LETTERS), "x" * 100_000, "\n".join(_invented(3_000, "àçñ\x1c\xa0aB.<|>"))]
    got = _pieces_of(texts)
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got["id"][i], got["doc_tokens"][i], got["ids_crc32"][i]) == (i, len(ids), zlib.crc32(ids.tobytes())), i


def test_merges_by_rank_where_they_equal_the_list(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    spec = json.load(open(path))
    assert packing.merges_by_rank(spec["model"])
    # "abc" is made of a and bc only, but ab is merged before bc: a list never makes it, ranks would
    vocabulary = {token: i for token, i in spec["model"]["vocab"].items() if i < 512} | {"ab": 512, "bc": 513, "abc": 514}
    spec["model"] |= {"vocab": vocabulary, "merges": [["a", "b"], ["b", "c"], ["a", "bc"]]}
    spec["added_tokens"] = []
    assert not packing.merges_by_rank(spec["model"])
    for name, content in (("odd.json", json.dumps(spec)), ("same.json", open(path).read())):
        (tmp_path / name).write_text(content)
        tokenizer = Tokenizer.from_file(str(tmp_path / name))
        assert bool(packing._word_ids(str(tmp_path / name)).merges) == (name == "same.json")
        texts = ["abcd abc, Abcabc!", " ".join(_invented(500, "abc"))]
        want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
        assert _pieces_of(texts, str(tmp_path / name))["ids_crc32"] == [zlib.crc32(w.tobytes()) for w in want]


def test_unseen_words_take_less_than_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(_invented(300_000))
    _pieces_of(["Now it is loaded."])
    start = time.process_time()
    tokenizer.encode_batch_fast([text], add_special_tokens=False)
    plain = time.process_time() - start
    start = time.process_time()
    _pieces_of([text])
    assert time.process_time() - start < 0.5 * plain
