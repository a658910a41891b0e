"""Operator 10: toxic spans and document scores by a linear-chain conditional random field.

Fitting takes a bounded sample of labelled rows. A word or word beginning that stands in
many times more toxic than clean rows marks tokens of toxic rows; on those token labels
the field is trained by gradient ascent on its conditional likelihood. The sample's whole
texts are cut into tiles for that, the last one shorter; equal tiles are trained on once,
with their number as weight, so that none is left out. Scoring runs
forward and backward over every whole text: tokens that no feature knows share one
transfer matrix, whose powers bridge the gaps between the others. The marginals of the
others give offending spans and, through a noisy-or that is calibrated on the sample,
the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import id_key, table, whole_text

#: Bound of the sample: labelled rows of each class.
ROWS_OF_CLASS = 3000
#: Tokens in a tile, and tiles in one array.
TILE, BLOCK = 13, 8192
#: A feature stands in this many toxic rows at least, this share of them, and this many times more often there; a label needs the second ratio.
LEAST_ROWS, LEAST_SHARE, LEAST_RATIO, LABEL_RATIO = 4, 0.01, 4.0, 10.0
STEPS = 60
TOKEN = re.compile(r"[^\W\d_]+")


#: The least and most share of toxic rows that is believed; without labels, the least.
PRIORS = (0.001, 0.5)


def words(text: str) -> list[str]:
    """A text's tokens, lower-cased one by one, so that their places are those of the text itself."""
    return TOKEN.findall(text.lower()) if text.isascii() else [t.lower() for t in TOKEN.findall(text)]


def features(token: str) -> list[str]:
    """A token's features: itself, and its first four to six letters."""
    return ["=" + token, *[token[:k] for k in (4, 5, 6) if len(token) > k]]


@dataclass
class ToxicityModel:
    weights: dict[str, float]  # of features, for the toxic state
    bias: float
    moves: list[list[float]]  # moves[a][b]: from state a to b
    slope: float
    offset: float


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _posteriors(unary: np.ndarray, moves: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, l, 2) and summed pair marginals (2, 2) of n chains of one length, each counted so many times."""
    n, length = unary.shape
    emit = np.stack([np.zeros_like(unary), unary], -1)
    ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = emit[:, 0]
    for i in range(1, length):
        ahead[:, i] = emit[:, i] + _log_sum(ahead[:, i - 1, :, None] + moves, 1)
    for i in range(length - 2, -1, -1):
        behind[:, i] = _log_sum(moves[None] + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)
    pair = np.exp(ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - total[:, None, None, None])
    return np.exp(ahead + behind - total[:, None, None]), np.tensordot(times, pair.sum(1), 1)


def fit(rows: list[tuple[str, int]], prior: float) -> ToxicityModel:
    """The field of labelled rows (text, toxic); prior: the share of toxic rows outside the sample. Without rows nothing is toxic."""
    rows = [(words(text), toxic) for text, toxic in dict.fromkeys(rows)]  # a copy is no new evidence
    seen = {0: Counter(), 1: Counter()}
    for tokens, toxic in rows:
        seen[toxic].update({f for t in set(tokens) for f in features(t)})
    of = {k: max(1, sum(toxic == k for _, toxic in rows)) for k in (0, 1)}
    ratio = {f: (n / of[1]) / ((seen[0][f] + 0.5) / of[0]) for f, n in seen[1].items() if n >= max(LEAST_ROWS, LEAST_SHARE * of[1])}
    names = {f: i for i, f in enumerate(sorted(f for f, r in ratio.items() if r >= LEAST_RATIO))}
    marked = {f for f in names if ratio[f] >= LABEL_RATIO}
    known: dict[str, tuple[tuple[int, ...], int]] = {}

    def coded(token: str) -> tuple[tuple[int, ...], int]:
        """A token's known features, and whether one of them marks it."""
        if token not in known:
            own = features(token)
            known[token] = tuple(names[f] for f in own if f in names), int(any(f in marked for f in own))
        return known[token]

    tiles: Counter = Counter()
    for tokens, toxic in rows:
        codes = [coded(t) for t in tokens]
        if toxic and not any(mark for _, mark in codes):
            continue  # its toxic tokens are unknown
        if not toxic:
            codes = [(c, 0) for c, _ in codes]
        for lo in range(0, len(codes), TILE):
            tiles[tuple(codes[lo : lo + TILE])] += 1
    weights, moves, bias = np.zeros(len(names) + 1), np.zeros((2, 2)), -3.0
    if tiles and names:
        most = max(1, max(len(c) for tile in tiles for c, _ in tile))
        pairs, blocks = np.zeros((2, 2)), []
        for length in sorted({len(tile) for tile in tiles}):
            same = sorted(tile for tile in tiles if len(tile) == length)
            for lo in range(0, len(same), BLOCK):
                block = same[lo : lo + BLOCK]
                grid = np.array([[[*c, *[len(names)] * (most - len(c))] for c, _ in tile] for tile in block])
                gold, times = np.array([[mark for _, mark in tile] for tile in block]), np.array([tiles[tile] for tile in block], float)
                np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), np.repeat(times, length - 1))
                blocks.append((grid, gold, times))
        sums = [np.full_like(weights, 1e-6), np.full((2, 2), 1e-6), 1e-6]
        for _ in range(STEPS):
            step, turn, shift = -0.05 * weights, pairs - 0.05 * moves, 0.0
            for grid, gold, times in blocks:
                marginals, expected = _posteriors(weights[grid].sum(-1) + bias, moves, times)
                wrong = (gold - marginals[:, :, 1]) * times[:, None]
                step += np.bincount(grid.ravel(), np.repeat(wrong.ravel(), most), len(weights))
                turn -= expected
                shift += float(wrong.sum())
            step[-1] = 0.0
            for k, g in enumerate((step, turn, shift)):
                sums[k] = sums[k] + g * g
            weights += 0.5 * step / np.sqrt(sums[0])
            moves += 0.5 * turn / np.sqrt(sums[1])
            bias += 0.5 * shift / math.sqrt(sums[2])
    model = ToxicityModel({f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-3}, float(bias), moves.tolist(), 1.0, 0.0)
    evidence = Scorer(model).evidence
    x = np.array([evidence(tokens)[0] for tokens, _ in rows])
    y = np.array([toxic for _, toxic in rows])
    # logistic calibration, with rows weighted to the prior, which is also what holds without evidence
    prior = min(max(prior, PRIORS[0]), PRIORS[1])
    start = math.log(prior / (1 - prior))
    scale = np.where(y == 1, prior * len(y) / of[1], (1 - prior) * len(y) / of[0])
    slope, offset = 0.5, start
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g, h = scale * (y - p), scale * p * (1 - p) + 1e-6
        a, b, c = (h * x * x).sum() + 0.1, (h * x).sum(), h.sum() + 0.1
        u, v = (g * x).sum() - 0.1 * slope, g.sum() - 0.1 * (offset - start)
        det = a * c - b * b
        slope, offset = slope + 0.5 * (c * u - b * v) / det, offset + 0.5 * (a * v - b * u) / det
    model.slope, model.offset = float(slope), float(offset)
    return model


class Scorer:
    """A model that is ready to read texts."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}
        (a, b), (c, d) = model.moves
        e = model.bias
        self.step = np.exp([[a, b + e], [c, d + e]])
        self.move, self.start = np.exp(np.array(model.moves)), np.array([1.0, math.exp(e)])
        values, vectors = np.linalg.eig(self.step)
        self.values, self.vectors, self.inverse = values.real / values.real.max(), vectors.real, np.linalg.inv(vectors.real)

    def weight(self, token: str) -> float:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            w = self.model.weights
            got = self.known[token] = sum(w.get(f, 0.0) for f in features(token))
        return got

    def bridge(self, gap: int) -> np.ndarray:
        """The transfer over gap unknown tokens, up to a factor."""
        return (self.vectors * self.values**gap) @ self.inverse

    def evidence(self, tokens: list[str]) -> tuple[float, list[tuple[int, float]]]:
        """The log odds of the noisy-or of the marginals, and (place, marginal) of the tokens with known features."""
        known = self.known
        units = [known[t] if t in known else self.weight(t) for t in tokens]
        at = [i for i, u in enumerate(units) if u]
        if not at:
            return -14.0, []
        emit = [math.exp(min(30.0, units[i] + self.model.bias)) for i in at]
        ahead, state, last = [], np.ones(2), -1
        for i, e in zip(at, emit, strict=True):
            if last < 0:
                state = self.start @ self.bridge(i - 1) @ self.move if i else np.ones(2)
            else:
                state = state @ self.bridge(i - last - 1) @ self.move
            state = state * (1.0, e)
            state = state / state.sum()
            ahead.append(state)
            last = i
        out, back, nxt = [], np.ones(2), len(tokens)
        for k in range(len(at) - 1, -1, -1):
            i = at[k]
            if k < len(at) - 1:
                back = self.bridge(nxt - i - 1) @ self.move @ (back * (1.0, emit[k + 1]))
            else:
                back = self.bridge(nxt - i - 1) @ np.ones(2)
            back = back / back.sum()
            both = ahead[k] * back
            out.append((i, float(both[1] / both.sum())))
            nxt = i
        clean = sum(math.log1p(-min(p, 1 - 1e-9)) for _, p in out)
        return math.log((1 - math.exp(clean) + 1e-6) / (math.exp(clean) + 1e-6)), out[::-1]

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """A text's score, and the offsets of its tokens with a marginal of a half or more."""
        x, out = self.evidence(words(text))
        spans = []
        if any(p >= 0.5 for _, p in out):
            places = [m.span() for m in TOKEN.finditer(text)]
            spans = [places[i] for i, p in out if p >= 0.5]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.model.slope * x + self.model.offset)))), spans


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_of_class: int = ROWS_OF_CLASS) -> tuple[list[tuple[str, int]], float]:
    """Labelled rows outside the fold of crc32(id) mod 5 = 0, rows_of_class of each class at most, and the share of toxic ones."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    key = id_key("id")
    ranks = [known.where(f"toxic = {k}").orderBy(key).limit(rows_of_class) for k in (0, 1)]
    few = ranks[0].unionByName(ranks[1])  # bounded by 2 * rows_of_class
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    rows = texts.join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).orderBy(id_key("id"))
    return [(r["text"], r["toxic"]) for r in rows.collect()], counts.get(1, 0) / max(1, sum(counts.values()))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, `score`, `spans` (offsets of toxic tokens) for each row. Null text is empty; ids are passed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(text.as_py() or "") for text in batch.column(1)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), spans], ["id", "score", "spans"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", span)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_sample(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
