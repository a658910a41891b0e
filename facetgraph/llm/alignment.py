"""Operator 12: alignment of two tokenizers by interval coalescing.

Both tokenizers cut the same bytes. All tokens of both are sorted by their start, ends
are accumulated to a running maximum, and a group breaks where a start reaches it. Inside
a group every token of one side is linked with every token of the other; links are
counted by pairs of ids, not formed one by one.

A first pass tokenizes each text once and leaves its distinct id pairs in the shared
folder, a second counts the documents of each pair, a third looks the counts up. The
counts travel to the third pass in slices of bounded size, each in a pass of its own, so
that no pair list is shuffled and nothing that is broadcast grows with the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import materialize, table
from facetgraph.sources.scratch import Scratch

#: Pairs of ids in one broadcast slice (21 bytes each), pairs that a task counts together, and characters aligned together.
SLICE, TOGETHER, PORTION = 4_000_000, 2_000_000, 500_000
#: Links expanded at once; a portion of more is taken group by group.
EXPANDED = 4_000_000
#: The first tokenizer's pattern looks ahead behind white space, for which its fast form recurses; longer runs take the plain form.
LONG_SPACE = re.compile(r"\s{5000}")
SEPARATORS = (",", "|", ";", "")


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: itself where it can be seen, else counted up from U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    unseen = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(unseen)}


class ByteLevel:
    """A byte-level BPE vocabulary file, whose ids are the ranks of its merges; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        special = {i for i, t in self.plain.get_added_tokens_decoder().items() if t.special}
        sign = byte_of_sign()
        ranks = {bytes(sign[c] for c in token): i for token, i in self.plain.get_vocab(with_added_tokens=True).items() if i not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max(ranks.values())
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.plain.encode(t, add_special_tokens=False).ids if len(t) >= 5000 and LONG_SPACE.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentencepiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group, from 0 in the order of starts, of each interval; intervals that overlap, also through others, share one."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(starts), np.int64)
    group[order[1:]] = np.cumsum(starts[order[1:]] >= reach[:-1])
    return group


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of each one's weights (1 by default)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights


def _pairs(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair, weight) parts: weight links of ids (a, b), as a * size_b + b, in a group. Groups ascend within each side."""
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    one = (n_a == 1) & (n_b == 1)
    single_a, single_b = one[group_a], one[group_b]
    yield group_a[single_a], a[single_a] * size_b + b[single_b], np.ones(single_a.sum(), np.int64)
    sides = []
    for group, ids, single in ((group_a, a, single_a), (group_b, b, single_b)):
        top = int(ids.max(initial=0)) + 1
        keys, n = _counted(group[~single] * top + ids[~single])
        sides.append((keys // top, keys % top, n))
    (ga, ia, wa), (gb, ib, wb) = sides
    groups, first, n_ids = np.unique(gb, return_index=True, return_counts=True)
    at = np.searchsorted(groups, ga)
    width = n_ids[at]
    start = 0
    while start < len(ga):  # as many ids of the first side at once as EXPANDED allows, one at least
        stop = start + max(1, int(np.searchsorted(np.cumsum(width[start:]), EXPANDED, "right")))
        w = width[start:stop]
        left = np.repeat(np.arange(start, stop), w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + first[at[left]]
        yield ga[left], ia[left] * size_b + ib[right], wa[left] * wb[right]
        start = stop


def _portions(column: pa.Array) -> Iterator[list[str]]:
    some, held = [], 0
    for scalar in column:
        text = scalar.as_py() or ""
        if some and held + len(text) > PORTION:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


class Aligner:
    def __init__(self, file_a: str | None, file_b: str | None) -> None:
        import public_tokenizers

        self.a = ByteLevel(file_a or public_tokenizers.path("byte_bpe_50k.json"))
        self.b = Pieces(file_b or public_tokenizers.path("piece_bpe_32k.model"))
        self.kind = "<u4" if self.a.size * self.b.size <= 2**32 else "<u8"
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        # an id and what stands behind it
        self.texts = [f"{i}{s}" for i in range(max(self.a.size, self.b.size)) for s in SEPARATORS]

    def align(self, texts: list[str]) -> tuple[list, list[bytes], list[bytes]]:
        """The counts (n_a, n_b, n_groups, n_links), groups_sha256, and the distinct pairs and weights of each text, as bytes."""
        ids = [[[] for _ in texts], [[] for _ in texts]]
        wanted = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in wanted]
        for i, text, x, y in zip(wanted, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in wanted])):
            data = text.encode()
            if b"".join(map(self.a.bytes.__getitem__, x)) == data == b"".join(map(self.b.bytes.__getitem__, y)):
                ids[0][i], ids[1][i] = x, y
        n = [np.array([len(x) for x in side], np.int64) for side in ids]
        flat = [np.fromiter(itertools.chain.from_iterable(side), np.int64, int(k.sum())) for side, k in zip(ids, n)]
        # the texts' bytes lie one behind the other, on both sides
        ends = [np.cumsum(lengths[x]) for lengths, x in zip(self.lengths, flat)]
        starts = [e - lengths[x] for e, lengths, x in zip(ends, self.lengths, flat)]
        group = coalesce(np.concatenate(starts), np.concatenate(ends))
        group_a, group_b = group[: len(flat[0])], group[len(flat[0]) :]
        upto = [np.concatenate(([0], np.cumsum(k))) for k in n]
        n_groups = int(group.max(initial=-1)) + 1
        bounds = np.append(group_a, n_groups)[upto[0]]  # each text's first group
        links = np.concatenate(([0], np.cumsum(np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups))))
        digests = self._digests(group_a, group_b, flat, n)

        doc_of_group = np.repeat(np.arange(len(texts)), np.diff(bounds))
        square = self.a.size * self.b.size
        keys, weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for g, pair, weight in _pairs(group_a, flat[0], group_b, flat[1], self.b.size):
            keys, weights = _counted(np.concatenate((keys, doc_of_group[g] * square + pair)), np.concatenate((weights, weight)))
        cut = np.searchsorted(keys, np.arange(len(texts) + 1) * square)
        pairs, weights = (keys % square).astype(self.kind), weights.astype("<i8")
        spans = list(zip(cut.tolist(), cut[1:].tolist()))
        columns = [n[0], n[1], np.diff(bounds), np.diff(links[bounds])]
        return [*columns, digests], [pairs[i:j].tobytes() for i, j in spans], [weights[i:j].tobytes() for i, j in spans]

    def _digests(self, group_a: np.ndarray, group_b: np.ndarray, flat: list[np.ndarray], n: list[np.ndarray]) -> list[str]:
        side = np.concatenate((group_a * 2, group_b * 2 + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate(flat)[order]
        step = np.diff(side, append=-1)
        last = np.where(step == 0, 0, np.where((step == 1) & (side % 2 == 0), 1, 2))
        total = n[0] + n[1]
        stops = np.cumsum(total)
        last[stops[total > 0] - 1] = 3
        words = list(map(self.texts.__getitem__, (ids * len(SEPARATORS) + last).tolist()))
        return [hashlib.sha256("".join(words[stop - k : stop]).encode()).hexdigest() if k else "" for stop, k in zip(stops.tolist(), total.tolist())]


def _aligned(file_a: str | None, file_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(file_a, file_b)
        for batch in batches:
            start = 0
            for texts in _portions(batch.column(1)):
                (n_a, n_b, n_groups, n_links, digests), pairs, weights = aligner.align(texts)
                arrays = [batch.column(0).slice(start, len(texts)), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)], pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(weights, pa.binary())]
                start += len(texts)
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "weights"])

    return run


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and where each row's begin, with the end of the last."""
    parts = column.to_pylist()
    upto = np.cumsum([0, *[len(x) for x in parts]]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), upto


def _pair_counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, fresh, held = np.zeros(0, kind), np.zeros(0, np.int64), [], 0

        def merged():
            new, n = _counted(np.concatenate(fresh)) if fresh else (np.zeros(0, kind), np.zeros(0, np.int64))
            return _counted(np.concatenate((keys, new)), np.concatenate((sums, n)))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], ["pair", "n"])

        for batch in batches:
            pairs, _ = _numbers(batch.column(0), kind)
            fresh.append(pairs)
            held += len(pairs)
            if held >= TOGETHER:
                (keys, sums), fresh, held = merged(), [], 0
                if len(keys) >= TOGETHER:
                    yield rows()
                    keys, sums = np.zeros(0, kind), np.zeros(0, np.int64)
        keys, sums = merged()
        yield rows()

    return run


def _looked_up(known, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        names = ["pairs", "weights", "n_best", "count_sum"]
        for batch in batches:
            pairs, upto = _numbers(batch.column("pairs"), kind)
            weights, _ = _numbers(batch.column("weights"), "<i8")
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            found = weights * hit
            own = [found * best[at], found * counts[at]] if len(keys) else [found, found]
            sums = [np.concatenate(([0], np.cumsum(x))) for x in own]
            arrays = {c: batch.column(c) for c in batch.schema.names}
            for c, s in zip(names[2:], sums):
                arrays[c] = pa.array(batch.column(c).to_numpy(zero_copy_only=False) + s[upto[1:]] - s[upto[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return run


def pair_counts(aligned: DataFrame, size_b: int, kind: str = "<u4") -> DataFrame:
    """(pair, n, best): how many rows hold a pair of ids linked, and whether no pair of its first id is held by more."""
    counts = aligned.select("pairs").mapInArrow(_pair_counts(kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    # one row for each id of the first vocabulary at most
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "a")


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str | None = None, file_b: str | None = None, slice_pairs: int = SLICE) -> DataFrame:
    """A row for each of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or that a tokenizer does not give back byte by byte,
    have no tokens: zeros and an empty groups_sha256. Each row counts as a document of its
    own, also if its id is null or stands on others; other columns are ignored; no rows
    give no rows. The files must be at their paths on every executor; by default they are
    byte_bpe_50k.json and piece_bpe_32k.model of the installed public_tokenizers. A task
    holds about 200 bytes for each byte of the longest text.
    """
    spark = docs.sparkSession
    aligner = Aligner(file_a, file_b)
    size_b, kind = aligner.b.size, aligner.kind
    names = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in names], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("weights", T.BinaryType())])
    with Scratch(spark, "alignment") as scratch:
        rows = scratch.write(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_aligned(file_a, file_b), schema), "aligned")
        counts = scratch.write(pair_counts(rows, size_b, kind), "counts")
        zero = F.lit(0).cast("long")
        rows = rows.withColumns({"n_best": zero, "count_sum": zero})
        slices = _slices(counts.groupBy("a").count().collect(), slice_pairs)
        for i, (low, high) in enumerate(slices):
            part = counts.where(F.col("a").between(low, high)).select("pair", "n", "best").toPandas().sort_values("pair")
            known = spark.sparkContext.broadcast((part.pair.to_numpy().astype(kind), part.n.to_numpy(), part.best.to_numpy()))
            rows = rows.mapInArrow(_looked_up(known, kind), rows.schema)
            rows = scratch.write(rows, f"slice-{i}") if i < len(slices) - 1 else rows
        out = rows.select(F.col("id").alias(id_col), *names, "n_best", "count_sum", "groups_sha256")
        return materialize(out, "alignment")


def _slices(sizes: list, most: int) -> list[tuple[int, int]]:
    """Ranges of first ids, each with at most so many pairs, or one id; sizes are (id, pairs), one for each id of the vocabulary at most."""
    out, held = [], 0
    for a, n in sorted(map(tuple, sizes)):
        if not out or held + n > most:
            out.append((a, a))
            held = 0
        out[-1] = (out[-1][0], a)
        held += n
    return out


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
