"""Operator 13: language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes counts what follows them.
A text's code length in a language is the sum, over its bytes, of the bits of the byte
in its longest known context; where the context has not been followed by the byte, an
escape is paid and the next shorter one is asked, without the bytes already ruled out
(escapes after method C, exclusion as in the full method). Counts are frozen before any
text is scored. The shortest code names the language.

Trees are counted over all labelled texts: a tree is the table of its four-byte strings,
as every shorter context's counts are sums of it. They are scored in slices cut by the
byte next to the one coded, in a pass of its own each, so that what is broadcast is
bounded while the trees grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import materialize, table
from facetgraph.sources.scratch import Scratch

#: Bytes of context before a text's first byte.
BEFORE = b"\n\n\n"
#: Strings of all languages in one broadcast slice (16 bytes each), strings that a task counts together, and bytes scored together.
SLICE, TOGETHER, PORTION = 4_000_000, 4_000_000, 2_000_000
#: Bits of strings in all languages that a task works out beforehand.
KNOWN = 16_000_000
#: The language of what holds no letter.
UNDETERMINED = "und"


def _pieces(text: str | None) -> Iterator[bytes]:
    """A text's bytes in pieces of bounded length, each behind the three bytes before it."""
    data = BEFORE + (text or "").encode()
    for i in range(0, len(data) - len(BEFORE), PORTION):
        yield data[i : i + PORTION + len(BEFORE)]


def _strings(pieces: list[bytes]) -> np.ndarray:
    """The four-byte string that ends at each byte of the pieces, one piece after the other."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    if not len(data):
        return data
    codes = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    inside = np.ones(len(data), bool)
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    for i in range(len(BEFORE)):
        inside[starts + i] = False
    return codes[inside[3:]]


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts[order], first) if len(codes) else counts


class ContextTree:
    """A language's frozen counts: codes, ascending four-byte strings, and how often each was seen, perhaps of some nearest bytes only; alone, single bytes and how often each was seen in all."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, alone: np.ndarray, alone_counts: np.ndarray) -> None:
        # strings[k], seen[k]: strings of k + 1 bytes, for contexts of k; contexts[k]: (context, count, distinct followers)
        self.strings, self.seen, self.contexts = [None] * 4, [None] * 4, [None] * 4
        codes, counts = codes.astype(np.uint64), counts.astype(np.float64)
        for k in (3, 2, 1, 0):
            if k == 0:
                codes, counts = _counted(alone.astype(np.uint64), alone_counts.astype(np.float64))
            elif k < 3:
                codes, counts = _counted(codes & np.uint64(256 ** (k + 1) - 1), counts)
            self.strings[k], self.seen[k] = codes, counts
            above = codes >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1]))) if len(above) else np.zeros(0, np.int64)
            self.contexts[k] = (above[first], np.add.reduceat(counts, first) if len(first) else counts, np.diff(first, append=len(above)).astype(float))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The bits of each four-byte string's last byte after the three before it."""
        codes = codes.astype(np.uint64)
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        # what the longer context has ruled out, in counts and in kinds, among the followers of the one at hand
        gone, kinds = np.zeros(len(codes)), np.zeros(len(codes))
        for k in (3, 2, 1, 0):
            own = codes[left] & np.uint64(256 ** (k + 1) - 1)
            contexts, total, distinct = self.contexts[k]
            at, known = self._find(contexts, own >> np.uint64(8))
            n = np.where(known, total[at] if len(total) else 0.0, 0.0) - gone
            q = np.where(known, distinct[at] if len(distinct) else 0.0, 0.0) - kinds
            place, hit = self._find(self.strings[k], own)
            if hit.any():
                out[left[hit]] -= np.log2(self.seen[k][place[hit]] / (n[hit] + q[hit]))
            # an escape costs nothing where the context is unknown or all its followers are ruled out
            pays = ~hit & (q > 0)
            out[left[pays]] -= np.log2(q[pays] / (n[pays] + q[pays]))
            left, context, known = left[~hit], own[~hit] >> np.uint64(8), known[~hit]
            if k:
                gone, kinds = self._excluded(k, context, known)
            else:
                # every byte that was never seen is as likely
                out[left] += np.log2(256 - len(self.strings[0]))
        return out

    def _excluded(self, k: int, contexts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each context of k bytes, the counts and kinds of its followers, as they follow the context one byte shorter."""
        mass, kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
        keys, back = np.unique(contexts[known], return_inverse=True)
        if len(keys):
            low, high = np.searchsorted(self.strings[k], keys << np.uint64(8)), np.searchsorted(self.strings[k], (keys << np.uint64(8)) + np.uint64(255), "right")
            span = high - low
            rows = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(low, span)
            at, _ = self._find(self.strings[k - 1], self.strings[k][rows] & np.uint64(256**k - 1))
            sums = np.add.reduceat(self.seen[k - 1][at], np.cumsum(span) - span)
            mass[known], kinds[known] = sums[back], span[back]
        return mass, kinds


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang and text to rows of lang, code and n."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    fresh: dict[str, list[bytes]] = {}
    size = 0

    def merge() -> None:
        for lang, texts in fresh.items():
            codes, n = np.unique(_strings(texts), return_counts=True)
            if lang in held:
                codes, n = _counted(np.concatenate((held[lang][0], codes)), np.concatenate((held[lang][1], n)))
            held[lang] = codes, n
        fresh.clear()

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in held.items():
            for i in range(0, len(codes), 100_000):
                part = codes[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], ["lang", "code", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            for piece in _pieces(text.as_py()):
                fresh.setdefault(lang.as_py(), []).append(piece)
                size += len(piece)
                if size >= PORTION:
                    merge()
                    size = 0
        if sum(len(codes) for codes, _ in held.values()) >= TOGETHER:
            yield from rows()
            held.clear()
    merge()
    yield from rows()


def context_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n): how often each four-byte string stands in the texts of each language. Null languages and texts teach nothing."""
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return own.mapInArrow(_counter, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _scorer(known, nearest: tuple[int, int], n_langs: int):
    """Adds to bits, an array of a number a language, what a slice of the trees says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ContextTree(*x) for x in known.value]
        # where the slice's strings and languages are few, their bits are known beforehand; others are looked up as they come
        codes = np.unique(np.concatenate([t.strings[3] for t in trees])).astype(np.uint32)
        codes = codes if len(codes) * n_langs <= KNOWN else codes[:0]
        costs = np.stack([t.bits(codes) for t in trees], axis=1)

        def score(pieces: list[bytes], rows: list[int], sums: np.ndarray) -> None:
            strings = _strings(pieces)
            row = np.repeat(rows, [len(p) - len(BEFORE) for p in pieces])
            near = strings >> 8 & 255
            mine = (near >= nearest[0]) & (near <= nearest[1])
            strings, row = strings[mine], row[mine]
            at = np.minimum(np.searchsorted(codes, strings), max(len(codes) - 1, 0))
            new = codes[at] != strings if len(codes) else np.ones(len(strings), bool)
            fresh, back = np.unique(strings[new], return_inverse=True)
            old, at, other = row[~new], at[~new], row[new]
            for i, tree in enumerate(trees):
                sums[:, i] += np.bincount(old, costs[at, i], len(sums)) + np.bincount(other, tree.bits(fresh)[back], len(sums))

        for batch in batches:
            sums = np.array(batch.column("bits").to_pylist(), float).reshape(len(batch), n_langs)
            pieces, rows, held = [], [], 0
            for i, text in enumerate(batch.column("text")):
                for piece in _pieces(text.as_py()):
                    if pieces and held + len(piece) > PORTION:
                        score(pieces, rows, sums)
                        pieces, rows, held = [], [], 0
                    pieces.append(piece)
                    rows.append(i)
                    held += len(piece)
            if pieces:
                score(pieces, rows, sums)
            arrays = {c: batch.column(c) for c in batch.schema.names}
            arrays["bits"] = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n_langs), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return run


def _slices(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of bytes that cover 0 to 255, each of at most so many strings, or one byte."""
    out, held = [(0, 255)], 0
    for byte, n in sorted(sizes.items()):
        if held and held + n > most:
            out[-1:] = [(out[-1][0], byte - 1), (byte, 255)]
            held = 0
        held += n
    return out


def code_lengths(texts: DataFrame, counts: DataFrame, langs: list[str], scratch: Scratch, slice_strings: int = SLICE) -> DataFrame:
    """Adds `bits` to rows with a column text: the text's code length in each of langs, under counts as context_counts() gives them."""
    spark = texts.sparkSession
    nearest = F.expr("int(code div 256 % 256)")
    sizes = {r.byte: r.n for r in counts.groupBy(nearest.alias("byte")).agg(F.count("*").alias("n")).collect()}
    # what follows no byte in particular, 256 rows a language at most
    alone = counts.groupBy("lang", F.expr("code % 256").alias("code")).agg(F.sum("n").alias("n")).toPandas()
    rows = texts.withColumn("bits", F.array_repeat(F.lit(0.0), len(langs)))
    slices = _slices(sizes, slice_strings)
    for i, (low, high) in enumerate(slices):
        part = counts.where(nearest.between(low, high)).toPandas()
        trees = []
        for lang in langs:
            own, rest = part[part.lang == lang].sort_values("code"), alone[alone.lang == lang]
            trees.append((own.code.to_numpy(), own.n.to_numpy(), rest.code.to_numpy(), rest.n.to_numpy()))
        known = spark.sparkContext.broadcast(trees)
        rows = rows.mapInArrow(_scorer(known, (low, high), len(langs)), rows.schema)
        rows = scratch.write(rows, f"slice-{i}") if i < len(slices) - 1 else rows
    return rows


def identify_languages(docs: DataFrame, taught: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slice_strings: int = SLICE) -> DataFrame:
    """A row for each of docs: id_col, lang_pred, score, bits (an array of struct<lang, bits>, from the shortest code).

    Rows where `taught` holds, with a language and a text, teach; the languages are their
    distinct values, and an empty one is a language too. score is the share of the
    predicted language, at equal priors; of equally short codes the language of the
    smaller name wins. A text that is null or has no letter is `und` with score 0, and so
    is every text if nothing teaches. Rows that share an id are judged one by one; other
    columns are ignored; no rows give no rows.
    """
    with Scratch(docs.sparkSession, "language") as scratch:
        teaching = docs.where(taught).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        counts = scratch.write(context_counts(teaching), "counts")
        langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        if langs:
            rows = code_lengths(texts, counts, langs, scratch, slice_strings)
        else:
            rows = texts.withColumn("bits", F.array().cast("array<double>"))
        names = F.array(*[F.lit(x) for x in langs]).cast("array<string>")
        coded = F.array_sort(F.arrays_zip(F.col("bits"), names.alias("lang")))
        rows = rows.select("id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), coded.alias("coded"))
        rows = materialize(rows, "language")
    first = F.get("coded", F.lit(0))
    known = F.col("letter") & first.isNotNull()
    share = 1 / F.aggregate("coded", F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), first["bits"] - x["bits"]))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(known, first["lang"]).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, share).otherwise(0.0).alias("score"),
        F.transform("coded", lambda x: F.struct(x["lang"].alias("lang"), x["bits"].alias("bits"))).alias("bits"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 3
    found = identify_languages(docs, fold("doc_id") != 1)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")
