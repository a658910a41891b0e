"""Operator 5: packing by Karmarkar-Karp multiway differencing.

A task turns each text into token ids and cuts them: windows that one document fills
stand alone, what remains is cut into pieces. Pieces meet in groups of bounded size. In
a group of p pieces each starts as a partition of its own into m windows, all but one
empty; the two partitions of the largest imbalance are merged, the fullest windows of
one with the emptiest of the other, until one partition is left. If a window then
exceeds the capacity, m rises by one.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import materialize, table

CAPACITY, END_ID = 2048, 1
#: Pieces are this long at most, and about so many meet in a group.
PIECE, GROUP = 512, 512
#: Bytes of text looked at together, letters of words that go to the merges together, the longest such in bytes, and words whose ids are remembered.
PORTION, TOGETHER, LONGEST, MEMORY = 1_000_000, 20_000, 200, 300_000
#: Letters that composing leaves alone, and that are small or have the small form that every library gives them. The
#: default tokenizer never cuts a word of them before its merges, and sets ASCII punctuation behind one apart; PROBES
#: tell whether a tokenizer is of that kind.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and (c.lower() == c or c < "\u0100") and unicodedata.is_normalized("NFC", c))
STEM = f"^[{LETTERS}]+$"
PROBES = ("the", "Straße", "Étoile", "naïveté", "a" * 150)
#: The sign that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next from U+0100.
SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_OF_SIGN = {chr(b): b for b in SEEN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in SEEN)}


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window, from 0, of each size, by multiway differencing into that many windows."""
    if windows == 1 or len(sizes) == 0:
        return np.zeros(len(sizes), np.int64)
    heap, nodes = [], []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        nodes.append(None)
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, one, sums = heapq.heappop(heap)
        _, two, others = heapq.heappop(heap)
        both = sums[::-1] + others
        order = np.argsort(both, kind="stable")
        both = both[order]
        nodes.append((one, two, order))
        heapq.heappush(heap, (int(both[0] - both[-1]), len(nodes) - 1, both))
    # from the last merge down: which window each position of a partition became
    place = {len(nodes) - 1: np.arange(windows)}
    out = np.zeros(len(sizes), np.int64)
    for n in range(len(nodes) - 1, -1, -1):
        at = place.pop(n)
        if nodes[n] is None:
            out[n] = at[-1]
            continue
        one, two, order = nodes[n]
        place[one], place[two] = np.empty(windows, np.int64), np.empty(windows, np.int64)
        place[one][windows - 1 - order] = at
        place[two][order] = at
    return out


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size (capacity at most); as few windows as differencing can fill without excess."""
    windows = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        at = differencing(sizes, windows)
        if np.bincount(at, sizes, windows).max(initial=0) <= capacity:
            return at
        windows += 1


def merges_by_rank(model: dict) -> bool:
    """Whether to merge the pair of the lowest id, listed as a merge or not, gives what a BPE model's list of merges gives.

    That is so if ids rise in the order of merges and the list by itself makes each entry
    out of its letters: a pair that is not listed but joins to an entry would be what the
    list leaves of that entry's letters.
    """
    suffix, vocabulary = model.get("end_of_word_suffix"), model.get("vocab", {})
    if model.get("type") != "BPE" or not suffix or model.get("dropout") or model.get("continuing_subword_prefix"):
        return False
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    rank = {pair: i for i, pair in enumerate(merges)}
    ids = [vocabulary[a + b] for a, b in merges]
    singles = set(vocabulary.values()).difference(ids)
    if ids != sorted(set(ids)) or max(singles, default=-1) >= min(ids, default=len(singles)):
        return False
    for entry in vocabulary:
        parts = [*entry[: -len(suffix)][:-1], entry[: -len(suffix)][-1] + suffix] if entry.endswith(suffix) and entry != suffix else [*entry]
        while len(parts) > 1:
            best, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(rank):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def _gather(ids: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of units of ids that stand one after the other, counts long, those named by which, and their counts."""
    lengths = counts[which]
    ends = np.cumsum(lengths)
    shift = (np.cumsum(counts) - counts)[which] - (ends - lengths)
    return ids[np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths


class _WordIds:
    """Token ids of words.

    A word of LETTERS with ASCII punctuation behind is cut there by the default tokenizer,
    and its letters, lower-cased, are one word of the merges. Such letters go to tiktoken's
    merges together, one on a line, whose end stands for the vocabulary's end of a word.
    All other words go to the whole tokenizer one by one, as they are.
    """

    def __init__(self, path: str, by_rank: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.merges = Tokenizer.from_file(path), {}, None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        own = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # an added token that such a word can hold is cut out of it before
        held = any(re.fullmatch(f"[{LETTERS}]*[{re.escape(string.punctuation)}]*", content) for content in own)
        if suffix and not held and (by_rank or merges_by_rank(json.loads(self.tokenizer.to_str())["model"])):
            import tiktoken

            ranks = {}
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                stem = token.removesuffix(suffix)
                if BYTE_OF_SIGN.keys() >= set(stem):
                    ranks[bytes(BYTE_OF_SIGN[c] for c in stem) + b"\n" * (stem != token)] = i
            self.ends = np.zeros(max(ranks.values(), default=0) + 1, bool)
            self.ends[[i for token, i in ranks.items() if token[-1:] == b"\n"]] = True
            if all(bytes([b]) + end in ranks for b in range(256) for end in (b"", b"\n")):
                self.merges = tiktoken.Encoding("lines", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        if self.merges:
            ids, _ = self._merged(pa.array([w.lower() for w in PROBES]))
            if ids.tobytes() != b"".join(map(self._any, PROBES)):
                self.merges = None

    def _any(self, word: str) -> bytes:
        if word not in self.remembered:
            if len(self.remembered) >= MEMORY:
                self.remembered.clear()
            self.remembered[word] = np.array(self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return self.remembered[word]

    def _merged(self, stems: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.zeros(0, "<u4")]
        for lo in range(0, len(stems), TOGETHER):
            some = stems.slice(lo, TOGETHER)
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_py()
            parts.append(np.array(self.merges.encode_ordinary(lines + "\n"), "<u4"))
        ids = np.concatenate(parts)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1) if len(ids) else np.zeros(0, np.int64)

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each word has."""
        stems = pc.ascii_rtrim(words, characters=string.punctuation)
        if self.merges:
            plain = pc.and_(pc.match_substring_regex(stems, STEM), pc.less_equal(pc.binary_length(stems), LONGEST))
        else:
            plain = pa.array(np.zeros(len(words), bool))
        heads = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        tails = pc.utf8_ltrim(words.filter(plain), characters=LETTERS)
        others = pa.concat_arrays([pa.array([""]), tails, words.filter(pc.invert(plain))]).dictionary_encode()
        ids, counts = self._merged(heads.dictionary)
        more = [self._any(word) for word in others.dictionary.to_pylist()]
        # a word is two units: its letters and what stands behind, or the whole word and nothing
        plain, other = plain.to_numpy(zero_copy_only=False), others.indices.to_numpy() + len(counts)
        units = np.full((len(words), 2), other[0], np.int64)
        units[plain, 0], units[plain, 1], units[~plain, 0] = heads.indices.to_numpy(), other[1 : 1 + len(tails)], other[1 + len(tails) :]
        ids = np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")])
        ids, lengths = _gather(ids, np.concatenate([counts, [len(m) // 4 for m in more]]).astype(np.int64), units.ravel())
        return ids, lengths.reshape(-1, 2).sum(1)


def _word_ids(tokenizer_file: str | None) -> _WordIds:
    """Those of a tokenizer's file; a test holds merges_by_rank of the default one."""
    if tokenizer_file is None:
        import public_tokenizers

        return _WordIds(public_tokenizers.path("word_bpe_49k.json"), by_rank=True)
    return _WordIds(tokenizer_file, by_rank=False)


def _portions(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """The texts, in slices that hold PORTION bytes together or are one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _cutter(tokenizer_file: str | None, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(tokenizer_file)
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            row = -1
            for texts in _portions(pc.fill_null(batch.column(1), "").cast(pa.string())):
                # The tokenizer drops white space and looks at nothing across it; only the six ASCII spaces are cut at here.
                lists = pc.ascii_split_whitespace(texts)
                words = lists.flatten().dictionary_encode()
                ids, counts = known.encode(words.dictionary)
                # behind the words of each text stands its end id, as one more word
                ends = np.cumsum(lists.value_lengths().to_numpy())
                codes = np.insert(words.indices.to_numpy(), ends, len(counts))
                ids, counts = _gather(np.append(ids, np.array([END_ID], "<u4")), np.append(counts, 1), codes)
                upto = np.cumsum(counts)[ends + np.arange(len(ends))].tolist()
                data = memoryview(ids).cast("B")
                for first, last in zip([0, *upto], upto, strict=False):
                    row += 1
                    total, start = last - first, 0
                    while start < total:
                        length = capacity if total - start >= capacity else min(piece, total - start)
                        rows.append(row)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(data[4 * (first + start) : 4 * (first + start + length)]))
                        totals.append(total)
                        start += length
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _packer(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("__row")
        lengths = group.column("length").to_numpy().astype(np.int64)
        window = np.zeros(len(lengths), np.int64)
        loose = lengths < capacity
        window[loose] = pack_sizes(lengths[loose], capacity)
        window[~loose] = (window[loose].max(initial=-1) + 1) + np.arange((~loose).sum())
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.concatenate(([True], np.diff(window[order]) > 0)) if len(order) else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0)) if len(order) else ends
        offset = np.empty(len(lengths), np.int64)
        offset[order] = ends - lengths[order] - base
        number = (group.column("__group").to_numpy().astype(np.int64) << 24) + window
        return group.drop_columns(["__row", "__group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Rows that share an id, also a null one,
    are documents of their own. Other columns are ignored; no rows give no rows.
    tokenizer_file must be at that path on every executor, and be of a tokenizer that drops
    white space; by default it is word_bpe_49k.json of the installed public_tokenizers.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_cutter(tokenizer_file, capacity, piece), schema)
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.count() / group))
    pieces = pieces.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    out = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.groupBy("__group").applyInArrow(_packer(capacity), out).withColumnRenamed("id", id_col)


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
