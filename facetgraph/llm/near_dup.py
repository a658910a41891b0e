"""Operator 9: near-duplicates by fast similarity sketching, banding and exact verification.

1. A task turns each text into its set of hashed word shingles and sketches the set.
   Rounds of hashing throw every element into one of t bins and keep a bin's least
   value; a bin that is empty after t rounds takes the least element of a round of its
   own, so that every coordinate is filled (Dahlgaard, Knudsen and Thorup, 2017).
2. Texts of one set are one class. Bands of four coordinates put classes into buckets;
   the number of bands is such that a pair at the threshold shares none with a chance
   below one in a million.
3. In each bucket every class is held against one pivot on full sets, and links join
   components. In further rounds the classes outside a bucket's largest component are
   held against some of its classes, as long as that finds enough links. A bucket whose
   classes are then in one component is done: pairs within one need no further link.
4. The classes of all other buckets go through an exact join. Their shingles are ordered
   by rarity; of two sets at the threshold the smaller shares a shingle within a very
   short prefix with a short prefix of the larger, at positions that leave room for the
   overlap they need, and lengths near enough meet only. Pairs of different components
   that do are verified on full sets. So every pair that shares a bucket is verified,
   connected already, or ruled out by its sets; a group of near copies costs pairs in
   proportion to its size, and nothing is capped.

Classes are numbered, and numbers take part in links: an id may hold several texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import materialize, table
from facetgraph.sources.scratch import Scratch

#: Coordinates in a band, and texts that a task works on at once.
ROWS, PART = 4, 1000
#: Pairs up to this number (16 bytes each) are broadcast to their sets, more are shuffled.
MOST_BROADCAST = 1_000_000
#: Ids of texts up to this number (under 100 bytes each, unless ids are long) are broadcast to the texts, more are shuffled.
MOST_IDS = 250_000
#: Rounds of pairs within buckets at most, classes of the largest component to choose from, and the share of links that makes another round worth it.
ROUNDS, CHOICE, WORTH = 4, 8, 0.01
#: Tokens held by more rows than this are joined by salted keys, a salt for each so many rows.
HOT_ROWS = 1000


def bands_for(percent: int, miss: float = 1e-6) -> int:
    """Bands enough for a pair of that similarity to share one with a chance of 1 - miss."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** ROWS))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z lower-cased; of fewer words, one for all; of none, empty."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    codes = np.array([xxhash.xxh64_intdigest(w) for w in tokens], np.uint64)
    width = min(words, len(codes))
    total = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mix64(codes[k : k + len(total)])
    return np.unique(mix64(total))


def sketch(members: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch: `size` coordinates (128 at most), each the least (round, value) thrown into its bin."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    filled = 0
    for turn in range(2 * size):
        thrown = mix64(members + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = mix64(thrown) >> np.uint64(16)
        if turn < size:
            bins = ((thrown >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            placed = np.sort((bins << np.uint64(48)) | value)
            bins = (placed >> np.uint64(48)).astype(np.int64)
            first = np.concatenate(([True], bins[1:] != bins[:-1]))
            first[first] = out[bins[first]] == np.iinfo(np.uint64).max
            out[bins[first]] = (placed[first] & np.uint64(2**48 - 1)) | np.uint64(turn << 48)
            filled += int(first.sum())
        elif out[turn - size] == np.iinfo(np.uint64).max:
            out[turn - size] = value.min() | np.uint64(turn << 48)
            filled += 1
        if filled == size:
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    grid = coordinates.reshape(-1, ROWS)
    key = np.arange(1, len(grid) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return key.view(np.int64)


def _sketcher(words: int, percent: int, with_sets: bool):
    bands = bands_for(percent)
    # two different sets of the threshold's similarity have a size of at least this between them
    least = math.ceil(percent / (100 - percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in (whole.slice(lo, PART) for whole in batches for lo in range(0, max(1, len(whole)), PART)):
            sizes, names, lists = [], [], []
            for text in batch.column(1):
                members = shingle_set(text.as_py(), words)
                sizes.append(len(members))
                names.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                if with_sets:
                    lists.append(members.view(np.int64))
                else:
                    lists.append(band_keys(sketch(members, bands * ROWS)) if len(members) >= least else np.empty(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = np.concatenate(lists) if lists else np.empty(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), column], ["id", "n", "cls", "list"])

    return run


def _sketched(docs: DataFrame, words: int, percent: int, with_sets: bool) -> DataFrame:
    """(id, n, cls, list) of docs(id, text): the set's size and name, and its elements or its band keys."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("list", T.ArrayType(T.LongType()))])
    return docs.select("id", "text").mapInArrow(_sketcher(words, percent, with_sets), schema)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(num, comp) for the ends of links(a, b): comp is the least number reachable. Alternates large and small stars (Kiveris et al., 2014)."""
    turned = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges = scratch.write(turned(links), "edges")
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = turned(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        last, edges = edges, scratch.write(turned(small), "edges")
        scratch.drop(last)
        after = mark(edges)
        if after == before:
            roots = edges.select(F.col("b").alias("num")).distinct().select("num", F.col("num").alias("comp"))
            return edges.select(F.col("a").alias("num"), F.col("b").alias("comp")).union(roots)
        before = after


def verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity. Few pairs go to the sets, so that only sets in question move."""
    pairs = scratch.write(pairs, "pairs")
    few = pairs.count() <= MOST_BROADCAST
    sent = F.broadcast if few else (lambda df: df)
    one = sets.select(F.col("num").alias("a"), F.col("list").alias("a_set")).join(sent(pairs), "a")
    two = sets.select(F.col("num").alias("b"), F.col("list").alias("b_set")).join(sent(pairs.select("b").distinct()), "b", "left_semi")
    both = one.join(two, "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    return scratch.write(both.where(100 * F.col("common") >= percent * (F.size("a_set") + F.size("b_set") - F.col("common"))).select("a", "b"), "links")


def _salts(held: str) -> Column:
    """How many tasks a token's rows are dealt to."""
    return (F.floor(F.col(held) / HOT_ROWS) + 1).cast("int")


def join_by_token(rows: DataFrame, few: DataFrame, held: str) -> DataFrame:
    """rows(num, token, ...) join few(token, held, ...), one row a token: those of tokens with held over HOT_ROWS are dealt to _salts() tasks.

    few grows by less than a row for HOT_ROWS of the rows.
    """
    names = few.where(F.col(held) > HOT_ROWS).select("token", _salts(held).alias("salts"))
    if names.isEmpty():
        return rows.join(few, "token")
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(held) - 1)))
    if names.count() <= MOST_BROADCAST:
        names = F.broadcast(names)
    salt = F.coalesce(F.pmod(F.xxhash64("num"), F.col("salts")).cast("int"), F.lit(0))
    return rows.join(names, "token", "left").withColumn("salt", salt).drop("salts").join(few, ["token", "salt"]).drop("salt")


def prefix_pairs(sets: DataFrame, placed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components among placed(num, comp) that can have the similarity.

    Let n <= m be two sizes. The similarity needs an overlap of percent (n + m) / (100 + percent),
    which is percent m / 100 at least, and 2 percent n / (100 + percent) at least. So, with
    shingles in order of rarity, the smaller set shares one of its first
    n - ceil(2 percent n / (100 + percent)) + 1 with the larger one's first m - ceil(percent m / 100) + 1,
    and the first one shared leaves room for the overlap. Sets that share a common template
    and nothing else have their own shingles there, and never meet. Steps of length, each
    the threshold's ratio wide, are a part of the key. A shingle's rows outside its largest
    component meet all its rows; those inside do not meet one another.
    """
    tokens = sets.join(placed, "num").select("num", "comp", F.size("list").alias("n"), F.explode("list").alias("token"))
    counts = scratch.write(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token-counts")
    tokens = join_by_token(tokens, counts, "df")
    # shingles of one set only come first in the order; they are left out, and counted into the positions
    ordered = tokens.groupBy("num", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    own = F.col("n") - F.size("t")
    long_reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    short_reach = F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
    shared = F.slice("t", F.lit(1), F.greatest(F.lit(0), (long_reach - own).cast("int")))
    prefix = ordered.select("num", "comp", "n", own.alias("own"), short_reach.alias("short"), F.posexplode(shared).alias("at", "t"))
    step = F.log(F.col("n").cast("double")) / math.log(100 / percent)
    prefix = prefix.select("num", "comp", "n", (F.col("own") + F.col("at")).alias("pos"), "short", F.col("t.token").alias("token"), step.alias("step"))
    prefix = scratch.write(prefix, "prefixes")
    by_part = prefix.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = by_part.groupBy("token").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("parts"), F.sum("k").alias("held")).where("parts > 1").drop("parts")
    mixed = scratch.write(join_by_token(prefix, scratch.write(mixed, "mixed-tokens"), "held"), "mixed-prefixes")

    side = lambda s: mixed.select("token", "main", "held", "short", "step", *[F.col(c).alias(f"{c}{s}") for c in ("num", "comp", "n", "pos")])
    slack = F.lit(1e-9)
    short = side(1).where("pos1 < short").withColumn("level", F.explode(F.sequence(F.floor(F.col("step") - slack), F.floor(F.col("step") + 1 + slack)))).drop("step", "short")
    long = side(2).withColumn("level", F.floor("step")).drop("step", "short")
    # a hot token's rows are dealt out; those outside its largest component go to every salt
    dealt = lambda df, num: df.withColumn("salt", F.pmod(F.xxhash64(num), _salts("held")).cast("int"))
    sent = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts("held") - 1)))
    others = ["main", "held"]
    keys = ["token", "level", "salt"]
    from_outside = sent(short.where("comp1 <> main")).join(dealt(long, "num2").drop(*others), keys)
    from_main = dealt(short.where("comp1 = main"), "num1").join(sent(long.where("comp2 <> main")).drop(*others), keys)
    meet = from_outside.unionByName(from_main).where("comp1 <> comp2 AND (n1 < n2 OR n1 = n2 AND num1 < num2)")
    room = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))
    meet = meet.where(room & (100 * F.col("n1") >= percent * F.col("n2")))
    return meet.select(F.greatest("num1", "num2").alias("a"), F.least("num1", "num2").alias("b")).distinct()


def _by_id(docs: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """docs joined to few on `id`, null ids being equal; few goes to docs where it is small, so that no text moves."""
    few = few.withColumnRenamed("id", "__id")
    if few.count() <= MOST_IDS:
        few = F.broadcast(few)
    return docs.join(few, F.col("id").eqNullSafe(F.col("__id")), how).drop("__id")


def linked(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, comp) for each row of docs(id, text): comp is the least id of the row's component; see near_duplicates."""
    with Scratch(docs.sparkSession, "near-dup") as scratch:
        rows = scratch.write(_sketched(docs, words, percent, False), "sketches")
        classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("list").alias("list"))
        classes = scratch.write(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
        banded = classes.select("num", "n", F.explode("list").alias("key"))
        shared = banded.groupBy("key").agg(F.min(F.struct("num", "n")).alias("pivot"), F.max("num").alias("last")).where("pivot.num <> last")
        members = scratch.write(banded.join(shared, "key").select("key", "num", "n", "pivot"), "members")
        wanted = classes.join(members.select("num").distinct(), "num", "left_semi").select("num", "cls", F.col("rep").alias("id"))
        wanted = scratch.write(wanted, "wanted")
        texts = _by_id(docs, wanted.select("id").distinct(), "left_semi")
        found = _sketched(texts, words, percent, True).select("cls", "list")
        sets = scratch.write(found.join(F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted, "cls").select("num", "list"), "sets")
        if sets.count() > wanted.count():
            # some texts stand under their id more than once
            sets = scratch.write(sets.groupBy("num").agg(F.any_value("list").alias("list")), "sets")

        near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
        pairs = members.where("num <> pivot.num").where(near("n", "pivot.n")).select(F.col("num").alias("a"), F.col("pivot.num").alias("b")).distinct()
        links = verified(pairs, sets, percent, scratch)
        worth = True
        for turn in range(1, ROUNDS + 1):
            labels = scratch.write(components(links, scratch), "labels")
            placed = scratch.write(members.join(labels, "num", "left").select("key", "num", "n", F.coalesce("comp", "num").alias("comp")), "placed")
            # of each bucket the largest component, and some of its classes by chance
            some = [F.min_by(F.struct("num", "n"), F.xxhash64(F.lit(turn), F.lit(i), "num")) for i in range(CHOICE)]
            parts = placed.groupBy("key", "comp").agg(F.count("*").alias("k"), F.array(*some).alias("some"))
            mixed = parts.groupBy("key").agg(F.max_by(F.struct("comp", "some"), F.struct("k", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
            mixed = scratch.write(mixed.select("key", "main"), "mixed")
            if turn == ROUNDS or not worth or mixed.isEmpty():
                break
            other = F.get("main.some", F.pmod(F.xxhash64("num", "key"), F.lit(CHOICE)).cast("int"))
            pairs = placed.join(mixed, "key").where("comp <> main.comp").withColumn("other", other).where(near("n", "other.n"))
            pairs = scratch.write(pairs.select(F.greatest("num", "other.num").alias("a"), F.least("num", "other.num").alias("b")).distinct(), "asked")
            more = verified(pairs, sets, percent, scratch)
            worth = more.count() >= WORTH * pairs.count()
            links = scratch.write(links.union(more), "links")
        if not mixed.isEmpty():
            placed = scratch.write(placed.join(mixed, "key", "left_semi").select("num", "comp").distinct(), "placed")
            more = verified(prefix_pairs(sets, placed, percent, scratch), sets, percent, scratch)
            labels = components(labels.select(F.col("num").alias("a"), F.col("comp").alias("b")).union(more), scratch)
        ends = scratch.write(labels.join(classes.select("num", "cls", "rep"), "num"), "ends")
        least = ends.groupBy("comp").agg(F.min("rep").alias("least"))
        named = classes.select("cls", "rep").join(ends.join(least, "comp").select("cls", "least"), "cls", "left").select("cls", F.coalesce("least", "rep").alias("comp"))
        out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
        return materialize(out.select("id", "n", F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")).alias("comp")), "near-dup")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id_col, `n_shingles`, `component_id` (the least id reachable over links), `kept` for each row of docs.

    Two texts are linked if their sets of distinct word shingles have a Jaccard
    similarity of percent or more. Null and empty texts have no shingles and no links.
    Rows are linked by their texts: an id that stands on several rows may be in several
    components, and rows with a null id take part; they name a component (by null) only
    if it has no other id, and are never kept. Other columns are ignored; no rows give
    no rows.
    """
    out = linked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(False)).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one for each group of near-duplicates, unchanged: the group's first by id, a null first.

    Rows of one id are told apart by a hash of all their columns, 128 bits long; of rows
    alike in everything one stays, all if they have no words. Only ids move: rows that go
    are named to the rows, and rows alike in everything are added up where they stand.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(*columns).alias("one"), F.xxhash64(F.lit("two"), *columns).alias("two"))
    out = linked(docs.select(key.alias("id"), F.col(text_col).alias("text")), words, percent).where("n > 0")
    again = out.where("id = comp").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    marks = out.where("id <> comp").select("id", F.lit(False).alias("once")).distinct().union(again.select("id", F.lit(True)))
    marks = materialize(marks, "near-dup-marks")
    rows = _by_id(docs.select(F.struct(*columns).alias("row"), key.alias("id")), marks, "left")
    kept = rows.where("once IS NULL").select("row.*")
    if marks.where("once").isEmpty():
        return kept
    return kept.union(rows.where("once").groupBy("id").agg(F.any_value("row").alias("row")).select("row.*"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i+2], ' '))) AS s FROM words WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""
