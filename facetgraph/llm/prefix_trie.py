"""Operator 11: a trie of conversation prefixes by truncation peeling.

From the greatest depth down, each step takes the nodes of one depth: those that survive
from the depth below, truncated by their last turn, and the ends of the conversations
that are just so long. They are regrouped by their prefix, and a group is a node, whose
measures are the sums of what was merged into it. What a step finds goes on to the next.

A step is one aggregation with sums on the map side, so that a first turn that most
conversations share is no single group. Texts stay where they are: a turn is a digest of
128 bits and a number of words. A conversation's prefixes below the last one that it
shares are nodes of it alone; they need no regrouping and are given at once, so that the
peeling starts at the greatest depth that two conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.llm.common import table, word_count
from facetgraph.sources.scratch import Scratch, written

#: Depths that one job peels, and ids that are joined to one text on the way to a node's digest.
DEPTHS, IDS = 8, 4096
#: A key that more than this part of the rows share is joined by broadcast; there are at most HOT such keys.
HOT = 10_000
ROOT = b"\0" * 16
#: The digest of no ids.
NO_IDS = hashlib.sha256(b"").hexdigest()


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as array<struct<digest, words>>.

    Order: turn (null first), then role and text. Rows without a conv_id take no part.
    """
    role, text = _text("role"), _text("text")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").isNotNull().alias("placed"), "turn", role.alias("role"), F.md5(text).alias("text"), digest.alias("digest"), word_count("text").alias("words")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """turns with each conversation's first h turns replaced by those of the first one of its block, h being crc32(conv_id) modulo heads."""
    base = turns.where(f"conv_id % {block} = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = turns.withColumns({"base": F.expr(f"conv_id - conv_id % {block}"), "h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")})
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.expr("array()").cast(turns.schema["turns"].dataType))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(base, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conv_id and turns to rows of DEPTHS prefixes each: a prefix's key is a digest of the key before it and of its last turn."""
    names = ["conv_id", "size", "block", "above", "keys", "words"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    for batch in batches:
        rows, columns = [], [[] for _ in kinds]
        for row, turns in enumerate(batch.column(1)):
            key, size = ROOT, len(turns)
            for start in range(0, max(size, 1), DEPTHS):
                above, keys, words = key, [], []
                for turn in turns.values[start : start + DEPTHS].to_pylist() if size else ():
                    key = hashlib.blake2b(key + turn["digest"], digest_size=16).digest()
                    keys.append(key)
                    words.append(turn["words"])
                rows.append(row)
                for c, v in zip(columns, (size, start // DEPTHS, above, keys, words)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of key and conv_id, sorted, to rows of key, conv_id (the first), n and the ids as text, IDS at most in each."""
    key, ids = None, []

    def flush() -> None:
        if ids:
            for c, v in zip(out, (key, ids[0], len(ids), ",".join(map(str, ids)))):
                c.append(v)

    for batch in batches:
        out = [[], [], [], []]
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or len(ids) == IDS:
                flush()
                key, ids = k, []
            ids.append(i)
        yield _id_rows(out, pa.string())
    out = [[], [], [], []]
    flush()
    yield _id_rows(out, pa.string())


def _id_rows(out: list[list], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), kind))], ["key", "conv_id", "n", "ids"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _id_texts(), sorted, to a row for each key: key, conv_id (the first), n and the digest of all its ids."""
    state = None

    def flush() -> None:
        if state:
            for c, v in zip(out, (*state[:3], state[3].hexdigest())):
                c.append(v)

    for batch in batches:
        out = [[], [], [], []]
        for k, i, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if state and state[0] == k:
                state[2] += n
                state[3].update(b"," + ids.encode())
            else:
                flush()
                state = [k, i, n, hashlib.sha256(ids.encode())]
        yield _id_rows(out, pa.string())
    out = [[], [], [], []]
    flush()
    yield _id_rows(out, pa.string())


def ended_together(ends: DataFrame) -> DataFrame:
    """(key, conv_id, n, ids): for each key of ends(key, conv_id) the smallest id, how many there are, and the digest of all, ascending.

    Ids are sorted over all tasks and joined to texts of IDS each. A key's texts then go
    through one digest, which by its nature is sequential, row by row and holding none.
    """
    texts = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_id_texts, "key binary, conv_id long, n long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_id_digests, "key binary, conv_id long, n long, ids string")


def _with_parents(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """rows(above) with parent_conv_id from nodes(key, conv_id, n_children). Parents of more than a HOT-th of total, HOT at most, are broadcast."""
    parents = nodes.select("key", F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * HOT > total).alias("hot"))
    hot, rest = F.broadcast(parents.where("hot").drop("hot")), parents.where("NOT hot").drop("hot")
    of_hot = rows.join(hot, F.col("above") == F.col("key")).drop("key")
    others = rows.join(hot, F.col("above") == F.col("key"), "left_anti")
    return of_hot.unionByName(others.join(rest.withColumnRenamed("key", "__key"), F.col("above") == F.col("__key")).drop("__key"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of turns(conv_id, turns), as turn_digests() gives them: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns ends at the root. Turns are equal if their digests of
    128 bits are. No conversations have no root.
    """
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    with Scratch(turns.sparkSession, "trie") as scratch:
        own = turns.schema["conv_id"].dataType.simpleString()
        pieces = turns.select("conv_id", "turns").mapInArrow(_chained, f"conv_id {own}, size int, block int, above binary, keys array<binary>, words array<bigint>")
        pieces = scratch.write(pieces.withColumn("conv_id", F.col("conv_id").cast("long")), "pieces")
        above = F.when(F.col("i") == 0, F.col("above")).otherwise(F.get("keys", F.col("i") - 1))
        prefixes = pieces.select("conv_id", "size", "block", "above", "keys", F.posexplode("keys").alias("i", "key"))
        prefixes = prefixes.select("conv_id", (F.col("block") * DEPTHS + F.col("i") + 1).alias("depth"), "key", above.alias("above"))
        held = prefixes.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("above").alias("above"))
        held = scratch.write(held, "held")
        # from which depth on a conversation is alone, and the prefix where it meets another or the root
        alone = held.where("n = 1").groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("size"), F.min_by("above", "depth").alias("above"))
        alone = scratch.write(alone, "alone")
        deepest = held.where("n > 1").agg(F.max("depth")).first()[0] or 0

        tails = alone.select("conv_id", (F.col("top") - 1).alias("depth"), F.lit(1).alias("n_convs"), F.lit(1).alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(None).cast("string").alias("ends"))
        last = pieces.where(F.col("block") == F.greatest(F.lit(0), F.expr(f"(size - 1) div {DEPTHS}")))
        last = last.select("conv_id", "size", F.coalesce(F.get("keys", F.size("keys") - 1), F.col("above")).alias("key"))
        ended = last.join(alone.select("conv_id"), "conv_id", "left_anti")
        ended = scratch.write(ended, "ended")
        sizes = ended.groupBy("key").agg(F.min("size").alias("depth"))
        groups = ended_together(ended).join(sizes, "key")
        ended = groups.select("conv_id", "depth", F.col("n").alias("n_convs"), F.lit(0).alias("n_children"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.col("ids").alias("ends"))
        entering = scratch.write(tails.union(ended).select("conv_id", "depth", *[F.col(c).cast("long").alias(c) for c in sums], "ends"), "entering")

        found, survivors, block = [], entering.limit(0), None
        for depth in range(deepest, -1, -1):
            if depth and (depth - 1) // DEPTHS != block:
                block = (depth - 1) // DEPTHS
                rows = survivors.select(entering.columns).union(entering.where(F.col("depth").between(block * DEPTHS + 1, depth)))
                piece = pieces.where(F.col("block") == block).select("conv_id", "above", "keys", "words")
                rows = scratch.write(rows.join(piece, "conv_id"), "rows")
                survivors = rows.limit(0)
            i = depth - 1 - block * DEPTHS if depth else None
            if depth:
                at = rows.where(F.col("depth") == depth).unionByName(survivors)
                at = at.withColumns({"key": F.get("keys", F.lit(i)), "last": F.get("words", F.lit(i)), "up": F.get("keys", F.lit(i - 1)) if i else F.col("above")})
                kept = [F.any_value(c).alias(c) for c in ("last", "up", "above", "keys", "words")]
            else:
                at = survivors.select(entering.columns).union(entering.where("depth = 0"))
                at = at.withColumn("key", F.lit(bytearray(ROOT)))
                kept = [F.lit(0).alias("last"), F.lit(None).cast("binary").alias("up")]
            nodes = at.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.any_value(F.lit(depth)).alias("depth"), *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends"), *kept)
            more = (F.col("n_convs") - 1) * F.col("last")
            nodes = nodes.withColumns({"n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")), "saved_tokens": F.col("saved_tokens") + more})
            nodes = scratch.write(nodes, f"depth-{depth}")
            found.append(nodes.select("key", F.col("up").alias("above"), "conv_id", "depth", *sums, "ends"))
            if depth:
                # truncated: one turn less, a child of the node that it merges into
                survivors = nodes.withColumns({"depth": F.col("depth") - 1, "n_children": F.lit(1).cast("long"), "ends": F.lit(None).cast("string")}).select(rows.columns)
        nodes = found[0]
        for more in found[1:]:
            nodes = nodes.union(more)
        nodes = scratch.write(nodes, "nodes")
        total = held.count()
        of_ids = F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256")
        shared = _with_parents(nodes.where("depth > 0").drop("key"), nodes, total).select("conv_id", "depth", "parent_conv_id", *sums, of_ids)
        root = nodes.where("depth = 0").select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), *sums, of_ids)
        lone = _with_parents(alone, nodes, total).withColumn("depth", F.explode(F.sequence("top", "size")))
        end = F.col("depth") == F.col("size")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        lone = lone.select("conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(end, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_IDS).alias("ends_sha256"))
        out = root.union(shared).union(lone)
        return written(out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *sums, "ends_sha256"), "trie")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of conversations(conv_id, turn, role, text), each rebuilt with the first turns of its block (see rebuilt()).

    Null roles and texts are empty ones; rows without a conv_id take no part; turns of
    equal number are ordered by role and text; other columns are ignored; no rows give
    no rows. A conversation is one value in a task, 24 bytes a turn.
    """
    turns = written(turn_digests(conversations), "turns")
    return prefix_trie(rebuilt(turns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH placed AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'t': concat(length(role), ':', role, text), 'w': CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT)} ORDER BY turn NULLS FIRST, role, md5(text)) AS turns FROM placed GROUP BY conv_id
), crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t FROM (SELECT unnest(range(0, 256)) AS v)
), crc AS (
  SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM own, crc_table
), rebuilt AS (
  SELECT o.conv_id, CASE WHEN o.conv_id % 20 = 0 THEN o.turns ELSE list_concat(coalesce(b.turns[1:h], []), o.turns[h+1:]) END AS turns
  FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, len(turns) AS n, md5(array_to_string(list_transform(turns[1:d], lambda x: md5(x.t)), '')) AS key, CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM prefixes GROUP BY key, d
), up AS (
  SELECT n.key, n.d, p.key AS above, q.conv_id AS parent_conv_id FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d = n.d - 1 JOIN nodes q ON q.key = p.key AND q.d = p.d
), below AS (SELECT above AS key, count(*) AS n FROM up GROUP BY above),
sums AS (
  SELECT p.key, p.d, sum(CASE WHEN b.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved
  FROM nodes n LEFT JOIN below b ON b.key = n.key JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.key, p.d
)
SELECT n.conv_id, n.d AS depth, u.parent_conv_id, n.n_convs, coalesce(b.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key AND s.d = n.d LEFT JOIN up u ON u.key = n.key AND u.d = n.d LEFT JOIN below b ON b.key = n.key
"""
