"""Operator 3: exact top-k search by MaxScore.

Terms are the components of a vector, their postings the columns of a shard of
candidates. A term's score bound in a shard is the most that its component of the query
can add over the least that it adds anyway. With the terms in order of their bounds,
those whose bounds together stay below the k-th best score so far are non-essential.
The essential postings are traversed; of the others, the largest bound first, only
candidates that can still compete are probed. Shards' results are merged by rank.

The first shard is searched before the others: the k-th best score that a query has
there is its floor in all of them, so that they start with non-essential terms and
return only what can still be among the k best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.llm.common import materialize, table

#: Candidates in a shard, queries in a block, candidates between two looks at the k-th best score, terms probed at once.
SHARD, BLOCK, STEP, PROBE = 4096, 4096, 1024, 4


def max_score(ids: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, query_id: int, query: np.ndarray, k: int, least_score: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of the k best rows of postings (rows x terms, by rising id), ties to smaller ids; none below least_score."""
    ends = np.stack([query * low, query * high])
    least, most = ends.min(0), ends.max(0)
    terms = np.argsort(most - least, kind="stable")
    reachable = least.sum() + np.cumsum((most - least)[terms])
    best_ids, best = np.empty(0, ids.dtype), np.empty(0, postings.dtype)
    for start in range(0, len(ids), STEP):
        rows = np.arange(start, min(start + STEP, len(ids)))
        rows = rows[ids[rows] != query_id]
        floor = best[-1] if len(best) == k else None
        if least_score is not None:
            floor = least_score if floor is None else max(floor, least_score)
        split = 0 if floor is None else int(np.searchsorted(reachable, floor, "left"))
        if split == len(terms) and (len(terms) or floor is not None and floor > 0):
            continue
        essential, others = terms[split:], terms[:split][::-1]
        bound = postings[rows][:, essential] @ query[essential] + most[others].sum()
        for i in range(0, len(others), PROBE):
            stay = bound >= floor
            rows, bound = rows[stay], bound[stay]
            probed = others[i : i + PROBE]
            bound = bound - most[probed].sum() + postings[rows][:, probed] @ query[probed]
        if floor is not None:
            stay = bound >= floor
            rows, bound = rows[stay], bound[stay]
        best_ids, best = np.concatenate((best_ids, ids[rows])), np.concatenate((best, bound))
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _searcher(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], []]
        if len(candidates) and len(queries):
            candidates = candidates.sort_by("vec_id")
            width = max(max(len(x) for x in t.column("terms")) for t in (candidates, queries))
            rows, asked = _matrix(candidates.column("terms"), width), _matrix(queries.column("terms"), width)
            if float(np.abs(rows).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(width, 1) < 2**52:
                rows, asked = rows.astype(np.float64), asked.astype(np.float64)  # exact below 2**53, and faster
            ids = candidates.column("vec_id").to_numpy()
            low, high = rows.min(0), rows.max(0)
            for query_id, query, floor in zip(queries.column("vec_id").to_pylist(), asked, queries.column("floor").to_pylist(), strict=True):
                best, scores = max_score(ids, rows, low, high, query_id, query, k, floor)
                found[0] += [query_id] * len(best)
                found[1] += best.tolist()
                found[2] += scores.astype(np.int64).tolist()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of vectors(vec_id, terms), terms being whole numbers.

    A shard and a block of queries, both bounded in rows, meet in a task; in the worst case,
    when no floor helps, each vector is sent once for BLOCK queries and each query once for
    SHARD vectors. A query never meets
    rows of its own vec_id; ties go to the smaller vec_id; missing components count 0.
    Equal rows are one row. Scores must fit a long.
    """
    vectors, queries = materialize(vectors.distinct(), "vectors"), materialize(queries.distinct(), "queries")
    shards, blocks = max(1, math.ceil(vectors.count() / SHARD)), max(1, math.ceil(queries.count() / BLOCK))
    every = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "terms"), F.lit(n)).cast("int")
    candidates = vectors.withColumn("shard", part(shards))
    queries = queries.withColumn("block", part(blocks))

    def search(rows: DataFrame, asked: DataFrame) -> DataFrame:
        rows = rows.withColumn("block", every(0, blocks))
        return rows.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_searcher(k), "query_id long, vec_id long, score long")

    found = search(candidates.where("shard = 0"), queries.withColumn("shard", F.lit(0)).withColumn("floor", F.lit(None).cast("double")))
    if shards > 1:
        found = materialize(found.distinct(), "first-shard")
        # rows that share a vec_id ask for each other's scores too: the least floor serves all of them
        floors = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy(F.col("query_id").alias("vec_id"))
        floors = floors.agg(F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score"), False), k)).cast("double").alias("floor"))
        repeated = queries.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("repeated"))
        asked = queries.join(floors, "vec_id", "left").join(repeated, "vec_id", "left")
        asked = asked.withColumn("floor", F.when(F.col("repeated").isNull(), F.col("floor"))).drop("repeated")
        found = found.union(search(candidates.where("shard > 0"), asked.withColumn("shard", every(1, shards))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component. Rows with a null id or vector, or a component null or not finite, are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("terms"))


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.t, c.t), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
