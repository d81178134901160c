"""Exact top-k search by MaxScore over integer vectors.

Terms are the dimensions. A shard keeps each term's postings as one array in document order, cut into blocks with the
least and greatest weight of each term, which bound what a query's term can add within the block. Terms are ordered by
that bound; the longest run of the weakest terms whose bounds together don't exceed the k-th score so far is
non-essential. Essential postings are traversed in full; documents whose partial score plus the bounds still to come
stays below the k-th score are dropped, and the others are probed term by term while they are competitive. The shards'
results are merged by a ranked window.

Shards and query blocks have a fixed number of rows, so a task's memory doesn't grow with the tables; a stated query set
meets all shards, block by block.

Defined results: vectors that are null, or hold a null or non-finite component, or have a null id, take no part; where
dimensions differ, missing components count as 0; repeated rows are separate candidates, but identical query rows ask
once; candidates with the query's id are left out; scores outside 64 bits saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import remote2

BLOCK = 4096
LIMIT = 1 << 62
HITS = "query_id long, vec_id long, score long"


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double, in 64 bits."""
    return F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(1 << 61))), F.lit(-float(1 << 61)))))


def usable(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(rows[order].T)  # term -> weights in document order
        self.blocks = []
        for at in range(0, len(ids), BLOCK):
            part = self.postings[:, at : at + BLOCK]
            self.blocks.append((at, min(len(ids), at + BLOCK), part.max(1), part.min(1)))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by (-score, id)."""
        best_ids, best = np.empty(0, np.int64), np.empty(0, self.postings.dtype)
        floor = None
        for start, end, high, low in self.blocks:
            bound = np.maximum(query * high, query * low)
            order = np.argsort(bound, kind="stable")
            rest = 0
            split = 0
            if floor is not None:
                sums = np.cumsum(bound[order])
                if sums[-1] < floor:
                    continue
                over = np.flatnonzero(sums > max(floor, 0))
                split = min(int(over[0]) if len(over) else len(order), len(order) - 1)  # terms before it are non-essential
                rest = sums[split - 1] if split else 0
            score = np.zeros(end - start, self.postings.dtype)
            for t in order[split:]:
                if query[t]:
                    score += query[t] * self.postings[t, start:end]
            if floor is None:
                live = np.arange(end - start)
            else:
                live = np.flatnonzero(score + rest >= floor)
                score = score[live]
                for t in order[:split][::-1]:  # strongest bound first
                    if not len(live):
                        break
                    score = score + query[t] * self.postings[t, start + live]
                    rest = rest - bound[t]
                    keep = score + rest >= floor
                    live, score = live[keep], score[keep]
            ids = self.ids[start + live]
            other = ids != query_id
            best_ids, best = np.concatenate([best_ids, ids[other]]), np.concatenate([best, score[other]])
            if len(best) > k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                keep = best >= kth
                best_ids, best = best_ids[keep], best[keep]
                first = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[first], best[first]
            if len(best) >= k:
                floor = best.min()
        return best_ids, best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    lens = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def search_shard(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """One shard against one query block: (query_id, vec_id, score) of each query's k best within the shard."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not rows.num_rows or not queries.num_rows:
        return schema.empty_table()
    width = max(max(len(x) for x in t.column("v").to_pylist()) if t.num_rows else 0 for t in (rows, queries))
    v, q = _matrix(rows.column("v"), width), _matrix(queries.column("v"), width)
    most = max(width, 1) * (int(np.abs(v).max(initial=0)) or 1) * (int(np.abs(q).max(initial=0)) or 1)
    kind = np.int32 if 2 * most < 1 << 31 else np.int64 if 2 * most < LIMIT else object
    shard = Shard(rows.column("vec_id").to_numpy(), v.astype(kind))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query_id, query in zip(queries.column("vec_id").to_pylist(), q.astype(kind)):
        ids, scores = shard.search(query_id, query, k)
        if kind is object:
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores], np.int64)
        out.append((np.full(len(ids), query_id, np.int64), ids, scores.astype(np.int64)))
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)


def topk(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 32_768, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row that satisfies ``is_query``, against every other row."""
    usable_rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = usable_rows.select("vec_id", quantised(F.col("embedding")).alias("v"))
    queries = usable_rows.where(is_query).select("vec_id", quantised(F.col("embedding")).alias("v")).dropDuplicates(["vec_id", "v"])
    sizes = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards = max(1, -(-sizes["n"] // shard_rows), min(12, -(-sizes["n"] // 1024)))
    blocks = max(1, -(-sizes["q"] // query_rows))
    salt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    left = rows.select("vec_id", "v", salt(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("vec_id", "v", salt(blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(remote2(search_shard, k), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
