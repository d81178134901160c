"""Rank correlation of two distances over all pairs, without sorting or shuffling the pairs.

A pass over all pairs counts both distances in fine bins; a bin's mean rank is exact. Then ranges of bins that fit a task
are gone through once more: each task makes all pairs again, keeps those whose distance is in its range and ranks them exactly, ties at their mean.
With ranks as the mean of a bin (c) and what is left (u for one, v for the other distance), the sum of products of ranks is
sum((c + u) * d) + sum(c * (d + v)) - sum(c * d) + sum(u * v); the last, which no task sees, is at most the root of sum(u * u) * sum(v * v). Unless
that is below LEAST of the variance, pairs are sorted instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..runtime import remote, remote1, staged
from . import analytics as A
from . import distances as D

#: Bins of a distance: the first 18 bits of the mantissa over 8 octaves. Pairs that a task ranks (8 bytes each). Bins of one message.
BITS, BINS, MOST_PAIRS, CHUNK = 18, 1 << 21, 3 << 24, 1 << 16
LEAST = 1e-9
_SHIFT = 52 - BITS


def _bins(dist: np.ndarray, base: int) -> np.ndarray:
    return np.clip((dist.view(np.int64) >> _SHIFT) - base, 0, BINS - 1)


def _made(kinds: list[D.Kind], queries: str, codes: str, some: Callable[[int], bool] = lambda k: True) -> Iterator[tuple]:
    """(query ids, ids, distances of the first kind, the operands of the second, first row and column) of all tiles, or those of some batches of codes."""
    for few in D.staged_batches(queries, D.QUERY_ROWS):
        q_ids, left = few.column("id").to_numpy(), D._operands(kinds, few, True)
        for k, batch in enumerate(D.staged_batches(codes, D.SHARD_ROWS)):
            if some(k):
                ids, right = batch.column("id").to_numpy(), D._operands(kinds, batch, False)
                top = side = 0
                for q, v, dists in D.tiles(kinds[:1], q_ids, left[:1], ids, right[:1]):
                    yield q, v, dists[0], left[-1], right[-1], top, side
                    top += len(q)
                    if top == len(q_ids):
                        top, side = 0, side + len(v)


def count_batches(batches: Iterator[pa.RecordBatch], tasks: int, kinds: list[D.Kind], bases: list[int], queries: str, codes: str) -> Iterator[pa.RecordBatch]:
    """Numbers of tasks to (kind, first bin, numbers of pairs in CHUNK bins)."""
    for task in [n for batch in batches for n in batch.column(0).to_pylist()]:
        for number, kind in enumerate(kinds):
            counts, held, size = np.zeros(BINS, np.int64), [], 0
            for q, v, dist, *_ in _made([kind], queries, codes, lambda k: k % tasks == task):
                row, col = D.same(q, v)
                held.append(np.delete(_bins(dist.reshape(-1), bases[number]).astype(np.int32), row * len(v) + col))
                size += dist.size
                if size >= 1 << 22:
                    counts += np.bincount(np.concatenate(held), minlength=BINS)
                    held, size = [], 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=BINS)
            for at in range(0, BINS, CHUNK):
                if counts[at : at + CHUNK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([at], pa.int32()), pa.array([counts[at : at + CHUNK].tobytes()], pa.binary())], ["kind", "at", "counts"])


def summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in group.column("counts").to_pylist())
    return pa.table({"kind": group.column("kind")[:1], "at": group.column("at")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _edge(number: int, base: int) -> float:
    """The least distance of a bin."""
    return float(np.array([(number + base) << _SHIFT], np.int64).view(np.float64)[0]) if number else 0.0


def _middles(counts: np.ndarray) -> np.ndarray:
    """Mean ranks of bins, less the mean of all."""
    return np.cumsum(counts) - counts + (counts - float(counts.sum())) / 2


def range_batches(batches: Iterator[pa.RecordBatch], kinds: list[D.Kind], bases: list[int], counts: np.ndarray, ranges: list[tuple[int, int, int]], queries: str, codes: str) -> Iterator[pa.RecordBatch]:
    """Numbers of ranges (kind, first bin, bin behind the last) to (kind, pairs, sum of rank x other's middle, sum of middle x other's middle, sum of t**3 - t over ties)."""
    for number in [n for batch in batches for n in batch.column(0).to_pylist()]:
        kind, first, behind = ranges[number]
        low, high, last = _edge(first, bases[kind]), _edge(behind, bases[kind]), behind == BINS
        held, n = np.empty(int(counts[kind][first:behind].sum()) + 1024, np.uint64), 0
        for q, v, dist, left, right, top, side in _made([kinds[kind], kinds[1 - kind]], queries, codes):
            dist = dist.reshape(-1)
            at = np.flatnonzero(dist >= low if last else (dist >= low) & (dist < high))
            i, j = np.divmod(at, len(v))
            keep = q[i] != v[j]
            at, i, j = at[keep], i[keep], j[keep]
            other = _bins(K.of_pairs(left, right, i + top, j + side), bases[1 - kind]).astype(np.uint64)
            place = np.clip((dist[at] - low) * (2.0**40 / (high - low)), 0, 2.0**40 - 1).astype(np.uint64)
            if n + len(at) > len(held):
                held = np.append(held, np.empty(len(held) // 8 + len(at), np.uint64))
            held[n : n + len(at)] = (place << np.uint64(21)) | other
            n += len(at)
        held = held[:n]
        held.sort()
        below, bounds, middles, others = int(counts[kind][:first].sum()), np.cumsum(counts[kind][first:behind]), _middles(counts[kind])[first:behind], _middles(counts[1 - kind])
        ranked = middle = ties = 0.0
        mean, at = (float(counts[kind].sum()) + 1) / 2, 0
        while at < n:
            to = min(n, at + (1 << 20))
            to = int(np.searchsorted(held, ((held[to - 1] >> np.uint64(21)) + np.uint64(1)) << np.uint64(21)))  # ties stay together
            some = held[at:to]
            place, other = some >> np.uint64(21), others[(some & np.uint64(BINS - 1)).astype(np.int64)]
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            length = np.diff(np.append(starts, to - at)).astype(np.float64)
            ranked += float((below - mean + at + starts + (length + 1) / 2) @ np.add.reduceat(other, starts))
            middle += float(middles[np.minimum(np.searchsorted(bounds, np.arange(at, to), "right"), len(middles) - 1)] @ other)
            ties += float((length**3 - length).sum())
            at = to
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([n], pa.int64()), *(pa.array([x], pa.float64()) for x in (ranked, middle, ties))], ["kind", "n", "ranked", "middle", "ties"])


def spearman_of_pairs(queries: DataFrame, base: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): rank correlation of the exact distances of two vector columns over all pairs of a query and another row."""
    spark = base.sparkSession
    kinds = [(None, "exact", c, c) for c in (a, b)]
    sides = D.sides(queries, base, kinds)
    left, right = (staged(x, name) for x, name in zip(sides, ("queries", "codes")))
    most = [[x or 0.0 for x in side.agg(*[F.max(C.norm(C.doubles(F.col(c)))) for c in (a, b)]).first()] for side in (left, right)]
    tops = [(x + y) ** 2 * (1 + 1e-9) for x, y in zip(*most)]
    cores = spark.sparkContext.defaultParallelism
    out = "n long, rho double"
    if 0 < min(tops) and max(tops) < np.inf:
        bases = [max(0, (int(np.array([t]).view(np.int64)[0]) >> _SHIFT) - BINS + 1) for t in tops]
        found = spark.range(0, cores, 1, cores).mapInArrow(remote(count_batches, cores, kinds, bases, left._staged_at, right._staged_at), "kind int, at int, counts binary")
        counts = np.zeros((2, BINS), np.int64)
        for kind, at, some in zip(*(c.to_pylist() for c in found.groupBy("kind", "at").applyInArrow(remote1(summed), "kind int, at int, counts binary").toArrow().columns)):
            counts[kind, at : at + CHUNK] = np.frombuffer(some, np.int64)
        n = int(counts[0].sum())
        spread = [float((c.astype(np.float64) ** 3 - c).sum()) for c in counts]
        if n > 1 and counts.max() <= MOST_PAIRS and (spread[0] * spread[1]) ** 0.5 < LEAST * (float(n) ** 3 - n):
            ranges, each = [], max(1, min(MOST_PAIRS, -(-n // cores)))
            for kind in (0, 1):
                cum = np.cumsum(counts[kind])
                cuts = sorted({0, BINS, *(np.searchsorted(cum, np.arange(each, n, each)) + 1).tolist()})
                ranges += [(kind, x, y) for x, y in zip(cuts, cuts[1:])]
            sums = spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(remote(range_batches, kinds, bases, counts, ranges, left._staged_at, right._staged_at), "kind int, n long, ranked double, middle double, ties double")
            rows = {r["kind"]: r for r in sums.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n", "ranked", "middle", "ties")]).collect()}
            variance = [float(n) ** 3 - n - rows[kind]["ties"] for kind in (0, 1)]
            if min(variance) > 0:
                rho = 12 * (rows[0]["ranked"] + rows[1]["ranked"] - rows[0]["middle"]) / (variance[0] * variance[1]) ** 0.5
                return spark.createDataFrame([(n, float(rho))], out)
    pairs = D.side_by_side(left.withColumnRenamed("id", "query_id"), right.withColumnRenamed("id", "vec_id"), dict(zip(("a", "b"), kinds)))
    return A.spearman(pairs.where("query_id <> vec_id"), "a", "b")
