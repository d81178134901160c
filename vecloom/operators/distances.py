"""Distances of all pairs, and searches among them, in tiles.

Queries meet codes tile by tile: a few queries (counted, at most ``BROADCAST_QUERIES``) travel with the function and the
codes are scanned where they lie; of more queries each task has some, and streams all codes, which are staged once, past
them. Tiles are matrix products of at most ``TILE`` pairs, and so are the batches of pairs that leave a task. A search keeps k rows
per query and task; candidates come from products in single precision and are decided by distances of their own in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.space import Space
from ..runtime import remote, staged
from .codes import matrix, unpacked

MODES = ("asym", "sym", "light", "full", "exact")
PAIRS = "query_id long, vec_id long, dist double"
BROADCAST_QUERIES = 8192
#: Rows of codes that are decoded together, queries that a task holds together, pairs of a tile, columns of a tile.
SHARD_ROWS, QUERY_ROWS, TILE, STRIP = 8192, 16_384, 1 << 18, 2048
#: (space, mode, the queries' column, the codes' column): one kind of distance.
Kind = tuple[Space | None, str, str, str]


def _operands(kinds: list[Kind], batch, left: bool) -> list[K.Operand]:
    """Of each kind, that of a batch (columns by name); what kinds share is decoded once."""
    made, out = {}, []
    for space, mode, *cols in kinds:
        raw = mode == "exact" or (mode == "asym" and left)
        key = (cols[0 if left else 1], space if mode != "exact" else None, raw)
        if key not in made:
            values = batch.column(key[0])
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            if not raw:
                made[key] = K.decode(space, unpacked(space, values))
            else:
                dim = space.dim if mode != "exact" else len(values[0]) if len(values) else 1
                made[key] = matrix(values, dim)[0] if mode == "exact" else K.prepare(space, matrix(values, dim)[0])
        out.append(K.operand(space, mode, made[key]))
    return out


def tiles(kinds: list[Kind], query_ids: np.ndarray, left: list[K.Operand], ids: np.ndarray, right: list[K.Operand]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(query ids, ids, a matrix of distances of each kind) of all pairs, at most TILE at once."""
    for at in range(0, len(ids), STRIP):
        cols = slice(at, at + STRIP)
        few = [b.rows(cols) for b in right]
        step = max(1, TILE // len(ids[cols]))
        for top in range(0, len(query_ids), step):
            rows = slice(top, top + step)
            yield query_ids[rows], ids[cols], [K.tile(a.rows(rows), b) for a, b in zip(left, few)]


class All:
    """Every pair, with a column for each kind of distance."""

    def __init__(self, kinds: list[Kind], names: list[str], query_ids: np.ndarray, left: list[K.Operand]):
        self.args, self.names = (kinds, query_ids, left), names

    def add(self, ids: np.ndarray, right: list[K.Operand]) -> Iterator[pa.RecordBatch]:
        for q, v, dists in tiles(*self.args, ids, right):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, len(v))), pa.array(np.tile(v, len(q))), *(pa.array(d.reshape(-1)) for d in dists)], ["query_id", "vec_id", *self.names])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def same(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a tile's pairs of a row with itself."""
    if not len(np.intersect1d(q, v)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.nonzero(q[:, None] == v)


class Errors:
    """Of each kind but the first, which is the truth: (name, n, sum of squared errors, sum of true distances); with ``others``, over pairs of different ids."""

    def __init__(self, kinds: list[Kind], names: list[str], others: bool, query_ids: np.ndarray, left: list[K.Operand]):
        self.args, self.names, self.others = (kinds, query_ids, left), names, others
        self.n, self.true, self.squares = 0, 0.0, np.zeros(len(names))

    def add(self, ids: np.ndarray, right: list[K.Operand]) -> Iterator[pa.RecordBatch]:
        for q, v, (true, *dists) in tiles(*self.args, ids, right):
            row, col = same(q, v) if self.others else ((), ())
            self.n += true.size - len(row)
            for k, dist in enumerate(dists):
                dist -= true
                dist[row, col] = 0
                self.squares[k] += np.vdot(dist, dist)
            true[row, col] = 0
            self.true += true.sum()
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            k = len(self.names)
            yield pa.RecordBatch.from_arrays([pa.array(self.names), pa.array([self.n] * k), pa.array(self.squares), pa.array([float(self.true)] * k)], ["mode", "n", "squares", "true"])


def _found(q: np.ndarray, v: np.ndarray, dist: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(q), TILE):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + TILE]) for x in (q, v, dist)], ["query_id", "vec_id", "dist"])


class Within:
    """The pairs at a distance of at most ``limit``; with ``ordered``, of those with the smaller id as query."""

    def __init__(self, kinds: list[Kind], limit: float, ordered: bool, query_ids: np.ndarray, left: list[K.Operand]):
        self.ids, self.left, self.limit, self.ordered, self.screen = query_ids, left[0], limit, ordered, K.Screen(left[0])

    def add(self, ids: np.ndarray, right: list[K.Operand]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), STRIP):
            few, some = right[0].rows(slice(at, at + STRIP)), ids[at : at + STRIP]
            screened, step = self.screen.right(few), max(1, TILE // len(some))
            for top in range(0, len(self.ids), step):
                rows = slice(top, top + step)
                i, j = self.screen.passing(rows, screened, np.full(len(self.ids[rows]), self.limit))
                i += top
                if self.ordered:
                    keep = self.ids[i] < some[j]
                    i, j = i[keep], j[keep]
                dist = K.of_pairs(self.left, few, i, j)
                keep = dist <= self.limit
                if keep.any():
                    yield from _found(self.ids[i[keep]], some[j[keep]], dist[keep])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class Nearest:
    """The k nearest of each query so far, ties to the smaller id; with ``others``, of the rows with another id."""

    def __init__(self, kinds: list[Kind], k: int, others: bool, query_ids: np.ndarray, left: list[K.Operand]):
        self.ids, self.left, self.k, self.others, self.screen = query_ids, left[0], k, others, K.Screen(left[0])
        self.dist, self.near = np.full((len(query_ids), k), np.inf), np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.seen = 0

    def add(self, ids: np.ndarray, right: list[K.Operand]) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(ids):
            strip = min(STRIP, max(64, 4 * self.k, self.seen))  # the first ones are all candidates
            few, some = right[0].rows(slice(at, at + strip)), ids[at : at + strip]
            screened, step = self.screen.right(few), max(1, TILE // len(some))
            for top in range(0, len(self.ids), step):
                rows = slice(top, top + step)
                i, j = self.screen.passing(rows, screened, self.dist[rows, -1])
                i += top
                if self.others:
                    keep = self.ids[i] != some[j]
                    i, j = i[keep], j[keep]
                dist = K.of_pairs(self.left, few, i, j)
                last, v = self.dist[i, -1], some[j]
                keep = (dist < last) | ((dist == last) & (v < self.near[i, -1]))
                if keep.any():
                    self._merge(i[keep], v[keep], dist[keep])
            at += strip
            self.seen += strip
        return iter(())

    def _merge(self, i: np.ndarray, v: np.ndarray, dist: np.ndarray) -> None:
        rows = np.unique(i)
        i, v, dist = np.concatenate([i, np.repeat(rows, self.k)]), np.concatenate([v, self.near[rows].reshape(-1)]), np.concatenate([dist, self.dist[rows].reshape(-1)])
        order = np.lexsort((v, dist, i))
        i, v, dist = i[order], v[order], dist[order]
        first = np.searchsorted(i, rows)
        take = first[:, None] + np.arange(self.k)
        self.near[rows], self.dist[rows] = v[take], dist[take]

    def end(self) -> Iterator[pa.RecordBatch]:
        row, col = np.nonzero(np.isfinite(self.dist))
        yield from _found(self.ids[row], self.near[row, col], self.dist[row, col])


def staged_batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """A staged table, file by file."""
    where, at = pafs.FileSystem.from_uri(path)
    for info in sorted(where.get_file_info(pafs.FileSelector(at)), key=lambda f: f.path):
        if info.is_file and info.path.endswith(".parquet") and info.size:
            with where.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(batch_size=rows)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scan_batches(batches: Iterator[pa.RecordBatch], kinds: list[Kind], work, args: tuple, queries: bytes, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of codes meet all queries."""
    few = pa.ipc.open_stream(queries).read_all()
    doing = work(kinds, *args, few.column("id").to_numpy(), _operands(kinds, few, True))
    for batch in _pieces(batches, shard_rows):
        yield from doing.add(batch.column("id").to_numpy(), _operands(kinds, batch, False))
    yield from doing.end()


def stream_batches(batches: Iterator[pa.RecordBatch], kinds: list[Kind], work, args: tuple, path: str, query_rows: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of queries, gathered to ``query_rows``, meet all codes of the staged table."""

    def met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = pa.Table.from_batches(held)
        doing = work(kinds, *args, few.column("id").to_numpy(), _operands(kinds, few, True))
        for batch in staged_batches(path, shard_rows):
            yield from doing.add(batch.column("id").to_numpy(), _operands(kinds, batch, False))
        yield from doing.end()

    held, n = [], 0
    for batch in _pieces(batches, query_rows):
        if n + batch.num_rows > query_rows:
            yield from met(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield from met(held)


def sides(queries: DataFrame, base: DataFrame, kinds: list[Kind]) -> tuple[DataFrame, DataFrame]:
    """(id and the columns that the kinds read) of both sides, without nulls."""
    for space, mode, *_ in kinds:
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if mode != "exact" and space is None:
            raise ValueError("this mode needs a space")

    def side(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), *cols).where(" and ".join(f"`{c}` is not null" for c in cols))

    return side(queries, "query_id", sorted({k[2] for k in kinds})), side(base, "vec_id", sorted({k[3] for k in kinds}))


def sent(few: pa.Table) -> bytes:
    """A small table as a stream that travels with a function."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, few.schema) as writer:
        writer.write_table(few.combine_chunks())
    return sink.getvalue().to_pybytes()


def over_pairs(queries: DataFrame, base: DataFrame, kinds: list[Kind], work, args: tuple, schema: str, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """What ``work`` (a class as ``All``) makes of the pairs in each task; every pair meets it in one task."""
    left, right = sides(queries, base, kinds)
    few = left.limit(BROADCAST_QUERIES + 1).toArrow()
    if not few.num_rows:
        return base.sparkSession.createDataFrame([], schema)
    if few.num_rows <= BROADCAST_QUERIES:
        return right.mapInArrow(remote(scan_batches, kinds, work, args, sent(few.sort_by("id")), shard_rows), schema)
    codes = staged(right, "codes")
    tasks = max(base.sparkSession.sparkContext.defaultParallelism, -(-left.count() // query_rows))
    return left.repartition(tasks, "id").mapInArrow(remote(stream_batches, kinds, work, args, codes._staged_at, query_rows, shard_rows), schema)


def _kind(space: Space | None, mode: str, left_col: str | None, right_col: str | None) -> Kind:
    return space, mode, left_col or ("embedding" if mode in ("asym", "exact") else "code"), right_col or ("embedding" if mode == "exact" else "code")


def pairwise(queries: DataFrame, base: DataFrame, space: Space | None = None, mode: str = "asym", left_col: str | None = None, right_col: str | None = None) -> DataFrame:
    """(query_id, vec_id, dist) of every query and every row of ``base``; squared distances, at least 0.

    "asym": raw queries against codes; "sym", "light", "full": codes against codes; "exact": vectors against vectors.
    """
    return over_pairs(queries, base, [_kind(space, mode, left_col, right_col)], All, (["dist"],), PAIRS)


def side_by_side(queries: DataFrame, base: DataFrame, kinds: dict[str, Kind]) -> DataFrame:
    """(query_id, vec_id, a distance of each kind under its name) of every query and every row, without a join."""
    names = list(kinds)
    return over_pairs(queries, base, list(kinds.values()), All, (names,), "query_id long, vec_id long, " + ", ".join(f"`{n}` double" for n in names))


def rmse_by_mode(queries: DataFrame, base: DataFrame, truth: Kind, kinds: dict[str, Kind], others: bool = False) -> DataFrame:
    """(mode, n, rmse, relative): root mean square error of each kind, also over the mean true distance. Sums leave a task, no pairs."""
    sums = over_pairs(queries, base, [truth, *kinds.values()], Errors, (list(kinds), others), "mode string, n long, squares double, true double")
    found = sums.groupBy("mode").agg(F.sum("n").alias("n"), F.sum("squares").alias("s"), F.sum("true").alias("t"))
    return found.select("mode", "n", F.sqrt(F.col("s") / F.col("n")).alias("rmse"), (F.sqrt(F.col("s") / F.col("n")) / (F.col("t") / F.col("n"))).alias("relative"))


def within(queries: DataFrame, base: DataFrame, space: Space | None, limit: float, mode: str = "full", ordered: bool = False) -> DataFrame:
    """``pairwise`` at a distance of at most ``limit``; with ``ordered`` only pairs whose query has the smaller id. No other pair leaves its tile."""
    return over_pairs(queries, base, [_kind(space, mode, None, None)], Within, (limit, ordered), PAIRS)


def one_to_n(query: list[float], base: DataFrame, space: Space, mode: str = "asym") -> DataFrame:
    """Distances of one raw query to all rows."""
    one = base.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
    return pairwise(one if mode in ("asym", "exact") else _encoded(one, space), base, space, mode).drop("query_id")


def _encoded(df: DataFrame, space: Space) -> DataFrame:
    from .codes import encode

    return encode(df, space)


def topk(dists: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return dists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "dist")


def nearest(dists: DataFrame, k: int) -> DataFrame:
    """Of one query: the k nearest over all, without a window."""
    return dists.orderBy("dist", "vec_id").limit(k)


def search(queries: DataFrame, base: DataFrame, space: Space | None = None, k: int = 10, mode: str = "asym", left_col: str | None = None, right_col: str | None = None, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS, others: bool = False) -> DataFrame:
    """Top-k of each query without the whole distance matrix ever leaving a tile; with ``others``, among the rows with another id."""
    return topk(over_pairs(queries, base, [_kind(space, mode, left_col, right_col)], Nearest, (k, others), PAIRS, query_rows, shard_rows), k)


def ground_truth(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours: (query_id, rank, vec_id, dist)."""
    return search(queries, base, None, k, "exact")


def knn_graph(vectors: DataFrame, space: Space, k: int, mode: str = "full") -> DataFrame:
    """Each row's k nearest other rows, on codes."""
    codes = _encoded(vectors.select("vec_id", "embedding"), space)
    return search(codes.withColumnRenamed("vec_id", "query_id"), codes, space, k, mode, "code", "code", others=True)
