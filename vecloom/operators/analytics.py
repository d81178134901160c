"""Metrics and diagnostics: recall, errors, rank correlation, distributions, codebooks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.space import Space
from ..runtime import remote, staged
from .distances import staged_batches

#: Values of a sorted block, and of the blocks that the driver holds.
BLOCK_VALUES, HELD_VALUES = 1 << 10, 1 << 25


def recall(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """One row (k, hits, recall) per k: shared ids among both sides' first k, over queries x k."""
    queries = truth.select("query_id").distinct()
    both = found.select("query_id", "vec_id", F.col("rank").alias("r")).join(truth.select("query_id", "vec_id", F.col("rank").alias("t")), ["query_id", "vec_id"])
    hits = both.agg(*[F.count(F.when((F.col("r") <= k) & (F.col("t") <= k), 1)).alias(f"hits_{k}") for k in ks])
    n = queries.agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"), (F.col(f"hits_{k}") / (F.col("n") * k)).alias("recall")) for k in ks])
    return hits.join(n).select(F.inline(rows))  # one row each


def recall_by(found: DataFrame, truth: DataFrame, k: int, groups: DataFrame, key: str) -> DataFrame:
    """Recall@k per value of ``key``, from ``groups`` (query_id, key)."""
    hits = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.join(groups, "query_id").groupBy(key).agg(F.count("hit").alias("hits"), F.countDistinct("query_id").alias("queries")).withColumn("recall", F.col("hits") / (F.col("queries") * k))


def rmse_by_mode(exact: DataFrame, approximate: dict[str, DataFrame]) -> DataFrame:
    """(mode, n, rmse, relative): root mean square error of each mode, also over the mean true distance."""
    truth = exact.select("query_id", "vec_id", F.col("dist").alias("true"))
    every = None
    for mode, df in approximate.items():
        part = df.select("query_id", "vec_id", "dist", F.lit(mode).alias("mode"))
        every = part if every is None else every.union(part)
    error = F.pow(F.col("dist") - F.col("true"), 2)
    return every.join(truth, ["query_id", "vec_id"]).groupBy("mode").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(error)).alias("rmse"), (F.sqrt(F.avg(error)) / F.avg("true")).alias("relative")
    )


def sampled_pairs(df: DataFrame, n: int, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """n pairs (i, j) of different ids below the row count, drawn by hash; pairs of a row with itself are left out."""
    rows = df.agg(F.count("*").alias("rows"))
    draw = lambda s: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.col("rows"))
    return df.sparkSession.range(n).join(rows).select(draw(1).alias("i"), draw(2).alias("j")).where("i <> j")


def sample(df: DataFrame, n: int, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """n rows without replacement, the same for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def average_ranks(df: DataFrame, col: str, out: str, parts: int = 64) -> DataFrame:
    """Ranks with ties at their mean: running counts of the distinct values within value ranges, plus the counts of the ranges below."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n"))
    edges = sorted(set(df.approxQuantile(col, [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col(col)))
    cut = counts.withColumn("_part", part)
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = cut.groupBy("_part").agg(F.sum("_n").alias("_t")).select("_part", F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_below"))  # at most ``parts`` rows
    before = Window.partitionBy("_part").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(F.broadcast(below), "_part").select(col, (F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranked, col)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): rank correlation of two columns."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def coords_long(df: DataFrame, col: str = "coords", id_col: str = "vec_id") -> DataFrame:
    """(id, pos, value) of an array column."""
    return df.select(id_col, F.posexplode(col).alias("pos", "value"))


def moments(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """n, mean, std, skewness and excess kurtosis of the population."""
    x = F.col(value)
    return df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def percentiles(df: DataFrame, qs: tuple[float, ...] = (0.01, 0.05, 0.95, 0.99), value: str = "value", accuracy: int | None = None) -> DataFrame:
    """(q, value) by linear interpolation; with ``accuracy``, by a mergeable sketch for data of any size."""
    points = F.array(*map(F.lit, qs))
    found = F.percentile_approx(value, points, accuracy) if accuracy else F.percentile(value, points)
    return df.agg(found.alias("p")).select(F.inline(F.arrays_zip(points.alias("q"), F.col("p").alias("value"))))


def histogram(df: DataFrame, low: float, high: float, bins: int, value: str = "value") -> DataFrame:
    """(bin, n, density) over [low, high); bin 0 and bins+1 hold what lies outside."""
    width = (high - low) / bins
    counted = df.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def normal_quantiles(df: DataFrame, points: int = 99, value: str = "value") -> DataFrame:
    """Q-Q data: (p, sample, theoretical) at evenly spaced probabilities."""
    ps = [(i + 1) / (points + 1) for i in range(points)]
    theory = df.sparkSession.createDataFrame([(p, normal_inverse(p)) for p in ps], "q double, theoretical double")
    return percentiles(df, tuple(ps), value).join(F.broadcast(theory), "q").select(F.col("q").alias("p"), F.col("value").alias("sample"), "theoretical")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 1e-7 (a rational approximation)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_inverse(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def ks_normal(df: DataFrame, value: str = "value") -> DataFrame:
    """One row (n, statistic, p_value): Kolmogorov-Smirnov against N(0, 1)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    n = df.agg(F.count(value).alias("n"))
    test = KolmogorovSmirnovTest.test(df.select(F.col(value).cast("double").alias("value")), "value", "norm", 0.0, 1.0)
    return n.join(test.select(F.col("statistic"), F.col("pValue").alias("p_value")))


def k_squared(df: DataFrame, value: str = "value") -> DataFrame:
    """One row (n, k2, p_value): D'Agostino's omnibus test, from the moments."""
    m = moments(df, value)
    n, g1, g2 = F.col("n").cast("double"), F.col("skew"), F.col("kurt")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    u = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(u + F.sqrt(u * u + 1)) / F.sqrt(F.log(w2) / 2)
    mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(ratio) * F.pow(F.abs(ratio), 1 / 3)) / F.sqrt(2 / (9 * a))
    return m.select("n", (z1 * z1 + z2 * z2).alias("k2")).withColumn("p_value", F.exp(-F.col("k2") / 2))


def _level(value: Column, bounds: list[float], side: str) -> Column:
    """Number of boundaries below the value (side left), or at or below it (side right)."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: value > b if side == "left" else value >= b))


def quant_mse(df: DataFrame, centroids: list[float], boundaries: list[float] | None = None, value: str = "value", side: str = "left") -> DataFrame:
    """One row (n, mse) of quantising the values to a codebook."""
    bounds = boundaries if boundaries is not None else [(a + b) / 2 for a, b in zip(centroids, centroids[1:])]
    level = _level(F.col(value), list(bounds), side)
    near = F.get(F.array(*[F.lit(float(c)) for c in centroids]), level)
    return df.agg(F.count(value).alias("n"), F.avg(F.pow(F.col(value) - near, 2)).alias("mse"))


def empirical_codebook(df: DataFrame, bits: int, value: str = "value", init: str = "centred", rounds: int = 500, tol: float = 1e-12, side: str = "right") -> list[float]:
    """Lloyd's iteration on the values themselves: each round is one aggregation of 2**bits rows.

    Starts at quantiles: "centred" at (j + 0.5) / levels, "inner" at the inner points of an even grid. Levels without values keep their centroid.
    """
    levels = 1 << bits
    qs = [(j + 0.5) / levels for j in range(levels)] if init == "centred" else [(j + 1) / (levels + 1) for j in range(levels)]
    points = list(df.agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("p")).first()["p"])
    for _ in range(rounds):
        bounds = [(a + b) / 2 for a, b in zip(points, points[1:])]
        means = {r["level"]: r["mean"] for r in df.groupBy(_level(F.col(value), bounds, side).alias("level")).agg(F.avg(value).alias("mean")).collect()}
        fresh = [means.get(i, p) for i, p in enumerate(points)]
        moved = max(abs(a - b) for a, b in zip(fresh, points))
        points = sorted(fresh)
        if moved < tol:
            break
    return points


def sorted_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted values of a range to blocks of ``rows``: (range, number, n, total, least, most, block), the block as doubles."""
    from pyspark import TaskContext

    part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

    def made(values: np.ndarray) -> pa.RecordBatch:
        row = [part, number, len(values), float(values.sum()), float(values[0]), float(values[-1]), values.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()))], ["part", "number", "n", "total", "least", "most", "block"])

    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= rows:
            values = np.concatenate(held)
            for at in range(0, n - n % rows, rows):
                yield made(values[at : at + rows])
                number += 1
            held, n = [values[n - n % rows :].copy()], n % rows
    if n:
        yield made(np.concatenate(held))


class SortedValues:
    """A column in order: the driver has a row for each block of BLOCK_VALUES values, and of the values themselves only blocks that it looks into,
    at most HELD_VALUES at a time. So a place or a sum below any bound is exact and needs no job."""

    def __init__(self, df: DataFrame, value: str):
        spark = df.sparkSession
        values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"))
        ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = values.repartitionByRange(ranges, "value").sortWithinPartitions("value")
        self.blocks = staged(ordered.mapInArrow(remote(sorted_blocks, BLOCK_VALUES), "part int, number int, n long, total double, least double, most double, block binary"), "blocks")
        rows = self.blocks.drop("block").toArrow().sort_by([("least", "ascending"), ("part", "ascending"), ("number", "ascending")])
        self.at = list(zip(rows["part"].to_pylist(), rows["number"].to_pylist()))
        n, total, self.most = (rows[c].to_numpy() for c in ("n", "total", "most"))
        self.before, self.total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(total)])
        self.n = int(self.before[-1])
        self.held: dict[int, np.ndarray] = {}

    def _fetch(self, wanted: np.ndarray) -> None:
        """Have the blocks, and as many around them as there is room for: bounds move little from round to round."""
        if all(k in self.held for k in wanted.tolist()):
            return
        room = HELD_VALUES // BLOCK_VALUES
        reach = max(0, (room // 2 // max(1, len(wanted)) - 1) // 2)
        near = np.unique(np.clip(wanted[:, None] + np.arange(-reach, reach + 1), 0, len(self.at) - 1))
        if len(self.at) <= room:
            near = np.arange(len(self.at))
        if len(self.held) + len(near) > room:
            kept = set(near.tolist())
            self.held = {k: v for k, v in self.held.items() if k in kept}
        missing = [k for k in near.tolist() if k not in self.held]
        number = {self.at[k]: k for k in missing}
        for batch in staged_batches(self.blocks._staged_at, 256) if missing else ():
            found = [number.get(x) for x in zip(*(batch.column(c).to_pylist() for c in ("part", "number")))]
            for row, k in enumerate(found):
                if k is not None:
                    self.held[k] = np.frombuffer(batch.column("block")[row].as_py(), np.float64)

    def below(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, sum) of the values up to each bound."""
        block = np.searchsorted(self.most, bounds, "right")  # the first that reaches beyond the bound
        inside = block < len(self.at)
        n, total = self.before[block].copy(), self.total[block].copy()
        self._fetch(np.unique(block[inside]))
        for k in np.flatnonzero(inside).tolist():
            values = self.held[int(block[k])]
            at = int(np.searchsorted(values, bounds[k], "right"))
            n[k] += at
            total[k] += values[:at].sum()
        return n, total

    def quantiles(self, qs: list[float]) -> np.ndarray:
        """By linear interpolation."""
        place = np.array(qs) * (self.n - 1)
        low = np.floor(place).astype(np.int64)
        both = np.stack([low, np.minimum(low + 1, self.n - 1)])
        block = np.searchsorted(self.before, both, "right") - 1
        self._fetch(np.unique(block))
        values = np.array([[self.held[k][i - self.before[k]] for k, i in zip(row.tolist(), at.tolist())] for row, at in zip(block, both)])
        return values[0] + (values[1] - values[0]) * (place - low)


def level_errors(batches: Iterator[pa.RecordBatch], books: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(book, n, error): squared errors of a task's values under (centroids, boundaries); a value on a boundary is in the level below."""
    n, errors = 0, dict.fromkeys(books, 0.0)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            values = np.frombuffer(b"".join(batch.column(0).slice(at, 128).to_pylist()), np.float64)
            n += len(values)
            for book, (points, bounds) in books.items():
                gap = values - points[np.searchsorted(bounds, values, "left")]
                errors[book] += float(gap @ gap)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(errors), pa.int32()), pa.array([n] * len(errors), pa.int64()), pa.array(list(errors.values()), pa.float64())], ["book", "n", "error"])


def codebook_gain(df: DataFrame, bits_range: range, value: str = "value", rounds: int = 200, tol: float = 1e-8) -> DataFrame:
    """(bits, gaussian_mse, empirical_mse, gain_percent) for each number of level bits.

    Lloyd's iteration from the inner points of an even grid of quantiles, until no centroid moves by ``tol``, at most ``rounds``
    rounds; codebooks are rounded to single precision. The values are sorted once; a round needs the places of the boundaries
    among them, which the driver finds in the few blocks that hold one.
    """
    from ..functions.space import lloyd_max

    values = SortedValues(df, value)
    if not values.n:
        return df.sparkSession.createDataFrame([], "bits int, gaussian_mse double, empirical_mse double, gain_percent double")
    books = {bits: values.quantiles([(j + 1) / ((1 << bits) + 1) for j in range(1 << bits)]) for bits in bits_range}
    middles = lambda points: (points[:-1] + points[1:]) / 2
    moving = set(books)
    for _ in range(rounds):
        if not moving:
            break
        order = sorted(moving)
        found = values.below(np.concatenate([middles(books[b]) for b in order]))
        cuts = np.cumsum([0] + [len(books[b]) - 1 for b in order])
        for bits, at, to in zip(order, cuts, cuts[1:]):
            n, total = (np.diff(np.concatenate([[0], x[at:to], [whole[-1]]])) for x, whole in zip(found, (values.before, values.total)))
            fresh = np.where(n > 0, total / np.maximum(n, 1), books[bits])
            if np.abs(fresh - books[bits]).max() < tol:
                moving.discard(bits)
            else:
                books[bits] = fresh
    single = lambda x: np.asarray(x, np.float32).astype(np.float64)
    both = {}
    for bits, points in books.items():
        bounds, centres = lloyd_max(bits)
        both[2 * bits] = single(centres), single(bounds)
        both[2 * bits + 1] = single(points), single(middles(points))
    errors = values.blocks.select("block").mapInArrow(remote(level_errors, both), "book int, n long, error double").groupBy("book").agg(F.sum("error") / F.sum("n"))
    mse = dict(map(tuple, errors.collect()))
    out = [(b, float(mse[2 * b]), float(mse[2 * b + 1]), float(100 * (mse[2 * b] - mse[2 * b + 1]) / mse[2 * b])) for b in books]
    return df.sparkSession.createDataFrame(out, "bits int, gaussian_mse double, empirical_mse double, gain_percent double")


def unpivot(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics to (ids, metric, value) rows without nulls."""
    return df.unpivot(ids, metrics, "metric", "value").where("value is not null")


def at_least_threads(df: DataFrame) -> DataFrame:
    """Result rows of each dataset's smallest thread count."""
    least = Window.partitionBy("dataset")
    return df.withColumn("_least", F.min("num_threads").over(least)).where("num_threads = _least").drop("_least")


def with_rates(df: DataFrame) -> DataFrame:
    """Derived columns of benchmark rows: rates per second from milliseconds, and the compression ratio."""
    packed = F.when(F.col("bits") <= 4, F.floor((F.col("padded_dim") + 1) / 2)).otherwise(F.col("padded_dim"))
    per_second = lambda count, ms: F.when(F.col(ms) > 0, count * 1000.0 / F.col(ms))
    return df.select(
        "*", per_second(F.col("n_base"), "encode_ms").alias("encode_vps"), per_second(F.col("n_base"), "query_1ton_ms").alias("query_1ton_vps"),
        per_second(F.col("n_base") * F.col("n_query"), "query_mton_ms").alias("query_mton_vps"), (F.col("dim") * 4.0 / (packed + 12)).alias("compression_ratio"),
    )


def sizes(spark, dims: list[int], bits: list[int]) -> DataFrame:
    """(dim, padded_dim, bits, code_size, compression_ratio) of a sweep."""
    rows = [(d, s.padded_dim, b, s.code_size_bytes, s.compression_ratio) for d in dims for b in bits for s in [Space(d, b)]]
    return spark.createDataFrame(rows, "dim int, padded_dim int, bits int, code_size int, compression_ratio double")


def norms(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn("norm", C.norm(C.doubles(F.col(col))))


def compare_modes(dists: dict[str, DataFrame]) -> DataFrame:
    """(query_id, vec_id, one column per mode): the estimates side by side."""
    out = None
    for mode, df in dists.items():
        part = df.select("query_id", "vec_id", F.col("dist").alias(mode))
        out = part if out is None else out.join(part, ["query_id", "vec_id"])
    return out


def signal_to_noise(mse: float, variance: float = 1.0) -> float:
    return float(10 * np.log10(variance / mse))
