"""Readers and writers: Parquet vectors, fvecs and ivecs files, synthetic sets, code tables with a manifest, CSV results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.space import Space
from ..runtime import remote


@dataclass(frozen=True)
class Dataset:
    """An entry of the registry: where vectors of a known size lie, and how many are taken by default."""

    name: str
    path: str
    dim: int
    limit: int | None = None
    truncate_to: int | None = None
    metric: str = "l2"


_REGISTRY: dict[str, Dataset] = {}


def register_dataset(entry: Dataset) -> None:
    _REGISTRY[entry.name] = entry


def datasets() -> list[str]:
    return sorted(_REGISTRY)


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    """A registered set: limited, truncated and normalised as its entry says."""
    from ..operators.codes import normalize, truncate

    entry = _REGISTRY[name]
    df = read_fvecs(spark, entry.path, entry.dim) if entry.path.endswith(".fvecs") else read_vectors(spark, entry.path)
    if entry.limit is not None:
        df = df.where(F.col("vec_id") < entry.limit) if entry.path.endswith(".fvecs") else df.orderBy("vec_id").limit(entry.limit)
    if entry.truncate_to is not None:
        df = truncate(df, entry.truncate_to)
    return normalize(df) if entry.metric == "cosine" else df


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", col: str = "embedding", limit: int | None = None) -> DataFrame:
    """(vec_id, embedding array<float>, ...) from Parquet; numeric arrays of other types are cast."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (id_col, col)]
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<float>").alias("embedding"), *rest)
    return out if limit is None else out.orderBy("vec_id").limit(limit)


def vecs_batches(batches: Iterator[pa.RecordBatch], dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(offset in records, bytes) blocks to rows."""
    for batch in batches:
        for start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = np.frombuffer(raw, "<i4").reshape(-1, dim + 1)
            if (rows[:, 0] != dim).any():
                raise ValueError(f"a record doesn't have {dim} dimensions")
            values = np.ascontiguousarray(rows[:, 1:])
            values = values.view("<f4") if kind == "float" else values
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(rows))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))], ["vec_id", "embedding"])


def block_batches(batches: Iterator[pa.RecordBatch], path: str, width: int) -> Iterator[pa.RecordBatch]:
    """(first record, records) ranges of a file to their bytes."""
    import pyarrow.fs

    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        for batch in batches:
            for start, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f.seek(start * width)
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([f.read(n * width)], pa.binary())], ["start", "raw"])


def _read_vecs(spark: SparkSession, path: str, dim: int, kind: str, block_bytes: int = 8 << 20) -> DataFrame:
    """Blocks of whole records are read in parallel, whatever the size of the file."""
    import pyarrow.fs

    uri = path if "://" in path else "file://" + path
    fs, name = pyarrow.fs.FileSystem.from_uri(uri)
    width = 4 * (dim + 1)
    size = fs.get_file_info(name).size
    if size % width:
        raise ValueError(f"{path}: size is no multiple of {width} bytes")
    per = max(1, block_bytes // width)
    total = size // width
    blocks = spark.range(-(-total // per)).select((F.col("id") * per).alias("start"), F.least(F.lit(per).cast("long"), F.lit(total) - F.col("id") * per).alias("n"))
    raw = blocks.mapInArrow(remote(block_batches, uri, width), "start long, raw binary")
    return raw.mapInArrow(remote(vecs_batches, dim, kind), f"vec_id long, embedding array<{kind}>")


def read_fvecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(vec_id, embedding): records of an int32 dimension and that many float32."""
    return _read_vecs(spark, path, dim, "float")


def read_ivecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Ground truth (query_id, rank, vec_id) from records of int32 ids."""
    rows = _read_vecs(spark, path, dim, "int")
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode("embedding").alias("pos", "id")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("id").cast("long").alias("vec_id"))


def write_fvecs(rows: np.ndarray, path: str) -> None:
    """A small matrix as an fvecs file (int32 matrices: ivecs)."""
    rows = np.ascontiguousarray(rows)
    head = np.full((len(rows), 1), rows.shape[1], "<i4")
    body = rows.astype("<i4") if rows.dtype.kind in "iu" else rows.astype("<f4").view("<i4")
    np.hstack([head, body]).astype("<i4").tofile(path)


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """N(0, 1) vectors."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed * 1_000_003 + i).cast("float") for i in range(dim)]).alias("embedding"))


def uniform_bytes(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Whole numbers from 0 to 255 as floats."""
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.floor(F.rand(seed * 1_000_003 + i) * 256).cast("float") for i in range(dim)]).alias("embedding"))


def write_codes(df: DataFrame, space: Space, path: str, mode: str = "errorifexists") -> None:
    """Codes as Parquet, columns split, with a one-row manifest of the space beside them."""
    df.select(*[c for c in df.columns if c != "code"], F.col("code.packed").alias("packed"), F.col("code.norm").alias("norm"), F.col("code.gamma").alias("gamma"), F.col("code.sigma").alias("sigma")).write.mode(mode).parquet(f"{path}/codes")
    df.sparkSession.createDataFrame([(json.dumps(space.manifest()),)], "space string").coalesce(1).write.mode(mode).json(f"{path}/manifest")


def read_codes(spark: SparkSession, path: str, expected: Space | None = None) -> tuple[DataFrame, Space]:
    """Codes and the space they were made with; an error if another one is expected."""
    space = Space(**json.loads(spark.read.schema("space string").json(f"{path}/manifest").first()["space"]))
    if expected is not None and space != expected:
        raise ValueError(f"codes were made with {space}, not {expected}")
    df = spark.read.parquet(f"{path}/codes")
    code = F.when(F.col("packed").isNotNull(), F.struct("packed", "norm", "gamma", "sigma")).alias("code")
    return df.select(*[c for c in df.columns if c not in ("packed", "norm", "gamma", "sigma")], code), space


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Result rows as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)
