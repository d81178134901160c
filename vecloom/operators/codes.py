"""Encoding and decoding of vector columns, and the code's storage forms.

Row-wise and stateless, so all of it also runs on streams. ``engine="arrow"`` works batch by batch in numpy;
``engine="sql"`` is built of column expressions alone. A null vector gives a null code; NaN and infinite components
are an error, or a null code with ``invalid="null"``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import kernels as K
from ..functions.space import Space
from ..runtime import remote

CODE = "struct<packed:binary,norm:float,gamma:float,sigma:float>"
_CODE_ARROW = pa.struct([("packed", pa.binary()), ("norm", pa.float32()), ("gamma", pa.float32()), ("sigma", pa.float32())])


def check_column(df: DataFrame, col: str, cast: bool = False) -> DataFrame:
    """The column must be array<float>; ``cast`` takes other numeric arrays too."""
    kind = df.schema[col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise ValueError(f"{col} must be array<float>, not {kind.simpleString()}")
    if not isinstance(kind.elementType, T.FloatType):
        if not cast:
            raise ValueError(f"{col} must be array<float>, not {kind.simpleString()}; cast=True converts it")
        return df.withColumn(col, F.col(col).cast("array<float>"))
    return df


def matrix(array: pa.Array, dim: int, invalid: str = "error") -> tuple[np.ndarray, np.ndarray]:
    """(rows, positions) of the vectors that aren't null; errors for other lengths and for values that aren't finite."""
    at = np.flatnonzero(array.is_valid().to_numpy(zero_copy_only=False))
    rows = array.take(pa.array(at)) if len(at) < len(array) else array
    if len(rows) and (np.diff(rows.offsets.to_numpy()) != dim).any():
        raise ValueError(f"expected {dim} dimensions in every vector")
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(-1, dim)
    finite = np.isfinite(out).all(1)
    if not finite.all():
        if invalid != "null":
            raise ValueError("vector with a null, NaN or infinite component")
        out, at = out[finite], at[finite]
    return out, at


def _scattered(n: int, at: np.ndarray, values: pa.Array) -> pa.Array:
    """Values at their positions, null elsewhere."""
    if len(at) == n:
        return values
    index = np.full(n, -1, np.int64)
    index[at] = np.arange(len(at))
    return values.take(pa.array(index, mask=index < 0))


def code_array(space: Space, rows: np.ndarray) -> pa.StructArray:
    codes = K.encode(space, rows)
    packed = np.ascontiguousarray(K.pack(space, codes))
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * space.packed_bytes
    binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return pa.StructArray.from_arrays([binary, pa.array(codes.norm), pa.array(codes.gamma), pa.array(codes.sigma)], fields=list(_CODE_ARROW))


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list array."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(values.reshape(-1)))


def unpacked(space: Space, codes: pa.StructArray) -> K.Codes:
    """Codes of a struct array without nulls."""
    packed = codes.field("packed")
    sizes = np.diff(packed.offsets.to_numpy() if hasattr(packed, "offsets") else np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1])
    if (sizes != space.packed_bytes).any():
        raise ValueError(f"expected codes of {space.packed_bytes} packed bytes")
    units = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, space.packed_bytes)
    return K.unpack(space, units, *(codes.field(f).to_numpy(zero_copy_only=False) for f in ("norm", "gamma", "sigma")))


def encode_batches(batches: Iterator[pa.RecordBatch], space: Space, invalid: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at = matrix(batch.column(batch.num_columns - 1), space.dim, invalid)
        values = _scattered(batch.num_rows, at, code_array(space, rows))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*batch.schema.names[:-1], "code"])


def rotated_batches(batches: Iterator[pa.RecordBatch], space: Space, invalid: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at = matrix(batch.column(batch.num_columns - 1), space.dim, invalid)
        values = _scattered(batch.num_rows, at, lists(K.rotated_coords(space, rows)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*batch.schema.names[:-1], "coords"])


def decode_batches(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = batch.column(batch.num_columns - 1)
        at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        d = K.decode(space, unpacked(space, code.take(pa.array(at))))
        values = [lists(d.c), lists(d.h), lists(d.s), pa.array(d.norm), pa.array(d.gamma)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(_scattered(batch.num_rows, at, v) for v in values)], [*batch.schema.names[:-1], "c", "h", "s", "norm", "gamma"])


def prepare_batches(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at = matrix(batch.column(batch.num_columns - 1), space.dim)
        rotated, twice, norm = K.prepare(space, rows)
        values = [lists(rotated), lists(twice), pa.array(norm)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(_scattered(batch.num_rows, at, v) for v in values)], [*batch.schema.names[:-1], "q_rot", "s_q", "q_norm"])


def _mapped(df: DataFrame, last: Column, func, added: str, *args) -> DataFrame:
    """Map Arrow batches of ``df`` with one more column at the end, which ``func`` replaces by ``added``."""
    held = df.withColumn("_in", last)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [added])
    return held.mapInArrow(remote(func, *args), kinds)


def encode(df: DataFrame, space: Space, col: str = "embedding", out: str = "code", engine: str = "arrow", cast: bool = False, invalid: str = "error", keep: bool = False) -> DataFrame:
    """Replace the vector column by its code (or add the code, with ``keep``)."""
    df = check_column(df, col, cast)
    rest = df if keep else df.drop(col)
    if engine == "sql":
        usable = ~F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        wrong = F.lit(None).cast(df.schema[col].dataType) if invalid == "null" else F.raise_error("vector with a null, NaN or infinite component").cast(df.schema[col].dataType)
        coded = df.withColumn("_c", C.code(F.when(F.col(col).isNull() | usable, F.col(col)).otherwise(wrong), space))
        code = F.when(F.col("_c").isNotNull(), F.struct(C.packed(F.col("_c.levels"), F.col("_c.signs"), space).alias("packed"), "_c.norm", "_c.gamma", "_c.sigma"))
        return coded.select(*rest.columns, code.alias(out))
    held = df.select(*rest.columns, F.col(col).alias("_in"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields] + [f"code {CODE}"])
    return held.mapInArrow(remote(encode_batches, space, invalid), kinds).withColumnRenamed("code", out)


def rotated_coords(df: DataFrame, space: Space, col: str = "embedding", invalid: str = "error") -> DataFrame:
    """Add ``coords``: rotated coordinates over their root mean square."""
    return _mapped(check_column(df, col), F.col(col), rotated_batches, "coords array<double>", space, invalid)


def decode(df: DataFrame, space: Space, col: str = "code", engine: str = "arrow") -> DataFrame:
    """Add c, h, s, norm and gamma: one decoding feeds every distance (a prepared symmetric query is a row of it)."""
    if engine == "sql":
        code = F.col(col)
        return df.withColumn("_d", F.when(code.isNotNull(), C.decoded(code["packed"], code["norm"], code["gamma"], code["sigma"], space))).select(*df.columns, "_d.*")
    return _mapped(df, F.col(col), decode_batches, "c array<double>, h array<double>, s array<double>, norm double, gamma double", space)


def prepare_queries(df: DataFrame, space: Space, col: str = "embedding") -> DataFrame:
    """Add q_rot, s_q (rotated once more) and q_norm."""
    return _mapped(check_column(df, col), F.col(col), prepare_batches, "q_rot array<double>, s_q array<double>, q_norm double", space)


def to_wire(code: Column) -> Column:
    """The code as one BINARY: units, then norm, gamma and sigma as little-endian floats."""
    def word(f: Column) -> Column:
        digits = F.lpad(F.hex(_float_bits(f)), 8, "0")
        return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))

    return F.when(code.isNotNull(), F.concat(code["packed"], word(code["norm"]), word(code["gamma"]), word(code["sigma"])))


def _float_bits(x: Column) -> Column:
    """IEEE-754 single bits of a non-negative float: exponent by scaling, mantissa by rounding what is exact anyway."""
    v = x.cast("double")
    power = F.greatest(F.floor(F.log2(v)), F.lit(-126))
    power = F.when(F.pow(F.lit(2.0), power + 1) <= v, power + 1).when((F.pow(F.lit(2.0), power) > v) & (power > -126), power - 1).otherwise(power)
    whole = F.round(v * F.pow(F.lit(2.0), 23 - power)).cast("long")
    bits = F.when(whole < (1 << 23), whole).otherwise((power.cast("long") + 127) * (1 << 23) + whole - (1 << 23))
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(bits)


def from_wire_batches(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wire = batch.column(batch.num_columns - 1)
        at = np.flatnonzero(wire.is_valid().to_numpy(zero_copy_only=False))
        values = wire.take(pa.array(at)).to_pylist()
        if any(len(v) != space.code_size_bytes for v in values):
            raise ValueError(f"expected codes of {space.code_size_bytes} bytes")
        tail = np.frombuffer(b"".join(v[space.packed_bytes :] for v in values), "<f4").reshape(-1, 3)
        arrays = [pa.array([v[: space.packed_bytes] for v in values], pa.binary()), *(pa.array(np.ascontiguousarray(tail[:, i])) for i in range(3))]
        struct = pa.StructArray.from_arrays(arrays, fields=list(_CODE_ARROW))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _scattered(batch.num_rows, at, struct)], [*batch.schema.names[:-1], "code"])


def from_wire(df: DataFrame, space: Space, col: str = "wire") -> DataFrame:
    """Add ``code`` from its wire form."""
    return _mapped(df, F.col(col), from_wire_batches, f"code {CODE}", space)


def normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Unit length; a zero vector stays as it is. Squared distances of these rank as the cosine does."""
    x = F.transform(col, lambda v: v.cast("double"))
    unit = C.bind(x, lambda v: C.bind(F.when(C.norm(v) == 0, F.lit(1.0)).otherwise(C.norm(v)), lambda n: F.transform(v, lambda t: (t / n).cast("float"))))
    return df.withColumn(col, F.when(F.col(col).isNotNull(), unit))


def truncate(df: DataFrame, dims: int, col: str = "embedding") -> DataFrame:
    """The first ``dims`` coordinates."""
    return df.withColumn(col, F.slice(col, 1, dims))


def split_queries(df: DataFrame, n: int, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(queries, base): rows with ids below ``n``, with the id as query_id, and the rest."""
    return df.where(F.col(id_col) < n).withColumnRenamed(id_col, "query_id"), df.where(F.col(id_col) >= n)


def register_udfs(spark, space: Space, prefix: str = "vl") -> None:
    """SQL functions: {prefix}_encode(vector) and {prefix}_dist_{asym, sym, light, full}(a, b)."""
    import pandas as pd

    def encode_(v: pd.Series) -> pd.DataFrame:
        at = [i for i, x in enumerate(v) if x is not None]
        rows = np.array([np.asarray(v.iloc[i], np.float64) for i in at]).reshape(-1, space.dim)
        codes = K.encode(space, rows)
        packed = K.pack(space, codes)
        out = pd.DataFrame({"packed": [None] * len(v), "norm": np.nan, "gamma": np.nan, "sigma": np.nan})
        for j, i in enumerate(at):
            out.loc[i] = [packed[j].tobytes(), codes.norm[j], codes.gamma[j], codes.sigma[j]]
        return out

    def codes_of(frame: pd.DataFrame) -> K.Decoded:
        units = np.frombuffer(b"".join(map(bytes, frame["packed"])), np.uint8).reshape(-1, space.packed_bytes)
        return K.decode(space, K.unpack(space, units, *(frame[f].to_numpy(np.float32) for f in ("norm", "gamma", "sigma"))))

    def paired(a: K.Decoded, b: K.Decoded, mode: str) -> np.ndarray:
        k, row = space.scale, lambda x, y: (x * y).sum(1)
        first = row(a.c, b.c)
        if mode == "sym":
            ip = first
        elif mode == "light":
            ip = first + np.clip(k * k * a.gamma * b.gamma * row(a.s, b.s), -abs(first), abs(first))
        else:
            ip = first + np.clip(row(a.h + (k * a.gamma)[:, None] * a.s, b.h + (k * b.gamma)[:, None] * b.s) - first, -abs(first), abs(first))
        return np.maximum(0.0, a.norm**2 + b.norm**2 - 2 * ip * a.norm * b.norm)

    def asym(q: pd.Series, b: pd.DataFrame) -> pd.Series:
        _, twice, norm = K.prepare(space, np.array(q.tolist(), np.float64).reshape(-1, space.dim))
        d = codes_of(b)
        ip = (twice * (d.h + (space.scale * d.gamma)[:, None] * d.s)).sum(1)
        return pd.Series(np.maximum(0.0, norm**2 + d.norm**2 - 2 * ip * norm * d.norm))

    def symmetric(mode: str):
        def dist(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
            return pd.Series(paired(codes_of(a), codes_of(b), mode))

        return dist

    from pyspark.sql.pandas.functions import PandasUDFType

    spark.udf.register(f"{prefix}_encode", F.pandas_udf(encode_, CODE, PandasUDFType.SCALAR))
    spark.udf.register(f"{prefix}_dist_asym", F.pandas_udf(asym, "double", PandasUDFType.SCALAR))
    for mode in ("sym", "light", "full"):
        spark.udf.register(f"{prefix}_dist_{mode}", F.pandas_udf(symmetric(mode), "double", PandasUDFType.SCALAR))
