"""Encoding and searching on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.space import Space
from ..operators.codes import encode
from ..operators.distances import pairwise


def encode_stream(vectors: DataFrame, space: Space, col: str = "embedding", invalid: str = "null") -> DataFrame:
    """Codes of a streaming DataFrame: row-wise, so nothing is kept between batches."""
    return encode(vectors, space, col, invalid=invalid)


def write_stream(codes: DataFrame, path: str, checkpoint: str, **trigger):
    """Start appending codes to a Parquet table."""
    flat = codes.select(*[c for c in codes.columns if c != "code"], "code.packed", "code.norm", "code.gamma", "code.sigma")
    return flat.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(queries: DataFrame, codes: DataFrame, space: Space, within: float, mode: str = "asym") -> DataFrame:
    """Pairs of the (static, small) queries and streamed codes at a squared distance of at most ``within``."""
    return pairwise(queries, codes, space, mode).where(F.col("dist") <= within)
