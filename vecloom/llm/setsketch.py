"""Near-duplicate documents by SetSketch registers.

A register holds the least of exponentially distributed values of a set's elements, on a logarithmic scale of base
``B``, truncated to 16 bits: K = clip(floor(1 - log_B min), 0, 65535). Registers of a union are maxima of registers, and two sets
agree in a register about as often as their Jaccard similarity. Values come as points of one Poisson process per
element, each thrown to a random register, so only points below a bound that fills all registers are drawn.

Bands of registers propose pairs with the smallest document of each bucket; a maximum-likelihood estimate from all
registers and the exact set sizes drops those far below the threshold (by over six standard errors); the others are
verified on full sets. Then buckets that still hold several components are compared in blocks of bounded size, across
components only, estimates first. So links missed need all 32 bands to differ: 5e-8 at similarity 0.8, 5e-11 at 0.85.

Sets hold 64-bit hashes of shingles, mixed from whole words eight bytes at a time, so different shingles are taken for one with
a chance of 2^-64 a pair; nothing in the words' letters makes that likelier.

Defined results: no words, null or empty texts: no shingles, no links; equal sets are linked by their digest before any
sketch; rows with a null doc_id have no links and are kept; repeated doc_ids are one node, linked by any of their texts; extra columns
are ignored by ``classes`` and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import fitting_join, remote, remote1, staged
from .graph import components, spread
from .shingles import mix, parts_of, shingle_sets

M, ROWS, B, RATE = 128, 4, 1.02, 20.0
BANDS = M // ROWS
DOCS_AT_ONCE = 1024
BYTES_AT_ONCE = 4 << 20
SLACK = 0.2
BUCKET_ROWS = 1000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), M) uint16; all 0 for an empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(sets), M), np.inf)
    todo, reach = np.flatnonzero(sizes), math.log(M) + 5
    while len(todo):
        limit = np.zeros(len(sets))
        limit[todo] = reach / sizes[todo]
        owner = np.repeat(todo, sizes[todo])
        element = np.concatenate([sets[i] for i in todo])
        at, seed = np.zeros(len(element)), element.copy()
        flat = least.reshape(-1)
        while len(element):
            seed = seed + _GOLDEN
            z = mix(seed)
            at = at - np.log(((z >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / M
            live = at <= limit[owner]
            owner, element, at, seed, z = owner[live], element[live], at[live], seed[live], z[live]
            np.minimum.at(flat, owner * M + (z & np.uint64(M - 1)).astype(np.int64), at)
        todo, reach = todo[np.isinf(least[todo]).any(1)], reach * 2
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / math.log(B))
    k[sizes == 0] = 0
    return np.clip(k, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimates of row pairs, given the exact sizes of the sets."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    top = np.minimum(na / nb, nb / na)[:, None]
    j = np.minimum(_GRID[None, :], top)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B)
    tiny = 1e-12
    pm, pl = np.maximum(p(u - v * j), tiny), np.maximum(p(v - u * j), tiny)
    like = more * np.log(pm) + less * np.log(pl) + (M - more - less) * np.log(np.maximum(1 - pm - pl, tiny))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


SKETCH = "doc_id long, n long, digest binary, regs binary"


def sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, DOCS_AT_ONCE, BYTES_AT_ONCE):
            sets = shingle_sets(part.column(1).fill_null(""), width)
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                ["doc_id", "n", "digest", "regs"],
            )


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, DOCS_AT_ONCE, BYTES_AT_ONCE):
            sets = shingle_sets(part.column(1).fill_null(""), width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, regs) to one row (key, doc_id) for each band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _regs(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for r in range(ROWS):
            key = mix(key * _GOLDEN + regs[:, :, r])
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "doc_id"])


def estimate_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ra, rb) to the pairs (a, b) whose estimate reaches ``least``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float)
        keep = np.flatnonzero(similarity(_regs(batch.column(4)), _regs(batch.column(5)), na, nb) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])


def verify_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) with full sets to the pairs with 100 * |intersection| >= percent * |union|."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
            both = np.intersect1d(x, y, assume_unique=True).size
            if both and 100 * both >= percent * (x.size + y.size - both):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])


def block_pairs(table: pa.Table, least: float) -> pa.Table:
    """One pair of blocks of a bucket: pairs across components whose estimate reaches ``least``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    side = table.column("side").to_numpy()
    ids, comp = table.column("doc_id").to_numpy(), table.column("comp").to_numpy()
    n, regs = table.column("n").to_numpy().astype(float), _regs(table.column("regs").combine_chunks())
    left, right = np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero((side == 1) | (side == 2))
    out_a, out_b = [], []
    for i in left.tolist():
        near = right[(comp[right] != comp[i]) & (ids[right] > ids[i] if side[i] == 2 else True)]
        near = near[np.minimum(n[near], n[i]) >= least * np.maximum(n[near], n[i])]
        if len(near):
            est = similarity(np.broadcast_to(regs[i], (len(near), M)), regs[near], np.full(len(near), n[i]), n[near])
            for j in near[est >= least].tolist():
                out_a.append(min(ids[i], ids[j]))
                out_b.append(max(ids[i], ids[j]))
    return pa.Table.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) that hold on full sets; only texts of documents in ``pairs`` are read into sets."""
    ids = staged(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "ids")
    chosen = fitting_join(docs.select("doc_id", "text"), ids, F.col("doc_id") == F.col("_id"), "inner").select("doc_id", "text")
    sets = chosen.mapInArrow(remote(set_batches, width), "doc_id long, shingles binary")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return staged(both.mapInArrow(remote(verify_batches, percent), "a long, b long").distinct(), "verified")


def links(docs: DataFrame, percent: int = 80, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sketches (doc_id, n, digest) of all rows, and (node, component) of all linked documents."""
    sketches = staged(docs.select("doc_id", "text").mapInArrow(remote(sketch_batches, width), SKETCH), "sketches")
    some = sketches.where("n > 0 and doc_id is not null")
    reps = staged(some.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "regs")).alias("r")).select("digest", "r.*"), "representatives")
    equal = some.select("digest", F.col("doc_id").alias("b")).join(reps.select("digest", F.col("doc_id").alias("a")), "digest").where("a <> b").select("a", "b").distinct()
    least = percent / 100 - SLACK
    bands = reps.select("doc_id", "regs").mapInArrow(remote(band_batches), "key long, doc_id long")
    pivots = bands.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("rows")).where("rows > 1").select("key", "pivot")
    buckets = staged(bands.join(pivots, "key"), "buckets")
    stars = buckets.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    one = reps.groupBy("doc_id").agg(F.max(F.struct("n", "regs")).alias("s")).select("doc_id", "s.*")  # repeated ids
    ra, rb = one.toDF("a", "na", "ra"), one.toDF("b", "nb", "rb")
    near = stars.join(ra, "a").join(rb, "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ra", "rb")
    passed = staged(near.mapInArrow(remote(estimate_batches, least), "a long, b long"), "passed")
    first = passed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    known = _verified(docs, first, percent, width)
    comp = components(known)
    # Buckets that still span several components: compare across components, in blocks of bounded size.
    tagged = buckets.join(comp.toDF("doc_id", "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    blocks = spread(tagged.withColumnRenamed("doc_id", "node"), BUCKET_ROWS).withColumnRenamed("node", "doc_id").select("key", "doc_id", "comp", "x", "y", "side")
    across = blocks.join(one, "doc_id").groupBy("key", "x", "y").applyInArrow(remote1(block_pairs, least), "a long, b long").distinct()
    fresh = staged(across.join(first, ["a", "b"], "left_anti"), "across")
    more = _verified(docs, fresh, percent, width) if not fresh.isEmpty() else known.limit(0)
    return sketches, components(known.union(more).union(equal))


def classes(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    sketches, comp = links(docs, percent, width)
    joined = sketches.select("doc_id", "n").join(comp.toDF("doc_id", "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of each component's smallest doc_id; all columns as they were."""
    _, comp = links(docs, percent, width)
    gone = staged(comp.where("node <> component").select("node"), "gone")
    own = next(n for n in (f"_gone{i}" for i in range(len(docs.columns) + 1)) if n.lower() not in {c.lower() for c in docs.columns})
    gone = gone.select(F.col("node").alias(own))
    return fitting_join(docs, gone, docs["doc_id"] == gone[own], "left_anti")


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g, len(w) >= 5 AS whole FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s AS a JOIN s AS b ON a.g = b.g AND a.whole = b.whole AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id AS component_id, c.doc_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
