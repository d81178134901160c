"""Repeated passages by prefix-free parsing.

A rolling hash over 16 bytes gives every position a value; a position is a trigger for the 50-byte windows of which it
holds the least value. Windows in a row with one trigger value form a phrase: the bytes from the first window's start to the
last one's end. Equal windows have equal trigger values, whatever surrounds them, so phrases of different trigger values
never share a window, and the corpus is sorted out trigger by trigger:

1. Each task parses its texts and collapses equal phrases: all but those in the least document are covered at once. What is left
   (one document per phrase and task) is packed and shuffled by trigger, so a phrase in a third of all documents
   weighs no more than the number of tasks.
2. Per trigger, equal phrases of different documents are settled by the least document. Where a trigger has different phrases (ends of
   passages, changed words), these make the dictionary to be compared, but for those that cannot share a window: a window holds the
   trigger's 16 bytes and 34 others, so 17 of these on one side, and both phrases must have the same ones there (``SIDE``).
3. The dictionary's bytes are fetched, and its suffix array is built to the depth that matters: ranks of 8, 16, 32, then 50 bytes by
   doubling. Equal ranks are equal 50-byte strings; the least document of each covers the others.
4. Covered ranges are merged per document and cut out.

Phrases are compared by 48 bits of the trigger value, 48 of the content hash and the bucket's bits; dictionary windows by their bytes.
With only matches to depth 50 asked for, the order of the parse beyond one phrase isn't needed: "smaller document" takes
the place of the parse's suffix ranks.

Defined results: a null or empty text has no bytes; texts under 50 bytes lose none; rows with a null doc_id lose none and
cover none; rows that repeat a doc_id are one document (none covers another); extra columns are kept by ``remove``, but for names that start with _pfp_, and
ignored by ``digest``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, remote, remote1, staged
from .shingles import mix

WINDOW, GRAM = 50, 16
SIDE = (WINDOW - GRAM + 1) // 2  # bytes before or after the trigger that two phrases with a common window share
CHUNK = 1 << 20
FLUSH = 1_200_000
LONGEST = 4096  # windows in a phrase
BASE_BITS = 40  # offsets above: which of the rows that repeat a doc_id
_HASH_BASE = 0x9E6C63D0876A9A47
PACKED = "bucket int, kind int, n int, data binary"
BUCKET_BYTES = 8 << 20
_INVERSE = pow(_HASH_BASE, -1, 1 << 64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base modulo 2^64, and of its inverse."""
    global _power, _inverse
    while len(_power) < n:
        k = len(_power)
        _power = np.concatenate([_power, _power * np.uint64(pow(_HASH_BASE, k, 1 << 64))])
        _inverse = np.concatenate([_inverse, _inverse * np.uint64(pow(_INVERSE, k, 1 << 64))])
    return _power, _inverse


def triggers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 50-byte window the least rolling-hash value within it; these values at each place."""
    h, s = raw.astype(np.uint64) + np.uint64(1), 1
    while s < GRAM:
        h = h[:-s] * np.uint64(pow(_HASH_BASE, s, 1 << 64)) + h[s:]
        s *= 2
    h, s, n = mix(h), 1, WINDOW - GRAM + 1
    each = h
    while 2 * s <= n:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (n - s)], h[n - s :]) if n > s else h, each


def parse(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of texts at [starts, ends) of ``raw``: trigger, content hash, text number, offset in the text, windows, and hashes of
    the trigger with SIDE bytes before it and with SIDE bytes after it.

    A side that goes beyond the phrase is 0. Both are 0 where the trigger's value is in the phrase more than once, so that another
    place may count in a window: such phrases are compared with all of their trigger.
    """
    none = np.empty(0, np.int64)
    long_enough = np.flatnonzero(ends - starts >= WINDOW)
    if not len(long_enough):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(np.uint32), none.astype(np.uint32)
    value, each = triggers(raw)
    begin, stop = starts[long_enough], ends[long_enough] - WINDOW + 1  # windows of each text
    edge = np.zeros(len(value) + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, stop, -1)
    flag = np.empty(len(value), bool)
    flag[0] = True
    np.not_equal(value[1:], value[:-1], out=flag[1:])
    flag[begin] = True
    at = np.flatnonzero(flag & (np.cumsum(edge[:-1], dtype=np.int32) > 0))
    text = np.searchsorted(begin, at, side="right") - 1
    limit = stop[text]
    windows = np.minimum(np.concatenate([at[1:], [len(value)]]), limit) - at
    if (windows > LONGEST).any():
        parts = -(-windows // LONGEST)
        which = np.repeat(np.arange(len(at)), parts)
        k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, windows, text = at[which] + k * LONGEST, np.minimum(LONGEST, windows[which] - k * LONGEST), text[which]
    power, inverse = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    content = mix((sums[at + windows + WINDOW - 1] - sums[at]) * inverse[at] + windows.astype(np.uint64))
    places = np.lib.stride_tricks.sliding_window_view(each, WINDOW - GRAM + 1)
    place, once = np.empty(len(at), np.int64), np.empty(len(at), bool)
    for k in range(0, len(at), 1 << 14):
        some = places[at[k : k + (1 << 14)]] == value[at[k : k + (1 << 14)], None]
        place[k : k + (1 << 14)] = some.argmax(axis=1)
        once[k : k + (1 << 14)] = some.sum(axis=1) == 1
    once &= windows <= place + 1  # all windows hold this place
    place += at
    sides = []
    for low, high in ((place - SIDE, place + GRAM), (place, place + GRAM + SIDE)):
        inside = once & (low >= at) & (high <= at + windows + WINDOW - 1)
        low, high = np.where(inside, low, 0), np.where(inside, high, 0)
        side = (mix((sums[high] - sums[low]) * inverse[low]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        sides.append(np.where(inside, side, np.uint32(0)))
    # Minima are small numbers: mixed again, their high bits spread over the buckets.
    return mix(value[at]), content, long_enough[text], at - starts[long_enough[text]], windows, *sides


def _pack(*columns: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of near-constant columns vanish."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


_PHRASE = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint32, np.uint32)
_RANGE = (np.int64, np.int64, np.int64)
_REQUEST = (np.int64, np.int64, np.int32, np.int32)
PHRASES, RANGES, REQUESTS = 0, 1, 2


def _low48(x: np.ndarray) -> np.ndarray:
    """The low 48 bits: zero planes compress away."""
    return x & np.uint64((1 << 48) - 1)


def _by_bucket(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = tuple(c[order] for c in columns)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), kind, b - a, _pack(*(np.ascontiguousarray(c[a:b]) for c in columns))


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "kind", "n", "data"])


def _collapse(trigger: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (trigger, content, doc); in that order: start of a phrase, and whether a smaller document has the phrase."""
    order = np.lexsort((doc, content, trigger))
    t, c, d = trigger[order], content[order], doc[order]
    new_t = np.ones(len(t), bool)
    new_t[1:] = t[1:] != t[:-1]
    new = new_t.copy()
    new[1:] |= c[1:] != c[:-1]
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    return order, new, new_t, d > least


def parse_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, base, text) to packed phrases by trigger bucket, and the ranges that are covered within the task."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        trigger, content, doc, start, windows, before, after = (np.concatenate(c) for c in zip(*held))
        held.clear()
        size = 0
        order, _, _, covered = _collapse(trigger, content, doc)
        trigger, content, doc, start, windows, before, after = (x[order] for x in (trigger, content, doc, start, windows, before, after))
        keep = ~covered
        bucket = (trigger >> np.uint64(64 - bits)).astype(np.int32)
        columns = (_low48(trigger), _low48(content), doc, start, windows.astype(np.int32), before, after)
        out = list(_by_bucket(bucket[keep], PHRASES, *(c[keep] for c in columns)))
        if covered.any():
            d, s, e = merged(doc[covered], start[covered], start[covered] + windows[covered] + WINDOW - 1)
            out += _by_bucket(_doc_bucket(d, 1 << bits), RANGES, d, s, e)
        return _rows(out)

    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        ids, bases = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
            spans = [(int(offsets[i]), int(offsets[j]))]
            if j == i + 1:  # one text, however long: chunks that overlap by a window
                a, b = spans[0]
                spans = [(x, min(b, x + CHUNK + WINDOW - 1)) for x in range(a, max(a + 1, b - WINDOW + 1), CHUNK)]
            for a, b in spans:
                starts, ends = (offsets[i:j] - a, offsets[i + 1 : j + 1] - a) if len(spans) == 1 else (np.zeros(1, np.int64), np.array([b - a]))
                trigger, content, text, start, windows, before, after = parse(raw[a:b], starts, ends)
                shift = a - int(offsets[i]) if len(spans) > 1 else 0
                if len(trigger):
                    held.append((trigger, content, ids[i + text].astype(np.int64), start + shift + (bases[i + text].astype(np.int64) << BASE_BITS), windows, before, after))
                    size += len(trigger)
                    if size >= FLUSH:
                        yield flush()
            i = j
    if held:
        yield flush()


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges per document: touching ranges become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    number = np.cumsum(first)
    top = int(end.max()) + 1
    if top < 1 << 42 and len(doc) < 1 << 20:
        reach = np.maximum.accumulate(end + number * top) - number * top
    else:
        reach = end.copy()
        for i in range(1, len(reach)):
            if not first[i]:
                reach[i] = max(reach[i], reach[i - 1])
    head = first.copy()
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return doc[at], start[at], reach[np.concatenate([at[1:] - 1, [len(doc) - 1]])]


def _may_share(group: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which phrases may have a window in common with one of another document: a side of the trigger is the same, or some phrase of the trigger has no sides."""
    keep = np.isin(group, group[(before == 0) & (after == 0)])
    for side in (before, after):
        some = np.flatnonzero(side)
        if len(some):
            order = some[np.lexsort((side[some], group[some]))]
            new = np.ones(len(order), bool)
            new[1:] = (group[order[1:]] != group[order[:-1]]) | (side[order[1:]] != side[order[:-1]])
            low, high = (f(doc[order], np.flatnonzero(new)) for f in (np.minimum.reduceat, np.maximum.reduceat))
            keep[order] |= (low != high)[np.cumsum(new) - 1]
    return keep


def settle_bucket(table: pa.Table, bits: int) -> pa.Table:
    """One trigger bucket: ranges covered by equal phrases, and requests for the phrases that need comparing."""
    out, parts = [], []
    for bucket, kind, n, data in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "n", "data"))):
        if kind == PHRASES:
            parts.append(_unpack(data, n, *_PHRASE))
        else:
            out.append((bucket, kind, n, data))
    if parts:
        trigger, content, doc, start, windows, before, after = (np.concatenate(c) for c in zip(*parts))
        order, new, new_t, covered = _collapse(trigger, content, doc)
        doc, start, windows, before, after = doc[order], start[order], windows[order].astype(np.int64), before[order], after[order]
        d, s, e = merged(doc[covered], start[covered], start[covered] + windows[covered] + WINDOW - 1)
        out += _by_bucket(_doc_bucket(d, 1 << bits), RANGES, d, s, e)
        group = np.cumsum(new_t) - 1
        several = np.bincount(group[new]) > 1  # triggers with more than one phrase
        at = np.flatnonzero(~covered & several[group])
        # A trigger whose phrases all stand in one document covers nothing.
        low, high = (f(doc, np.flatnonzero(new_t)) for f in (np.minimum.reduceat, np.maximum.reduceat))
        at = at[(low != high)[group[at]]]
        at = at[_may_share(group[at], doc[at], before[at], after[at])]
        bucket = table.column("bucket")[0].as_py()
        out += _by_bucket(_doc_bucket(doc[at], 1 << bits), REQUESTS, doc[at], start[at], windows[at].astype(np.int32), np.full(len(at), bucket, np.int32))
    return pa.Table.from_batches([_rows(out)])


def per_document(table: pa.Table, kind: int) -> pa.Table:
    """One document bucket: (doc_id, n, data) with the document's merged ranges, or its requests."""
    kinds = _RANGE if kind == RANGES else _REQUEST
    parts = [_unpack(d, n, *kinds) for n, d in zip(table.column("n").to_pylist(), table.column("data").to_pylist())]
    columns = [np.concatenate(c) for c in zip(*parts)]
    columns = merged(*columns) if kind == RANGES else [c[np.argsort(columns[0], kind="stable")] for c in columns]
    doc = columns[0]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = [*cuts[1:].tolist(), len(doc)]
    data = [_pack(*(np.ascontiguousarray(c[a:b]) for c in columns[1:])) for a, b in zip(cuts.tolist(), ends)]
    return pa.Table.from_arrays([pa.array(doc[cuts]), pa.array(np.diff([*cuts, len(doc)]).astype(np.int32)), pa.array(data, pa.binary())], ["_pfp_id", "_pfp_n", "_pfp_data"])


def fetch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, base, text, n, data) to packed dictionary entries by trigger bucket: documents, starts, windows, and bytes."""
    held: dict[int, list[tuple[int, int, bytes]]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for bucket, entries in held.items():
            meta = _pack(np.array([e[0] for e in entries], np.int64), np.array([e[1] for e in entries], np.int64), np.array([len(e[2]) for e in entries], np.int32))
            rows.append((bucket, len(meta), len(entries), meta + b"".join(e[2] for e in entries)))
        held.clear()
        return _rows(rows)

    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for i, (doc, base, n, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)))):
            if not texts[i].is_valid:
                continue
            text = texts[i].as_buffer()
            starts, windows, buckets = _unpack(data, n, *_REQUEST[1:])
            mine = starts >> BASE_BITS == base
            for s, w, b in zip(starts[mine].tolist(), windows[mine].tolist(), buckets[mine].tolist()):
                at = s & ((1 << BASE_BITS) - 1)
                part = text[at : at + w + WINDOW - 1].to_pybytes()
                held.setdefault(b, []).append((doc, s, part))
                size += len(part)
            if size > 16 << 20:
                yield flush()
                size = 0
    if held:
        yield flush()


def suffix_ranks(raw: np.ndarray) -> np.ndarray:
    """Ranks of the 50-byte prefixes of all suffixes that have one: prefix doubling, cut at that depth."""
    n = len(raw)
    word = np.zeros(n - 7, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | raw[k : n - 7 + k]
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    for step in (8, 16, 18):
        rank = np.unique((rank[:-step] << np.uint64(32)) | rank[step:], return_inverse=True)[1].astype(np.uint64)
    return rank[: n - WINDOW + 1]


def compare_bucket(table: pa.Table, bits: int) -> pa.Table:
    """One bucket's dictionary: windows that a smaller document has too, as ranges."""
    docs, starts, lens, data = [], [], [], []
    for size, n, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "data"))):
        d, s, k = _unpack(blob[:size], n, np.int64, np.int64, np.int32)
        docs.append(d)
        starts.append(s)
        lens.append(k.astype(np.int64))
        data.append(blob[size:])
    doc, start, length = np.concatenate(docs), np.concatenate(starts), np.concatenate(lens)
    rank = suffix_ranks(np.frombuffer(b"".join(data), np.uint8))
    windows = length - WINDOW + 1
    entry = np.repeat(np.arange(len(doc)), windows)
    within = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    mine = rank[(np.cumsum(length) - length)[entry] + within].astype(np.int64)
    least = np.full(int(mine.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, mine, doc[entry])
    hit = np.flatnonzero(least[mine] < doc[entry])
    at = start[entry[hit]] + within[hit]
    d, s, e = merged(doc[entry[hit]], at, at + WINDOW)
    return pa.Table.from_batches([_rows(list(_by_bucket(_doc_bucket(d, 1 << bits), RANGES, d, s, e)))])


def _cut(text: memoryview, ranges: list[tuple[int, int]]) -> Iterator[memoryview]:
    at = 0
    for a, b in ranges:
        yield text[at:a]
        at = b
    yield text[at:]


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, base, text, n, data) to the counts and the digest of what stays."""
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        rows = []
        for i, (doc, base, n, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)))):
            text = memoryview(texts[i].as_buffer()) if texts[i].is_valid else memoryview(b"")
            ranges = _own(base, n, data)
            sha = hashlib.sha256()
            for part in _cut(text, ranges):
                sha.update(part)
            rows.append((doc, len(text), sum(b - a for a, b in ranges), len(ranges), sha.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _own(base: int, n: int | None, data: bytes | None) -> list[tuple[int, int]]:
    if data is None:
        return []
    starts, ends = _unpack(data, n, np.int64, np.int64)
    mine = starts >> BASE_BITS == base
    low = base << BASE_BITS
    return list(zip((starts[mine] - low).tolist(), (ends[mine] - low).tolist()))


def remove_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., base, text, n, data) to (..., text): the bytes that stay; a character that is cut through is dropped."""
    for batch in batches:
        k = batch.num_columns - 4
        texts = batch.column(k + 1).cast(pa.large_binary())
        out = []
        for i, (base, n, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in (k, k + 2, k + 3)))):
            out.append(b"".join(_cut(memoryview(texts[i].as_buffer()), _own(base, n, data))).decode(errors="ignore") if texts[i].is_valid else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.string())], [*batch.schema.names[:k], "text"])


def _numbered(docs: DataFrame) -> DataFrame:
    """Add ``_pfp_base``: 0, or for rows that repeat a doc_id, the number of their text among the document's."""
    repeated = staged(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_pfp_again")).count().where("count > 1").select("_pfp_again"), "repeated")
    if repeated.isEmpty():
        return docs.withColumn("_pfp_base", F.lit(0))
    order = Window.partitionBy("doc_id").orderBy(F.sha2(F.coalesce("text", F.lit("")), 256))
    again = docs.join(repeated, F.col("doc_id") == F.col("_pfp_again"), "left_semi").withColumn("_pfp_base", F.dense_rank().over(order) - 1)
    return docs.join(repeated, F.col("doc_id") == F.col("_pfp_again"), "left_anti").withColumn("_pfp_base", F.lit(0)).union(again)


def _join_packed(left: DataFrame, packed: DataFrame, how: str) -> DataFrame:
    """Join on doc_id; packed data are broadcast if counted to be under 64 MB, else both sides are shuffled."""
    size = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_pfp_data") + 64), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= BROADCAST_ROWS and size["bytes"] <= 64 << 20
    return left.join(F.broadcast(packed) if small else packed, F.col("doc_id") == F.col("_pfp_id"), how)


PER_DOCUMENT = "_pfp_id long, _pfp_n int, _pfp_data binary"


def covered(docs: DataFrame) -> DataFrame:
    """(_pfp_id, _pfp_n, _pfp_data): packed ranges to remove of each document that has any. ``docs``: doc_id, _pfp_base, text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(4, (total // BUCKET_BYTES).bit_length()))
    slim = docs.where("doc_id is not null").select("doc_id", F.col("_pfp_base").cast("long"), "text")
    packed = slim.mapInArrow(remote(parse_batches, bits), PACKED)
    settled = staged(packed.groupBy("bucket").applyInArrow(remote1(settle_bucket, bits), PACKED), "settled")
    requests = staged(settled.where(F.col("kind") == REQUESTS).groupBy("bucket").applyInArrow(remote1(per_document, REQUESTS), PER_DOCUMENT), "requests")
    entries = _join_packed(slim, requests, "inner").select("doc_id", "_pfp_base", "text", "_pfp_n", "_pfp_data").mapInArrow(remote(fetch_batches), PACKED)
    compared = entries.groupBy("bucket").applyInArrow(remote1(compare_bucket, bits), PACKED)
    ranges = settled.where(F.col("kind") == RANGES).union(compared)
    return staged(ranges.groupBy("bucket").applyInArrow(remote1(per_document, RANGES), PER_DOCUMENT), "ranges")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    numbered = _numbered(docs.select("doc_id", "text"))
    joined = _join_packed(numbered, covered(numbered), "left").select("doc_id", F.col("_pfp_base").cast("long"), "text", "_pfp_n", "_pfp_data")
    return joined.mapInArrow(remote(digest_batches), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """The rows with covered bytes cut out of ``text``; other columns as they were, ``text`` last."""
    numbered = _numbered(docs)
    others = [c for c in docs.columns if c != "text"]
    joined = _join_packed(numbered, covered(numbered), "left").select(*others, F.col("_pfp_base").cast("long"), "text", "_pfp_n", "_pfp_data")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others, "text").schema.fields)
    return joined.mapInArrow(remote(remove_batches), kinds)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n - 49))) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
c AS (SELECT w.doc_id, w.p, CASE WHEN w.p <= lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) + 50 THEN 0 ELSE 1 END AS fresh
  FROM w JOIN m ON w.s = m.s WHERE m.first < w.doc_id),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (
  SELECT r.doc_id, r.a AS pos, substr(d.h, CAST(2 * coalesce(lag(r.b) OVER q, 0) + 1 AS BIGINT), CAST(2 * (r.a - coalesce(lag(r.b) OVER q, 0)) AS BIGINT)) AS part
  FROM r JOIN d ON r.doc_id = d.doc_id WINDOW q AS (PARTITION BY r.doc_id ORDER BY r.a)
  UNION ALL
  SELECT d.doc_id, d.n, substr(d.h, CAST(2 * coalesce(max(r.b), 0) + 1 AS BIGINT)) FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.n, d.h),
s AS (SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY pos))) AS kept_sha256 FROM k GROUP BY doc_id),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, s.kept_sha256 AS kept_sha256
FROM d JOIN s ON s.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
