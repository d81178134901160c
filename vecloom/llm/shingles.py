"""Sets of hashed word shingles of whole texts, in numpy over the bytes of many documents at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = (1 << 64) - 1
_SEEDS = np.array([0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93], np.uint64)


def parts_of(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of (id, text, ...) with at most ``rows`` rows and about ``size`` bytes of text; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings at ``start``: each eight bytes are mixed into the state, so no algebra of the bytes is left.

    All strings that have an i-th eight bytes take that step together; after a few steps only long ones are left, and
    from the 64th on those go through a library hash one by one.
    """
    whole = np.concatenate([low, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(whole, 8)
    state = mix(size.astype(np.uint64) * _SEEDS[1] + _SEEDS[0])
    live, at = np.arange(len(start)), 0
    while len(live) and at < 512:
        left = size[live] - at
        block = np.ascontiguousarray(words[start[live] + at]).view("<u8")[:, 0]
        spare = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
        block = (block << spare) >> spare
        state[live] = mix(state[live] * np.uint64(0xFF51AFD7ED558CCD) ^ mix(block + _SEEDS[0]))
        live, at = live[left > 8], at + 8
    for i in live.tolist():
        told = hashlib.blake2b(low[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest()
        state[i] = np.frombuffer(told, np.uint64)[0]
    return state


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts that lie end to end in ``raw``, and the number of words of each text."""
    counts = np.zeros(len(ends), np.int64)
    if not len(raw):
        return np.empty(0, np.uint64), counts
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw), bool)
    starts_of_texts = np.concatenate([[0], ends[:-1]])
    first[starts_of_texts[starts_of_texts < len(raw)]] = True
    start = np.flatnonzero(inside & (first | ~np.concatenate([[False], inside[:-1]])))
    stop = np.flatnonzero(inside & (np.concatenate([first[1:], [True]]) | ~np.concatenate([inside[1:], [False]]))) + 1
    hashes = _hashed(_LOWER[raw], start, stop - start)
    counts += np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(ends))
    return hashes, counts


def _segments(raw: np.ndarray) -> list[tuple[int, int]]:
    """Cut one long text at white space into segments of about SEGMENT bytes."""
    out, at = [], 0
    while len(raw) - at > SEGMENT:
        cut = at + SEGMENT
        while cut < len(raw):
            gap = np.flatnonzero(_SPACE[raw[cut : cut + 4096]])
            if len(gap):
                cut += int(gap[0])
                break
            cut = min(len(raw), cut + 4096)
        out.append((at, cut))
        at = cut
    out.append((at, len(raw)))
    return out


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; fewer words than ``width`` are one shingle, none are an empty set."""
    data = texts.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    parts, counts = [], np.zeros(len(data), np.int64)
    i = 0
    while i < len(ends):
        begin = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, begin + SEGMENT, side="right")))
        if j == i + 1 and ends[i] - begin > SEGMENT:
            for a, b in _segments(raw[begin : int(ends[i])]):
                h, c = word_hashes(raw[begin + a : begin + b], np.array([b - a]))
                parts.append(h)
                counts[i] += c[0]
        else:
            h, c = word_hashes(raw[begin : int(ends[j - 1])], ends[i:j] - begin)
            parts.append(h)
            counts[i:j] = c
        i = j
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    odd = [np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64) | 1) for j in range(width)]
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += mix(words[j : j + n] + odd[j])
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            whole = mix(words[at : at + c] + np.array(odd[:c], np.uint64)).sum(dtype=np.uint64)
            out.append(mix(np.array([int(whole) ^ (c * 0xE7037ED1A0B428DB & _MASK)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out
