"""Byte-level BPE: a segment tree over byte positions holds the leftmost minimum pair rank.

Each leaf is the rank of the pair that starts at a live position, times the width of the tree, plus the position, so
the root is the leftmost pair of least rank. A merge changes three leaves (the merged pair, its dead right half, the
live left neighbour), each in logarithmically many nodes. Short pieces run through one tree per row of a numpy block;
pieces over 64 bytes use a scalar tree over arrays, O(n log n) for a piece of n bytes.

Workers keep the pieces they have met in a bounded cache (``MAX_CACHE`` entries, then it starts anew), so memory doesn't
grow with the vocabulary of the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from .shingles import parts_of

MAX_CACHE = 400_000
DOCS_AT_ONCE, BYTES_AT_ONCE = 256, 8 << 20
INF = 1 << 40
WIDEST = 64

#: The pattern that the fast form below stands for.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces as that pattern for texts of ASCII and Latin-1 letters only, which ``re`` splits faster.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_ODD = re.compile(rf"[^\t\n\x0b\f\r !-~{_LETTERS}]")
_FAST = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def exact_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with \s as Unicode's White_Space, as the tokenizer library reads it."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Merges:
    """Ranks of pairs of token ids. ``pairs``: (left id, right id) -> (rank, id of the merged token)."""

    def __init__(self, lefts: np.ndarray, rights: np.ndarray, ranks: np.ndarray, ids_by_rank: np.ndarray):
        if len(keys_ := np.concatenate([lefts, rights])) and not 0 <= keys_.min() <= keys_.max() < 1 << 20:
            raise ValueError("token ids must be below 2^20")
        keys = (lefts.astype(np.int64) << 20) | rights
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], ranks.astype(np.int64)[order]
        self.ids_by_rank = ids_by_rank.astype(np.int32)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.zeros(1 << bits, np.int64)
        todo = np.arange(len(keys))
        at = self._home(self.keys)
        while len(todo):  # open addressing, all keys at once
            free = self.slot[at] < 0
            self.slot[at[free]] = self.keys[todo[free]]
            self.slot_rank[at[free]] = self.ranks[todo[free]]
            lost = self.slot[at] != self.keys[todo]
            todo, at = todo[lost], (at[lost] + 1) & self.mask
        self._dict: dict[int, int] | None = None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of many pairs; INF where a pair doesn't merge."""
        keys = (left.astype(np.int64) << 20) | right
        at = self._home(keys)
        found = self.slot[at]
        out = np.where(found == keys, self.slot_rank[at], INF)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def rank_of(self, left: int, right: int) -> int:
        if self._dict is None:
            self._dict = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._dict.get((left << 20) | right, INF)


def merge_block(tok: np.ndarray, lens: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge every row of ``tok`` (n, width) as far as it goes; dead places become -1."""
    n, width = tok.shape
    cols = np.arange(width)
    nxt = np.broadcast_to(cols + 1, (n, width)).copy()
    nxt[np.arange(n), lens - 1] = width
    prv = np.broadcast_to(cols - 1, (n, width)).copy()
    tok[cols >= lens[:, None]] = -1
    tree = np.full((n, 2 * width), INF * width, np.int64)
    valid = cols[:-1] < lens[:, None] - 1
    ranks = merges.rank(tok[:, :-1][valid], tok[:, 1:][valid])
    tree[:, width : 2 * width - 1][valid] = np.where(ranks < INF, ranks * width + np.broadcast_to(cols[:-1], valid.shape)[valid], INF * width)
    half = width >> 1
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half >>= 1
    tok_, nxt_, prv_, tree_ = tok.reshape(-1), nxt.reshape(-1), prv.reshape(-1), tree.reshape(-1)
    rows = np.flatnonzero(tree[:, 1] < INF * width)
    while len(rows):
        root = tree[rows, 1]
        pos, base, top = root % width, rows * width, rows * (2 * width)
        new = merges.ids_by_rank[root // width]
        right = nxt_[base + pos]
        after = nxt_[base + right]
        before = prv_[base + pos]
        tok_[base + pos] = new
        tok_[base + right] = -1
        nxt_[base + pos] = after
        has_after, has_before = after < width, before >= 0
        prv_[(base + after)[has_after]] = pos[has_after]
        tree_[top + width + right] = INF * width
        leaf = np.full(len(rows), INF * width, np.int64)
        r = merges.rank(new[has_after], tok_[(base + after)[has_after]])
        leaf[has_after] = np.where(r < INF, r * width + pos[has_after], INF * width)
        tree_[top + width + pos] = leaf
        b_top, b_before = top[has_before], before[has_before]
        r = merges.rank(tok_[base[has_before] + b_before], new[has_before])
        tree_[b_top + width + b_before] = np.where(r < INF, r * width + b_before, INF * width)
        up = np.concatenate([width + pos, width + right, width + b_before])
        tops = np.concatenate([top, top, b_top])
        level = width
        while level > 1:
            up >>= 1
            child = tops + 2 * up
            tree_[tops + up] = np.minimum(tree_[child], tree_[child + 1])
            level >>= 1
        rows = rows[tree[rows, 1] < INF * width]
    return tok


def merge_long(tok: list[int], merges: Merges) -> list[int]:
    """One piece of any length, by a scalar segment tree."""
    n = len(tok)
    width = 1 << max(1, (n - 1).bit_length())
    none = INF * width
    tree = array("q", [none]) * (2 * width)
    for i in range(n - 1):
        r = merges.rank_of(tok[i], tok[i + 1])
        if r < INF:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    nxt, prv = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    ids = merges.ids_by_rank
    while (root := tree[1]) < none:
        pos = root % width
        right = nxt[pos]
        tok[pos] = new = int(ids[root // width])
        after = nxt[pos] = nxt[right]
        tok[right] = -1
        put(right, none)
        r = INF
        if after < n:
            prv[after] = pos
            r = merges.rank_of(new, tok[after])
        put(pos, r * width + pos if r < INF else none)
        before = prv[pos]
        if before >= 0:
            r = merges.rank_of(tok[before], new)
            put(before, r * width + before if r < INF else none)
    return [t for t in tok if t >= 0]


class PieceEncoder:
    """Pieces of bytes to little-endian unsigned 32-bit ids. ``first``: id of each byte; ``last``: of a piece's last byte."""

    def __init__(self, merges: Merges, first: np.ndarray, last: np.ndarray | None = None):
        self.merges, self.first, self.last = merges, first.astype(np.int32), None if last is None else last.astype(np.int32)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width, low = 2, 0
        while width <= WIDEST:
            chosen = np.flatnonzero((lens > low) & (lens <= width))
            for i in range(0, len(chosen), 16384):
                self._block(pieces, chosen[i : i + 16384], lens, width, out)
            low, width = width, width * 2
        for i in np.flatnonzero(lens > WIDEST).tolist():
            tok = self.first[np.frombuffer(pieces[i], np.uint8)].tolist()
            if self.last is not None:
                tok[-1] = int(self.last[pieces[i][-1]])
            out[i] = np.array(merge_long(tok, self.merges), "<u4").tobytes()
        return out

    def _block(self, pieces: list[bytes], chosen: np.ndarray, lens: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in chosen.tolist()), np.uint8).reshape(-1, width)
        n, tok = lens[chosen], self.first[raw]
        if self.last is not None:
            at = np.arange(len(chosen))
            tok[at, n - 1] = self.last[raw[at, n - 1]]
        tok = merge_block(tok, n, self.merges)
        live = tok >= 0
        ends = np.cumsum(live.sum(1)) * 4
        data = tok[live].astype("<u4").tobytes()
        start = 0
        for i, end in zip(chosen.tolist(), ends.tolist()):
            out[i] = data[start:end]
            start = end


class RankTokenizer:
    """A rank file: base64 token and rank per line. The rank of a pair is that of its joined bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern, self.fast = exact_pattern(pattern), pattern == _KNOWN
        size = max(self.ranks.values()) + 1
        self.vocab = [b""] * size
        lefts, rights, ranks = [], [], []
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    ranks.append(rank)
        merges = Merges(np.array(lefts, np.int64), np.array(rights, np.int64), np.array(ranks, np.int64), np.arange(size))
        self.encoder = PieceEncoder(merges, np.array([self.ranks[bytes([i])] for i in range(256)]))
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if self.fast and not _ODD.search(text):
            return _FAST.findall(text)
        return [m[0] for m in self.pattern.finditer(text)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > MAX_CACHE:
            self.cache.clear()
        get, missing, held = self.cache.get, set(), []
        for text in texts:
            pieces = self.split(text or "")
            found = list(map(get, pieces))
            if None in found:
                missing.update(p for p, f in zip(pieces, found) if f is None)
                held.append((pieces, None))
            else:
                held.append((None, b"".join(found)))
        if missing:
            new = list(missing)
            self.cache.update(zip(new, self.encoder.encode([p.encode() for p in new])))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) if ids is None else ids for pieces, ids in held]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], RankTokenizer] = {}


def load(path: str, pattern: str) -> RankTokenizer:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankTokenizer(path, pattern)
    return _LOADED[path, pattern]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids): the general operator's real output."""
    tokenizer = load(path, pattern)
    for batch in batches:
        for part in parts_of(batch, DOCS_AT_ONCE, BYTES_AT_ONCE):
            coded = [np.frombuffer(x, "<u4").astype(np.int32) for x in tokenizer.encode_all(part.column(1).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])


def digest_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the digests of the ids and of the bytes decoded from them."""
    tokenizer = load(path, pattern)
    for batch in batches:
        for part in parts_of(batch, DOCS_AT_ONCE, BYTES_AT_ONCE):
            coded = tokenizer.encode_all(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(tokenizer.decode(x)).hexdigest() for x in coded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode(docs, path: str, pattern: str):
    """DataFrame (doc_id, text) to (doc_id, ids). A null or empty text has no ids; rows, columns and tables as in ``encode_digests``."""
    from ..runtime import remote

    return docs.select("doc_id", "text").mapInArrow(remote(encode_batches, path, pattern), "doc_id long, ids array<int>")


def encode_digests(docs, path: str, pattern: str):
    """DataFrame (doc_id, text) to one row of digests per input row.

    A null or empty text has no ids and the digests of nothing; a null doc_id is kept; texts of any length are encoded whole, and
    repeated rows one by one; extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    from ..runtime import remote

    return docs.select("doc_id", "text").mapInArrow(remote(digest_batches, path, pattern), DIGESTS)
