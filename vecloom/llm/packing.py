"""Best-fit packing by a configuration linear program over the length histogram.

Lengths up to the capacity are counted over the whole corpus; that histogram has at most ``capacity`` rows, whatever the
corpus, and is all that the driver sees. The program's columns are configurations: multisets of length classes that fit
one sequence. It is solved by multiplicative weights: each length class has a weight that shrinks as it is covered, and
an unbounded-knapsack dynamic program prices the best configuration under the weights. The weights also bound the program
from below, and the rounds end when the solution is within a twentieth of that. It is rounded to whole copies of the
configurations; their actual lengths are drawn from the classes, and what room is left is filled by best fit.
Everything is kept as (configuration, multiplicity), so the work depends on the histogram and not on the number of documents.

Pieces then find their places by rank: the i-th piece of a length takes the i-th slot of that length.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import remote, staged
from . import bpe
from .shingles import parts_of

DOCS_AT_ONCE, BYTES_AT_ONCE = 1024, 8 << 20
#: Parts of words that a worker holds (about 0.2 GB).
MAX_PARTS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# --- token ids -------------------------------------------------------------------------------------------------------


#: What this module reads by itself; a file with another normaliser or splitter goes through the library as a whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏḀ-ỿ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"


class WordTokenizer:
    """The ids of a ``tokenizers`` BPE file with word ends, through a cache of parts of words.

    Lower-cased texts are split into letters, digits and signs as the file's splitter does. Texts with characters for which
    that is not plain (control characters, spaces beyond ASCII, other scripts, special tokens), and all texts where the
    file has settings other than those this class knows, go through the library as a whole. The cache has two
    generations of MAX_PARTS // 2 entries: when one is full the one before it is forgotten, and what is met again moves up.
    """

    _WHOLE = re.compile(r"[^\t\n\r !-~\xa1-ɏḀ-ỿ]|<\|")
    _PARTS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, splitters = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.known = (
            told.get("normalizer") == _NORMALIZER and splitters[:1] == [_SPLITTER] and [x.get("type") for x in splitters[1:]] == ["ByteLevel"]
            and not splitters[1].get("add_prefix_space") and not splitters[1].get("use_regex", True) and not told.get("truncation") and not told.get("padding")
            and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges"))
            and all(x.get("special") and not x.get("normalized") and x["content"].startswith("<|") for x in told.get("added_tokens", []))
        )
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if not self.known:
            return
        vocab, end, alphabet = model["vocab"], model["end_of_word_suffix"], _byte_alphabet()
        lefts, rights, ids = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            lefts.append(vocab[a])
            rights.append(vocab[b])
            ids.append(vocab[a + b])
        merges = bpe.Merges(np.array(lefts), np.array(rights), np.arange(len(ids)), np.array(ids))
        first = np.array([vocab[alphabet[i]] for i in range(256)])
        last = np.array([vocab[alphabet[i] + end] for i in range(256)])
        self.encoder = bpe.PieceEncoder(merges, first, last)

    def _learn(self, parts: set[str]) -> None:
        """Bring all of ``parts`` into the newer generation."""
        known = {p: ids for p in parts if (ids := self.old.get(p)) is not None}
        fresh = [p for p in parts if p not in known]
        if len(self.new) + len(parts) > MAX_PARTS // 2:
            self.old, self.new = self.new, {}
        self.new |= known
        self.new.update(zip(fresh, self.encoder.encode([p.encode() for p in fresh])))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        held: list[int | bytes] = []
        parts: list[str] = []
        for text in texts:
            text = text or ""
            if self.known and not text.isascii():
                text = unicodedata.normalize("NFC", text)
            low = text.lower()
            if not self.known or self._WHOLE.search(low) or "İ" in text:
                held.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                parts += self._PARTS.findall(low)
                held.append(len(parts))
        found = list(map(self.new.get, parts))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            self._learn({parts[i] for i in missing})
            for i in missing:
                found[i] = self.new[parts[i]]
        out, at = [], 0
        for x in held:
            if isinstance(x, bytes):
                out.append(x)
            else:
                out.append(b"".join(found[at:x]))
                at = x
        return out


def _byte_alphabet() -> list[str]:
    """The printable stand-ins for bytes that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool = False) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the pieces of each document: ids, then ``end_id``, cut only where longer than ``capacity``."""
    tokenizer, tail = load(path), int(end_id).to_bytes(4, "little")
    for batch in batches:
        for part in parts_of(batch, DOCS_AT_ONCE, BYTES_AT_ONCE):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode_all(part.column(1).to_pylist())):
                ids += tail
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[start : start + 4 * capacity]
                    row = (doc_id, k, start // 4, len(piece) // 4, zlib.crc32(piece))
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names[: len(cols)])


# --- the plan --------------------------------------------------------------------------------------------------------


def _knapsack(worth: np.ndarray, sizes: np.ndarray, sand: float, room: int) -> tuple[float, np.ndarray, int]:
    """Unbounded knapsack in exact sizes: the greatest worth of a configuration, its counts by class, and the room left for sand.

    As no class is smaller than ``sizes.min()``, that many capacities at once depend on earlier ones only.
    """
    best, took = np.full(room + 1, -np.inf), np.full(room + 1, -1)
    best[0] = 0.0
    if len(sizes):
        block = int(sizes.min())
        for c in range(block, room + 1, block):
            at = np.arange(c, min(c + block, room + 1))[:, None] - sizes[None, :]
            value = np.where(at >= 0, best[np.maximum(at, 0)], -np.inf) + worth
            took[c : c + block] = value.argmax(1)
            best[c : c + block] = value.max(1)
    c = int((best + sand * np.arange(room, -1, -1)).argmax())
    total, left, counts = float(best[c] + sand * (room - c)), room - c, np.zeros(len(sizes), np.int64)
    while c > 0:
        counts[took[c]] += 1
        c -= int(sizes[took[c]])
    return total, counts, left


def configuration_program(sizes: np.ndarray, demand: np.ndarray, sand: int, room: int, epsilon: float = 0.05) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Multiplicative weights for: least total of x over configurations that covers each class k, of ``sizes[k]``, ``demand[k]``
    times, and leaves room for ``sand`` in all.

    Returns ([(counts by class, x)], a lower bound of the program). The weights are dual prices: scaled by the worth
    of the best configuration they bound the program from below. Rounds come in windows, each twice as long as the one before and with
    smaller steps; a window's configurations, scaled by its least coverage, are a solution, and the first that is
    within 1 + ``epsilon`` of the bound is returned.
    """
    asked = np.append(demand, sand).astype(float)
    live = asked > 0
    if not live.any():
        return [], 0.0
    asked = np.maximum(asked, 1)
    covered, bound, step, rounds = np.where(live, 0.0, np.inf), 0.0, 0.5, 64

    def price(worth: np.ndarray) -> tuple[np.ndarray, float]:
        best, counts, left = _knapsack(worth[:-1], sizes, float(worth[-1]), room)
        return np.append(counts, left), float((worth * asked).sum()) / best

    while True:
        fresh, found, total, prices = np.where(live, 0.0, np.inf), {}, 0.0, np.zeros(len(asked))
        for _ in range(rounds):
            worth = np.exp(covered.min() - covered) / asked
            row, told = price(worth)
            bound = max(bound, told)
            prices += worth / (worth * asked).sum()
            used = np.flatnonzero(row * live)
            x = step * float((asked[used] / row[used]).min())
            for c in (covered, fresh):
                c[used] += x * row[used] / asked[used]
            found.setdefault(row.tobytes(), [row[:-1], 0.0])[1] += x
            total += x
            if total <= (1 + epsilon) * bound * fresh.min():
                break
        bound = max(bound, price(prices)[1])  # the average of a window's prices is often the better bound
        if total <= (1 + epsilon) * bound * fresh.min():
            return [(c, v / fresh.min()) for c, v in found.values()], bound
        rounds, step = 2 * rounds, step * 0.75


class _Stock:
    """Counts by length, with the largest stocked length at most a bound in logarithmic time."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)

    def largest(self, most: int, least: int = 1) -> int | None:
        i = bisect.bisect_right(self.lengths, most) - 1
        return self.lengths[i] if i >= 0 and self.lengths[i] >= least else None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))


def _close(stock: _Stock, room: int, chosen: dict[int, int], most: int | None) -> tuple[dict[int, int], int]:
    """Fill one bin by best fit on top of ``chosen``, and take as many copies of it as the stock and ``most`` allow."""
    while room > 0:
        n = stock.largest(room)
        while n is not None and stock.left[n] <= chosen.get(n, 0):
            n = stock.largest(n - 1)
        if n is None:
            break
        chosen[n] = chosen.get(n, 0) + 1
        room -= n
    able = [stock.left[n] // a for n, a in chosen.items()]
    copies = min(able if most is None else [most, *able])
    for n, a in chosen.items():
        stock.take(n, a * copies)
    return chosen, copies


def classes_of(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, int]:
    """Length classes [(least, most)], their sizes and demands, and the volume of the sand.

    Pieces of over a sixteenth of the capacity are cut, by length, into at most ``groups`` classes of about equal counts, as large as
    their pieces are on average: what is longer than that is matched with what is shorter when lengths are drawn.
    Shorter pieces are sand, which fills any room.
    """
    large = sorted((n, c) for n, c in histogram.items() if capacity // 16 < n < capacity)
    whole, held, group = sum(c for _, c in large), 0, -1
    bounds: list[tuple[int, int]] = []
    counts: list[int] = []
    volumes: list[int] = []
    for i, (n, c) in enumerate(large):
        now = held * groups // whole if len(large) > groups else i
        if now != group:
            bounds.append((n, n))
            counts.append(0)
            volumes.append(0)
            group = now
        bounds[-1] = (bounds[-1][0], n)
        counts[-1] += c
        volumes[-1] += n * c
        held += c
    sizes = [round(v / c) for v, c in zip(volumes, counts)]
    return bounds, np.array(sizes, np.int64), np.array(counts, np.int64), sum(n * c for n, c in histogram.items() if n <= capacity // 16)


def plan(histogram: dict[int, int], capacity: int, groups: int = 48) -> list[tuple[dict[int, int], int]]:
    """Bins as (lengths with counts, copies), covering the histogram exactly."""
    return [(lengths, copies) for lengths, copies, _ in planned(histogram, capacity, groups)]


def planned(histogram: dict[int, int], capacity: int, groups: int = 48) -> list[tuple[dict[int, int], int, bool]]:
    """As ``plan``, with whether the bin is a configuration's.

    The solution, scaled to the program's lower bound so that no class is drawn beyond its demand on the whole, is rounded by
    running totals: each configuration gets the copies between the rounded totals before and after it. Its classes draw
    their longest stocked lengths that still fit, best fit closes the bin, and takes what rounding leaves over at the end.
    """
    bins, stock = [], _Stock(histogram)
    if capacity in stock.left:
        bins.append(({capacity: 1}, stock.left[capacity], True))
        stock.take(capacity, stock.left[capacity])
    bounds, sizes, demand, sand = classes_of(stock.left, capacity, groups)
    solution, bound = configuration_program(sizes, demand, sand, capacity)
    share = bound / max(sum(x for _, x in solution), bound, 1e-9)
    solution.sort(key=lambda p: p[0][::-1].tolist())
    tried = [_rounded(stock, capacity, bounds, [(counts, x * share * part) for counts, x in solution]) for part in SHARES]
    return bins + min(tried, key=lambda t: sum(copies for _, copies, _ in t))


#: Shares of the solution that are rounded; the rounding that needs fewest sequences is kept.
SHARES = (1.0, 0.8, 0.6)


def _rounded(whole: _Stock, capacity: int, bounds: list[tuple[int, int]], solution: list[tuple[np.ndarray, float]]) -> list[tuple[dict[int, int], int, bool]]:
    bins, stock, total = [], _Stock(whole.left), 0.0
    for counts, x in solution:
        copies = round(total + x) - round(total)
        total += x
        while copies > 0 and stock.lengths:
            chosen, room = {}, capacity
            for k in np.flatnonzero(counts)[::-1].tolist():
                least, most = bounds[k]
                for _ in range(int(counts[k])):
                    n = stock.largest(min(most, room), least)
                    while n is not None and stock.left[n] <= chosen.get(n, 0):
                        n = stock.largest(n - 1, least)
                    if n is None:
                        break
                    chosen[n] = chosen.get(n, 0) + 1
                    room -= n
            lengths, made = _close(stock, room, chosen, copies)
            bins.append((lengths, made, True))
            copies -= made
    while stock.lengths:
        bins.append((*_close(stock, capacity, {}, None), False))
    return bins


def slots(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, per bin, first sequence, offset): which ranks of a length go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for bin_, copies in bins:
        offset = 0
        for n, a in sorted(bin_.items(), reverse=True):
            out.append((n, used.get(n, 0), a * copies, a, sequence, offset))
            used[n] = used.get(n, 0) + a * copies
            offset += n * a
        sequence += copies
    return out


def place_batches(batches: Iterator[pa.RecordBatch], table: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Add sequence_id and offset to pieces whose last column is their rank within their length."""
    t = np.array(sorted(table), np.int64).reshape(-1, 6)
    starts = (t[:, 0] << 44) + t[:, 1]
    for batch in batches:
        length = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
        rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        row = t[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
        within = rank - row[:, 1]
        sequence = row[:, 4] + within // row[:, 3]
        offset = row[:, 5] + within % row[:, 3] * length
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


HOT_LENGTH = 250_000


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Ranks from 0 within each length; lengths with more than HOT_LENGTH pieces are ranked in salted parts."""
    hot = [(n, -(-c // HOT_LENGTH)) for n, c in histogram.items() if c > HOT_LENGTH]
    key = F.xxhash64("doc_id", "piece", "start")
    if not hot:
        salted = pieces.withColumn("_salt", F.lit(0).cast("long"))
    else:
        parts = pieces.sparkSession.createDataFrame(hot, "length long, _parts long")
        salted = pieces.join(F.broadcast(parts), "length", "left").withColumn("_salt", F.pmod(key, F.coalesce("_parts", F.lit(1)))).drop("_parts")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    out = salted.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    if hot:
        sizes = salted.groupBy("length", "_salt").count()
        before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        out = out.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their sequence and place.

    A null or empty text is one piece of the end id alone. Repeated rows are packed one by one; rows with a null doc_id
    too. An empty table gives no rows. Extra columns are ignored.
    """
    kinds = PIECES + (", ids array<int>" if with_ids else "")
    pieces = staged(docs.select("doc_id", "text").mapInArrow(remote(piece_batches, path, capacity, end_id, with_ids), kinds), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slots(plan(histogram, capacity))
    names = [c for c in pieces.columns if c != "length"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names, "length").schema.fields)
    placed = ranked(pieces, histogram).select(*names, "length", "_rank").mapInArrow(remote(place_batches, table), kinds + ", sequence_id long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
