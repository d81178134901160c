"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

Features are built-in column expressions only. The learner sees a bounded sample of labelled rows
(``max_labelled``), keeps each candidate threshold as a bitset over that sample, grows conjunctions by FOIL gain on
two thirds of it, prunes them on the rest, and emits an ordered list of rules. A rule's consequent is always
"reject"; what no rule matches is kept.

Defined results: a null or empty text has no words and fails the base rule; labels that are null or
whose document is missing are unused; no usable labels give an empty list, which keeps all that passes the base rule;
repeated rows are judged one by one; columns of the input that clash with the features are overwritten by
``with_features`` only under its own names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = " \t\n\x0b\f\r"
WS_CLASS = r"[ \t\n\x0B\f\r]"
FEATURES = ("f_words", "f_word_len", "f_symbols", "f_dup_lines", "f_repeat", "f_upper", "f_bang", "f_distinct")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """Bind an expression once and use it many times within ``body``: lambdas would evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


_POS_BITS = 24  # window positions in the low bits of the sort key; longer texts skip the hash filter


def _window_keys(w: Column) -> Column:
    """Sorted (hash of 3-word window, position) as longs; equal windows become neighbours."""
    key = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _POS_BITS).bitwiseOR(i.cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), key)
    return F.when((F.size(w) < 3) | (F.size(w) > (1 << _POS_BITS)), F.array().cast("array<bigint>")).otherwise(F.sort_array(windows))


def _maybe_repeated(keys: Column) -> Column:
    """Positions whose hash equals a neighbour's: all repeated windows, and chance collisions."""
    top = lambda x: F.shiftright(x, _POS_BITS)
    near = lambda s, x, j: F.coalesce(top(x) == top(F.get(s, j - 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(s, j + 1)), F.lit(False))
    return let(keys, lambda s: F.transform(F.filter(s, lambda x, j: near(s, x, j)), lambda x: x.bitwiseAND((1 << _POS_BITS) - 1).cast("int")))


def _repeat_words(w: Column, positions: Column) -> Column:
    """Words in windows, among those at ``positions``, that occur at least twice; compares the words themselves."""

    def covered(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
        starts = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    windows = F.transform(positions, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    return let(F.sort_array(windows), covered)


def with_features(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, the base counts, and the learner's features, for every row and whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = df.select(
        F.col(id_col),
        words_of(t).alias("w"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup_lines(t).alias("n_dup_lines"),
        F.size(F.split(t, "\n")).alias("n_lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_bang"),
    )
    carried = [id_col, "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_bang"]
    counted = split.select(
        *carried, "w",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        _maybe_repeated(_window_keys(F.col("w"))).alias("at"),
    )
    carried += ["n_words", "word_chars", "n_distinct"]
    w, at = F.col("w"), F.col("at")
    all_at = F.when(F.size(w) > (1 << _POS_BITS), F.sequence(F.lit(0), F.size(w) - 3)).otherwise(at)
    out = counted.select(*carried, F.when((F.size(at) == 0) & (F.size(w) <= (1 << _POS_BITS)), F.lit(0)).otherwise(_repeat_words(w, all_at)).cast("long").alias("n_repeat_words"))
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return out.select(
        id_col, *BASE,
        F.col("n_words").cast("double").alias("f_words"),
        (F.col("word_chars") / n).alias("f_word_len"),
        (F.col("n_symbols") / chars).alias("f_symbols"),
        (F.col("n_dup_lines") / F.col("n_lines")).alias("f_dup_lines"),
        (F.col("n_repeat_words") / n).alias("f_repeat"),
        (F.col("n_upper") / chars).alias("f_upper"),
        (F.col("n_bang") / chars).alias("f_bang"),
        (F.col("n_distinct") / n).alias("f_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # "<=" or ">"
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c <= self.threshold if self.op == "<=" else c > self.threshold

    def holds(self, row: dict) -> bool:
        return row[self.feature] <= self.threshold if self.op == "<=" else row[self.feature] > self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """Number of the first rule that matches, from 1, or 0: one CASE WHEN in order."""
        out = F.lit(0)
        for i in range(len(self.rules), 0, -1):
            out = F.when(self.rules[i - 1].column(), F.lit(i)).otherwise(out)
        return out

    def rejects(self, row: dict) -> bool:
        return any(all(c.holds(row) for c in r.conditions) for r in self.rules)


def _candidates(rows: list[dict], bins: int) -> list[tuple[Condition, int]]:
    """Quantile thresholds of each feature with the bitset of rows on which they hold."""
    out = []
    for f in FEATURES:
        values = sorted(r[f] for r in rows)
        cuts = sorted({values[min(len(values) - 1, (i * len(values)) // bins)] for i in range(1, bins)} | {values[0]})
        for cut in cuts:
            low = int("".join("1" if r[f] <= cut else "0" for r in reversed(rows)), 2)
            full = (1 << len(rows)) - 1
            out += [(Condition(f, "<=", float(cut)), low), (Condition(f, ">", float(cut)), full & ~low)]
    return [(c, b) for c, b in out if b]


def learn(rows: list[dict], target: str = "bad", bins: int = 64, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.97, min_support: int = 5) -> DecisionList:
    """Sequential covering over labelled rows: dicts of FEATURES and a truth value under ``target``.

    A rule is kept when its smoothed precision reaches ``min_precision`` on all rows and it also holds on the pruning third.
    """
    rows = [r for r in rows if all(r[f] is not None and math.isfinite(r[f]) for f in FEATURES)]
    if not any(r[target] for r in rows) or all(r[target] for r in rows):
        return DecisionList()
    candidates = _candidates(rows, bins)
    full = (1 << len(rows)) - 1
    positive = int("".join("1" if r[target] else "0" for r in reversed(rows)), 2)
    prune = int("".join("1" if i % 3 == 2 else "0" for i in reversed(range(len(rows)))), 2)
    grow, left, rules = full & ~prune, positive, []
    negative = full & ~positive
    while len(rules) < max_rules and (left & grow).bit_count() >= min_support:
        cover, chosen = full, []
        while len(chosen) < max_conditions and (cover & negative & grow):
            p0, n0 = (cover & left & grow).bit_count(), (cover & negative & grow).bit_count()
            best = None
            for c, bits in candidates:
                p, n = (cover & bits & left & grow).bit_count(), (cover & bits & negative & grow).bit_count()
                if p < min_support or n == n0 and p == p0:
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                if best is None or gain > best[0]:
                    best = (gain, c, bits)
            if best is None or best[0] <= 0:
                break
            chosen.append((best[1], best[2]))
            cover &= best[2]
        if not chosen:
            break
        ends = []
        for k in range(1, len(chosen) + 1):  # prune: the prefix that does best on rows the growth never saw
            bits = full
            for _, b in chosen[:k]:
                bits &= b
            p, n = (bits & left & prune).bit_count(), (bits & negative & prune).bit_count()
            ends.append(((p - n) / (p + n) if p + n else -1.0, k, bits))
        worth, k, bits = max(ends, key=lambda e: (e[0], e[1]))
        p, n = (bits & left).bit_count(), (bits & negative).bit_count()
        precision = (p + 1) / (p + n + 2)
        if worth <= 0 or p < min_support or precision < min(min_precision, (p + 1) / (p + 2)):
            break
        rules.append(Rule(tuple(_widened(c, rows, bits & positive) for c, _ in chosen[:k]), precision, p))
        left &= ~bits
    return DecisionList(rules)


def _widened(c: Condition, rows: list[dict], covered: int) -> Condition:
    """The threshold half-way between the rows on either side of it: the widest margin that covers the same rows."""
    inside = [r[c.feature] for i, r in enumerate(rows) if covered >> i & 1]
    outside = [r[c.feature] for r in rows if not c.holds(r)]
    if not inside or not outside:
        return c
    near, far = (max(inside), min(outside)) if c.op == "<=" else (min(inside), max(outside))
    middle = (near + far) / 2
    return Condition(c.feature, c.op, middle) if min(near, far) <= middle < max(near, far) else c


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000, **options) -> DecisionList:
    """Learn from at most ``max_labelled`` labelled rows, chosen by hash; the broadcast of their ids has that bound."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    ids = sample.select(F.col("doc_id").alias("_label_id"), "quality")
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_label_id")).select("doc_id", "text", "quality")
    feats = with_features(chosen.select(F.struct("doc_id", "quality").alias("doc_id"), "text"))
    # The base rule is applied to the collected rows: as a filter, Spark would compute the word arrays for it once more.
    rows = feats.select(F.col("doc_id.doc_id").alias("id"), (F.col("doc_id.quality") == 0).alias("bad"), base_failed().alias("failed"), *FEATURES).collect()
    return learn([r.asDict() for r in sorted(rows, key=lambda r: (r["id"], r["bad"])) if not r["failed"]], **options)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the number of the rule that rejected (0: none)."""
    return with_features(docs).select(
        "doc_id", *BASE, base_failed().alias("base_failed"), rules.verdict().alias("rule")
    ).select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def filter_kept(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows that ``judge`` keeps, all columns as they were."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    judged = with_features(held, text="_text", id_col="_row").withColumn("_kept", ~base_failed() & (rules.verdict() == 0))
    # Not a filter: Spark would push it below the projections and compute every feature again within its condition.
    kept = F.when(F.col("_kept"), F.array("_row")).otherwise(F.array().cast(judged.select(F.array("_row").alias("r")).schema["r"].dataType))
    return judged.select(F.inline(kept))
