"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers,
and a span classifier trained on its posteriors decides on the candidates that no strict pattern guarantees.

All work on rows is built-in column expressions. Candidates come from strict patterns (they always stay), from matches of these that
fail their check (dotted quads, digit runs and numbers that are likely something else), and from looser patterns: local
phone numbers, spelled-out addresses, and long mixed tokens that may be secrets, a fifth kind. Five labelers vote for,
against, or abstain: pattern, checksum and shape, gazetteer (endings, issuers, country codes, usual lengths and
prefixes of keys), context words in four languages, and boundaries. Only the counts of the vote patterns, at most 5 kinds x 2 x 3^5, reach the
driver; there the reliabilities (one confusion table per labeler, one prior per kind) are estimated, and a logistic classifier
over one-hot votes is fitted to the posteriors. It is applied as an arithmetic column expression.

The patterns for searching are linear-time equivalents of the contract's: possessive, and anchored where a run starts.

Defined results: a null or empty text has no spans; positions count code points; repeated rows are judged one by one;
an empty table, or one without candidates, gives a classifier that adds nothing; columns beyond doc_id and text are ignored by ``find`` and
kept by ``redact``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
_USER = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_USER})){_USER}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_/+=.-])(?=[A-Za-z0-9_/+=-]{0,64}?[0-9])(?=[A-Za-z0-9_/+=-]{0,64}?[A-Za-z])[A-Za-z0-9_/+-]{20,512}+={0,2}(?![A-Za-z0-9_/+=-])",
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[({]at[\])}]\x20?[a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[a-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[\x20.-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9-])(?!\.[0-9])",
}
CUES = (
    r"(?i)(?:\b(?:call|phone|tel|mobile|cell|fax|contact|reach|e-?mail|mail|write|card|credit|visa|ip|host|server|address|login|user"
    r"|telefon|anruf|handy|karte|rechner|adresse|tel[eé]fono|llam[ae]|m[oó]vil|tarjeta|correo|servidor|direcci[oó]n|t[eé]l[eé]phone|appel\w*|portable|carte|courriel|serveur|adresse"
    r"|token|secret|passw(?:or)?d|passwort|contrase\u00f1a|auth|bearer|credentials?|api[_-]?key|access[_-]?key|private[_-]?key)\b[^\n]{0,12}$)"
)
ANTI_CUES = (
    r"(?i)(?:\b(?:version|v|section|figure|table|isbn|issn|order|invoice|ref|sku|part|serial|total|page|chapter|commit|sha-?[0-9]*|md5|digest|checksum|hash|etag|uuid|id"
    r"|abschnitt|tabelle|seite|kapitel|rechnung|secci[oó]n|tabla|p[aá]gina|cap[ií]tulo|factura|tableau|chapitre|facture)\b[.:=#\"'\x20]{0,4}$)"
)
SECRET_PREFIXES = r"^(?:AKIA|ASIA|gh[opsu]_|sk-|pk_|xox[abp]-|eyJ|glpat-|AIza)"
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "ca", "mx", "br", "example", "test", "invalid")
VOTES = ("v_pattern", "v_shape", "v_gazetteer", "v_context", "v_boundary")
FOR, AGAINST, ABSTAIN = 1, -1, 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(FOR)).when(no, F.lit(AGAINST)).otherwise(F.lit(ABSTAIN))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def add(a: Column, i: Column) -> Column:
            v = F.substring(d, n - i, F.lit(1)).cast("int")
            return a + F.when(i % 2 == 0, v).when(v < 5, 2 * v).otherwise(2 * v - 9)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0

    return let(digits(m), total)


def octets(m: Column) -> Column:
    part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) == 0) | ((F.length(s) <= 3) & (F.concat(F.lit("0"), F.substring(s, 1, 3)).cast("int") <= 255)))
    return F.forall(F.split(m, r"\."), part)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


_SPAN = "struct<kind:int,start:int,end:int,strict:boolean,v_pattern:int,v_shape:int,v_gazetteer:int,v_context:int,v_boundary:int>"
_FOUND = "array<struct<start:int,end:int,m:string,pre:string,post:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Matches with their places: lengths of the pieces between matches and of the matches add up to positions."""

    def places(ms: Column) -> Column:
        def walk(ps: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["pos"] + F.length(F.get(ps, i))
                end = start + F.length(F.get(ms, i))
                row = F.struct(start.alias("start"), end.alias("end"), F.get(ms, i).alias("m"), F.right(F.get(ps, i), F.lit(40)).alias("pre"), F.left(F.get(ps, i + 1), F.lit(1)).alias("post"))
                return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(row)).alias("out"))

            zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_FOUND).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(ms) - 1), zero, step, lambda acc: acc["out"])

        return F.when(F.size(ms) == 0, F.array().cast(_FOUND)).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _ending(m: Column) -> Column:
    """The last label of an address; of the last 64 characters only, as the search is quadratic in what it reads."""
    return F.regexp_extract(F.right(m, F.lit(64)), r"([A-Za-z0-9-]+)$", 1)


def _shape(kind: str, m: Column) -> Column:
    if kind == "email":
        end = _ending(m)
        return _vote(end.rlike("^[A-Za-z]{2,10}$"), end.rlike("[0-9]") | (F.length(end) > 24))
    if kind == "ip":
        return _vote(~m.rlike(r"(^|\.)0[0-9]"), m.rlike(r"(^|\.)0[0-9]"))
    if kind == "card":
        good = luhn(m) & ~digits(m).rlike(r"^([0-9])\1*$")
        return _vote(good, ~good)
    if kind == "secret":
        mixed = m.rlike("[0-9].*[0-9].*[0-9]") & (m.rlike("^[0-9a-f]+$") | m.rlike("^[0-9A-F]+$") | (m.rlike("[a-z]") & m.rlike("[A-Z]")))
        return _vote(mixed, ~mixed)
    d = digits(m)
    unlikely = d.rlike(r"([0-9])\1{6}") | (F.length(d) < 9) | (~m.startswith("+") & ~d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"))
    return _vote((F.length(d) >= 10) & ~unlikely, unlikely)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(_ending(m)).isin(*ENDINGS), F.lit(False))
    if kind == "ip":
        private = m.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.")
        return _vote(~private, private)
    if kind == "card":
        issued = digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|64|65)")
        return _vote(issued, ~issued)
    if kind == "secret":
        usual = m.rlike(SECRET_PREFIXES) | (m.rlike("^(?i)[0-9a-f]+$") & F.length(m).isin(32, 40, 48, 56, 64, 128))
        return _vote(usual, F.length(m) < 24)
    code = F.regexp_extract(m, r"^\+([0-9]{1,2})", 1)
    area = F.regexp_extract(digits(m), r"^([2-9][0-9]{2})[2-9][0-9]{6}$", 1)
    return F.when(m.startswith("+"), _vote(code.isin(*COUNTRY_CODES) | F.substring(code, 1, 1).isin("1", "7"), F.lit(False))).otherwise(_vote(area != "", area == ""))


def _candidates(text: Column, kind: str, pattern: str, strict: bool, needs: Column) -> Column:
    """Matches with their votes. With ``strict``, those that pass their check are so marked, and the others are candidates."""
    k = KINDS.index(kind)

    def span(x: Column) -> Column:
        pre, post, m = x["pre"], x["post"], x["m"]
        sure = _valid(kind, m) if strict else F.lit(False)
        touching = pre.rlike(r"[A-Za-z0-9_]$") | post.rlike(r"^[A-Za-z0-9_]")
        cues = _vote(pre.rlike(ANTI_CUES), F.lit(False)) * -1
        votes = (
            _vote(sure, ~sure) if strict else F.lit(ABSTAIN), _shape(kind, m), _gazetteer(kind, m),
            F.when(cues != ABSTAIN, cues).otherwise(_vote(pre.rlike(CUES), F.lit(False))), _vote(~touching, touching),
        )
        named = [v.alias(n) for v, n in zip(votes, VOTES)]
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), sure.alias("strict"), *named)

    return F.when(needs, F.transform(_matches(text, pattern), span)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def candidates(text: Column) -> Column:
    """All candidate spans with their votes; loose ones that meet a strict one are left out, and so are loose ones that meet
    one of a kind listed before."""
    t = F.coalesce(text, F.lit(""))
    digit = t.rlike("[0-9]")
    needs = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(t, F.lit("+"))}
    strict = [_candidates(t, k, STRICT[k], True, needs[k]) for k in KINDS[:BASE_KINDS]]
    loose = [
        _candidates(t, "email", LOOSE["email"], False, t.rlike(r"(?i)[\[({]at[\])}]")), _candidates(t, "phone", LOOSE["phone"], False, digit),
        _candidates(t, "secret", LOOSE["secret"], False, digit),
    ]
    meets = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])

    def chosen(found: Column) -> Column:
        sure, rest = F.filter(found, lambda x: x["strict"]), F.filter(found, lambda x: ~x["strict"])
        free = let(sure, lambda s: F.filter(rest, lambda x: ~F.exists(s, lambda y: meets(x, y))))
        first = let(free, lambda f: F.filter(f, lambda x: ~F.exists(f, lambda y: meets(x, y) & ((y["kind"] < x["kind"]) | ((y["kind"] == x["kind"]) & (y["start"] < x["start"]))))))
        return F.when(F.size(rest) == 0, F.array_sort(found)).otherwise(F.array_sort(F.concat(sure, first)))

    return let(F.concat(*strict, *loose), chosen)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the one-hot votes, kinds and a bias; ``reliability`` is what the estimation found."""

    weights: tuple[tuple[str, float], ...] = ()
    reliability: tuple = ()

    def score(self, x: Column) -> Column:
        total = F.lit(0.0)
        for name, w in self.weights:
            field_, _, value = name.partition("=")
            total = total + (F.lit(w) if not value else F.when(x[field_] == int(value), F.lit(w)).otherwise(F.lit(0.0)))
        return total

    def accepts(self, x: Column) -> Column:
        return self.score(x) > 0 if self.weights else F.lit(False)


def estimate(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 100) -> tuple[list[float], tuple]:
    """Expectation-maximisation over (kind, votes, count): posterior of each pattern, and P(vote | truth) by labeler.

    A labeler that abstains says nothing about a span: loose patterns, which vote neither way, aren't taken for bad ones.
    """
    posterior = []
    for _, votes, _ in patterns:  # start: the majority
        s = sum(votes)
        posterior.append(0.9 if s > 0 else 0.1 if s < 0 else 0.5)
    tables: tuple = ()
    for _ in range(rounds):
        prior = {k: [5.0, 5.0] for k in range(len(KINDS))}
        conf = [{(t, v): 3.0 if (t == 1) == (v == FOR) else 0.4 for t in (0, 1) for v in (FOR, AGAINST)} for _ in VOTES]
        for (kind, votes, n), p in zip(patterns, posterior):
            prior[kind][1] += n * p
            prior[kind][0] += n * (1 - p)
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    conf[j][1, v] += n * p
                    conf[j][0, v] += n * (1 - p)
        sums = [{t: c[t, FOR] + c[t, AGAINST] for t in (0, 1)} for c in conf]
        new = []
        for kind, votes, _ in patterns:
            log = [math.log(prior[kind][t]) + sum(math.log(conf[j][t, v] / sums[j][t]) for j, v in enumerate(votes) if v != ABSTAIN) for t in (0, 1)]
            new.append(1 / (1 + math.exp(max(-700, min(700, log[0] - log[1])))))
        moved = max((abs(a - b) for a, b in zip(new, posterior)), default=0.0)
        posterior = new
        tables = tuple(tuple(sorted((f"{'true' if t else 'false'}:{v}", round(c[t, v] / s[t], 6)) for t in (0, 1) for v in (FOR, AGAINST))) for c, s in zip(conf, sums))
        if moved < 1e-9:
            break
    return posterior, tables


def train(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> SpanModel:
    """A logistic classifier on one-hot votes and kinds, fitted to the posteriors."""
    if not patterns:
        return SpanModel()
    posterior, tables = estimate(patterns)
    rows = []
    for (kind, votes, n), p in zip(patterns, posterior):
        names = ["bias", f"kind={kind}", *(f"{VOTES[j]}={v}" for j, v in enumerate(votes) if j and v != ABSTAIN)]  # the pattern's own vote would decide alone
        rows.append((names, math.log1p(n), p))
    whole = sum(n for _, n, _ in rows)
    w: dict[str, float] = dict.fromkeys(sorted({x for names, _, _ in rows for x in names}), 0.0)
    for _ in range(rounds):
        grad = {k: decay * v for k, v in w.items()}
        for names, n, p in rows:
            s = sum(w[x] for x in names)
            g = (1 / (1 + math.exp(-max(-60.0, min(60.0, s)))) - p) * n / whole
            for x in names:
                grad[x] += g
        for k in w:
            w[k] -= rate * grad[k]
    return SpanModel(tuple((k, round(v, 9)) for k, v in w.items()), tables)


def fit(spans: DataFrame, column: str = "cand") -> SpanModel:
    """Train on the vote patterns of all candidates in the corpus; their counts are a table of bounded size."""
    counts = spans.select(F.inline(column)).groupBy("kind", *VOTES).count().collect()
    return train([(r["kind"], tuple(r[v] for v in VOTES), float(r["count"])) for r in sorted(counts, key=lambda r: tuple(r)[:6])])


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(cands: DataFrame, model: SpanModel, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans that stay."""
    base = F.filter("cand", lambda x: x["strict"])
    count = lambda k: F.size(F.filter("cand", lambda x: x["strict"] & (x["kind"] == k))).cast("long")
    kept = F.filter("cand", lambda x: x["strict"] | model.accepts(x))
    return cands.select(id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE_KINDS])], F.sha2(_written(base), 256).alias("base_sha256"), _written(kept).alias("spans"))


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """The rows with every span that stays replaced by its kind in angle brackets; other columns unchanged."""

    def rebuilt(t: Column, spans: Column) -> Column:
        names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

        def step(acc: Column, x: Column) -> Column:
            start = F.greatest(x["start"], acc["pos"])  # spans of two kinds may overlap
            part = F.when(x["end"] <= acc["pos"], F.lit("")).otherwise(F.concat(F.substring(t, acc["pos"] + 1, start - acc["pos"]), F.when(x["start"] >= acc["pos"], F.get(names, x["kind"])).otherwise(F.lit(""))))
            return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.concat(acc["out"], F.array(part)).alias("out"))

        zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["pos"] + 1, F.length(t))))

    kept = let(candidates(F.col(text)), lambda c: F.filter(c, lambda x: x["strict"] | model.accepts(x)))
    out = let(kept, lambda s: F.when(F.size(s) == 0, F.col(text)).otherwise(rebuilt(F.col(text), s)))
    return docs.withColumn(text, out)


def find(docs: DataFrame) -> DataFrame:
    """Candidates of the whole corpus, the model trained on their votes, and one row of spans per document."""
    from ..runtime import staged

    cands = staged(docs.select("doc_id", candidates(F.col("text")).alias("cand")), "candidates")
    return digest(cands, fit(cands))
