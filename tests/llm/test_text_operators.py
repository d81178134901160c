"""Operators on texts against brute force, on small hostile tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, regs string, key string, sim string, group string, w string, at string, cand string, _id string"
EXTRA = ["x"] * 8
WORDS = [a + b for a in ("th", "er", "on", "an", "re", "ti", "es", "or", "wh", "ou") for b in ("a", "ing", "ed", "ly", "s", "ion", "er", "x", "ne", "t")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(7)
    out = {}
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(25)]
    for i, t in enumerate(base):
        out[i] = t
    passage = prose(rng, 60)
    for i in range(25, 40):  # near copies, and a passage that many share
        words = base[i % 5].split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out[i] = " ".join(words) + ("\n" + passage if i % 3 == 0 else "") + "\nAll rights reserved."
    out[40], out[41], out[42] = None, "", " \t\n "
    out[43] = out[44] = base[0]
    out[45] = "é日本 ß" * 40 + base[1]
    out[46] = "ab" * 3000
    out[47] = "one two three"
    out[48] = "One  TWO\nthree"
    out[49] = prose(rng, 20_000)
    out[50] = "x " * 2000 + "#$% end"
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, *EXTRA[:8], None) for i, t in TEXTS.items()]
    return spark.createDataFrame([r[:14] for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op1_spans(spark, docs, empty):
    from vecloom.llm import pii

    rng = random.Random(5)
    some = [None, "", "call me (212) 555-7890 now or bob [at] x [dot] com", "é😀 a@b.c_d@e.f x..@a.b 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (375) 555-4393 +12 3", "a" * 50_000 + "@x.y"]
    parts = ["1", "4", "2", "0", ".", "-", " ", "+", "@", "a", "Z", "(", ")", "é", "4111111111111111", "\n", "255.", "a.b"]
    some += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(some)) + [(3, some[3])], "doc_id long, text string")

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0

    def brute(t):
        t = t or ""
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 10_000 else [("email", 0, len(t))]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= sum(c.isdigit() for c in m[0]) <= 19 and luhn(m[0])]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]

    rows = pii.find(df).collect()
    assert len(rows) == len(some) + 1
    for r in rows:
        want = brute(some[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(w[0] == k for w in want) for k in pii.KINDS[:4]]
        written = ["%s:%d:%d" % w for w in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(filter(None, written)) <= set(r["spans"].split(","))
    loose = next(r for r in rows if r["doc_id"] == 2)["spans"]
    assert loose == "email:30:50,phone:8:22"
    assert pii.find(empty).count() == 0
    model = pii.fit(df.select("doc_id", pii.candidates(df.text).alias("cand")))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "call me <PHONE> now or <EMAIL>"


def test_op1_classifier_accepts_and_rejects(spark):
    """Trained without labels on texts whose truth is known: held-out candidates beyond the strict ones."""
    from vecloom.llm import pii

    rng = random.Random(14)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 3)) + "1a2"
    run = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def luhn(s):
        d = [int(c) for c in s][::-1]
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0

    def number():
        while luhn(n := rng.choice("0189") + run(15)):
            pass
        return n

    def made():
        local = f"{rng.randrange(2, 10)}{run(2)}-{rng.randrange(2, 10)}{run(2)}-{run(4)}"
        return rng.choice([
            (True, "secret", "token = \"", hexa(40), "\" "), (True, "secret", "api_key: ", "sk-" + hexa(20).upper() + hexa(15), " "), (False, "secret", "commit ", hexa(14) + "-long_name_" + run(4), " "),
            (False, "secret", "etag: ", "release-notes-of-the-version-" + run(2), " "), (True, "phone", "please call ", local, " "), (False, "phone", "order ", f"{rng.choice('01')}{run(2)}-{rng.choice('01')}{run(2)}-{run(4)}", " "),
            (False, "card", "serial ", number(), " "), (False, "ip", "version ", f"{rng.randrange(300, 999)}.0.{run(2)}.{run(2)}", " "), (True, "email", "write to ", f"{prose(rng, 1)} [at] {prose(rng, 1)} [dot] com", " "),
        ])

    rows, truth = [], {}
    for i in range(600):
        ok, kind, before, m, after = made()
        pre = prose(rng, 6) + " " + before
        rows.append((i, pre + m + after + prose(rng, 4) + " +49 (301) 555-0199 a@b.example.com 10.1.2.3 " + "4111 1111 1111 1111"))
        truth[i] = (ok, f"{kind}:{len(pre)}:{len(pre) + len(m)}")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cands = df.select("doc_id", pii.candidates(df.text).alias("cand"))
    model = pii.fit(cands.where("doc_id < 300"))
    told = {r["doc_id"]: r["spans"].split(",") for r in pii.digest(cands.where("doc_id >= 300"), model).collect()}
    right = [(truth[i][1] in spans) == truth[i][0] for i, spans in told.items()]
    wrong = collections.Counter((truth[i][1].split(":")[0], truth[i][0]) for i, spans in told.items() if (truth[i][1] in spans) != truth[i][0])
    assert sum(right) >= 0.95 * len(right), (wrong, model.weights)
    assert all(len(s) >= 3 for s in told.values())
    assert any(truth[i][0] for i in told) and any(not truth[i][0] for i in told)


def test_op1_estimation_learns_which_labeler_lies():
    from vecloom.llm import pii

    rng = random.Random(1)
    counts = collections.Counter()
    for _ in range(4000):
        truth = rng.random() < 0.5
        say = lambda p: 1 if (rng.random() < p) == truth else -1  # noqa: B023, E731
        counts[3, (say(0.9), say(0.9), say(0.85), 0, say(0.5))] += 1
    _, tables = pii.estimate([(k, v, float(n)) for (k, v), n in sorted(counts.items())])
    assert dict(tables[0])["true:1"] > 0.85 and abs(dict(tables[4])["true:1"] - 0.5) < 0.1


def test_op2_passages(spark, docs, empty):
    from vecloom.llm import pfp

    first = {}
    for i in sorted(TEXTS):
        b = (TEXTS[i] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    again = docs.union(docs.where("doc_id in (3, 49)"))
    rows = pfp.digest(again).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        i = r["doc_id"]
        b = (TEXTS[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    assert pfp.digest(empty).count() == 0
    out = {r["doc_id"]: r for r in pfp.remove(docs).collect()}
    assert out[43]["text"] == "" and out[40]["text"] is None and out[0]["text"] == TEXTS[0] and out[43]["regs"] == "x"


def test_op2_compares_only_what_can_share_a_window():
    """Phrases of two documents with a common trigger are compared if they share a window, whatever repeats in them, and hardly else."""
    from vecloom.llm import pfp

    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40)]
    texts = []
    for k in range(300):  # two words in a row are often in other texts, four hardly ever
        texts.append(" ".join(rng.choice(words) for _ in range(40)))
        if k % 10 == 9:
            at = rng.randrange(200)
            texts[-1] = texts[-1][:at] + texts[k - 5][at : at + rng.choice([49, 50, 51, 70, 120])] + texts[-1][at + 100 :]
        if k % 25 == 24:
            texts[-1] = texts[-1][:60] + rng.choice(["ab", "abc", "z"]) * 60 + texts[-1][60:]
    raw = [t.encode() for t in texts]
    first = {}
    for d, t in enumerate(raw):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], d)
    want = {(d, p) for d, t in enumerate(raw) for p in range(len(t) - 49) if first[t[p : p + 50]] < d}
    ends = np.cumsum([len(t) for t in raw])
    trigger, content, doc, start, windows, before, after = pfp.parse(np.frombuffer(b"".join(raw), np.uint8), ends - [len(t) for t in raw], ends)
    order, new, new_t, covered = pfp._collapse(trigger, content, doc)
    group = np.cumsum(new_t) - 1
    doc, start, windows, before, after = (c[order] for c in (doc, start, windows, before, after))
    found = {(int(d), int(s) + k) for d, s, w in zip(doc[covered], start[covered], windows[covered]) for k in range(w)}
    at = np.flatnonzero(~covered)
    may = at[pfp._may_share(group[at], doc[at], before[at], after[at])]
    held = {}
    for g, d, s, w in zip(*(c[may].tolist() for c in (group, doc, start, windows))):
        for k in range(w):
            held.setdefault((g, raw[d][s + k : s + k + 50]), []).append((d, s + k))
    found |= {x for same in held.values() for x in same if x[0] > min(same)[0]}
    assert want and found == want
    several = np.bincount(group[new]) > 1
    low, high = (np.array([f(doc[group == g]) for g in range(group.max() + 1)]) for f in (np.min, np.max))
    assert len(may) < 0.7 * (~covered & (several & (low != high))[group]).sum()


def test_op2_repeated_ids_and_null_ids(spark):
    from vecloom.llm import pfp

    t = prose(random.Random(1), 40)
    df = spark.createDataFrame([(1, "abc " + t), (1, "xyz " + t), (None, t), (2, t + "!"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in pfp.digest(df).collect())
    n = len(t)
    assert got == [(0, n, 0), (1, n + 4, 0), (1, n + 4, 0), (2, 0, 0), (2, n + 1, n)]


@pytest.mark.parametrize("percent", [85, 50])
def test_op3_near_duplicates(docs, empty, percent):
    from vecloom.llm import setsketch

    sets = {}
    for i, t in TEXTS.items():
        w = words_of(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = union_find(sets, links)
    rows = setsketch.classes(docs, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    if percent == 85:
        assert setsketch.classes(empty, percent).count() == 0
        kept = setsketch.keep_one(docs, percent)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if comp[i] == i}


def test_op3_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements collide under any polynomial modulo 2^64."""
    from vecloom.llm import setsketch

    word = lambda flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(2048))
    df = spark.createDataFrame([(1, word(0)), (2, word(1)), (3, word(0)), (4, word(0)[:-1]), (5, "x" * 4000 + "y"), (6, "x" * 4000 + "z")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in setsketch.classes(df, 85).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}


def test_op3_clashing_columns(spark):
    from vecloom.llm import setsketch

    t = prose(random.Random(2), 30)
    df = spark.createDataFrame([(1, t, 5, 6), (2, t, 7, 8), (None, t, 9, 9)], "doc_id long, text string, _gone int, _GONE0 int")
    kept = setsketch.keep_one(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["_gone"]) for r in kept.collect()) == [(0, 9), (1, 5)]


def test_op3_registers_merge_and_estimate():
    from vecloom.llm import setsketch
    from vecloom.llm.shingles import mix

    ids = np.unique(mix(np.arange(3000, dtype=np.uint64)))
    a, b = ids[:2000], ids[500:2500]
    ra, rb, rab = setsketch.registers([a, b, np.union1d(a, b)])
    assert (setsketch.merge(ra, rb) == rab).all()
    est = setsketch.similarity(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 0.6) < 0.15


def test_op3_blocks_of_hot_buckets(docs, monkeypatch):
    from vecloom.llm import setsketch

    want = sorted(map(tuple, setsketch.classes(docs, 50).collect()))
    monkeypatch.setattr(setsketch, "BUCKET_ROWS", 2)
    assert sorted(map(tuple, setsketch.classes(docs, 50).collect())) == want


def test_op4_packing(docs, empty, spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import zlib

    from vecloom.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    library = packing.load(path).library
    odd = ["\x1c\x1d a\x85b\xa0 c", "日本語 123½²", "I'll we're Don'T", "ΣΑΣ İ <|endoftext|> x", "a" * 3000, "Ünlü--x.y,z|| a|b 12a3."]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    df = df.union(df.where("doc_id = 3"))
    rows = packing.pack(df, path, with_ids=True).collect()
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in [*TEXTS.items(), *((100 + i, t) for i, t in enumerate(odd))]}
    by_doc, by_sequence = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 4096 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"]][r["piece"]] = (r["start"], r["ids"])
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        joined = []
        for piece in sorted(by_doc[i]):
            assert by_doc[i][piece][0] == len(joined)
            joined += by_doc[i][piece][1]
        assert joined == ids and all(len(x[1]) == 4096 for p, x in by_doc[i].items() if p < len(by_doc[i]) - 1)
    total = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(by_sequence) <= total / 4096 + 2
    assert packing.pack(empty, path).count() == 0


def test_op4_plan_on_many_lengths():
    from vecloom.llm import packing

    rng = random.Random(2)
    histogram = collections.Counter(rng.choice([rng.randrange(1, 4097), rng.randrange(1, 900)]) for _ in range(30_000))
    bins = packing.plan(dict(histogram), 4096)
    used = collections.Counter()
    for lengths, copies in bins:
        assert copies > 0 and sum(n * a for n, a in lengths.items()) <= 4096
        for n, a in lengths.items():
            used[n] += a * copies
    assert used == histogram
    assert sum(c for _, c in bins) <= 1.01 * sum(n * c for n, c in histogram.items()) / 4096 + 1


def test_op4_program_against_all_configurations():
    """The bound holds against every configuration, the solution covers all demands near it, and the bins come from it."""
    from vecloom.llm import packing

    rng = random.Random(8)
    for capacity, kinds in ((60, 4), (100, 5)):
        histogram = {n: rng.randrange(20, 200) for n in rng.sample(range(capacity // 6, capacity - 5), kinds)} | {2: 300}
        bounds, sizes, demand, sand = packing.classes_of(histogram, capacity, 48)
        solution, bound = packing.configuration_program(sizes, demand, sand, capacity)
        assert [a for a, b in bounds] == sizes.tolist() == [b for a, b in bounds] and sand == 600
        assert all((c * sizes).sum() <= capacity for c, _ in solution)
        for k in range(kinds):
            assert sum(c[k] * x for c, x in solution) >= demand[k] - 1e-6
        assert sum((capacity - (c * sizes).sum()) * x for c, x in solution) >= sand - 1e-6
        assert bound <= sum(x for _, x in solution) <= 1.05 * bound + 1e-9

        def configurations(k, room):
            if k == kinds:
                yield ()
                return
            for a in range(room // int(sizes[k]) + 1):
                for rest in configurations(k + 1, room - a * int(sizes[k])):
                    yield (a, *rest)

        # A program of all configurations has no solution below the bound: ours is one, and any integral packing is above it.
        every = list(configurations(0, capacity))
        worth = np.array([rng.random() for _ in range(kinds)])
        told, counts, left = packing._knapsack(worth, sizes, 0.01, capacity)
        best = max(sum(a * w for a, w in zip(c, worth)) + 0.01 * (capacity - sum(a * int(n) for a, n in zip(c, sizes))) for c in every)
        assert abs(told - best) < 1e-9 and abs((counts * worth).sum() + 0.01 * left - told) < 1e-9
        bins = packing.planned(histogram, capacity)
        total = sum(c for _, c, _ in bins)
        assert total >= bound - 1e-6 and sum(c for _, c, own in bins if own) >= 0.5 * total


def test_op4_unknown_settings_go_through_the_library(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import json

    from vecloom.llm import packing

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        told = json.load(file)
    told["normalizer"] = {"type": "NFC"}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    ours = packing.WordTokenizer(str(path))
    text = "Some Cased TEXT, é's 12"
    assert not ours.known and ours.encode_all([text])[0] == np.array(ours.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_op4_cache_generations(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from vecloom.llm import packing

    monkeypatch.setattr(packing, "MAX_PARTS", 40)
    ours = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    for _ in range(20):
        some = [prose(rng, 30) for _ in range(3)]
        want = [np.array(ours.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert ours.encode_all(some) == want and len(ours.new) + len(ours.old) < 400


def test_op4_hot_lengths_are_ranked_in_parts(docs, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from vecloom.llm import packing

    monkeypatch.setattr(packing, "HOT_LENGTH", 2)
    rows = packing.pack(docs.union(docs), public_tokenizers.path("word_bpe_49k.json")).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows)


def test_op6_rules(spark, docs, empty):
    from vecloom.llm import quality_rules as q

    def brute(t):
        t = t or ""
        w = words_of(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    labels = spark.createDataFrame([(i, int(i != 50), 0) for i in TEXTS] + [(None, 1, 0), (3, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    rules = q.fit(docs, labels)
    rows = q.judge(docs, rules).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute(TEXTS[r["doc_id"]])
        assert tuple(r[c] for c in q.BASE) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    kept = q.filter_kept(docs, rules)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}
    assert q.fit(docs, labels.limit(0)).rules == [] and q.judge(empty, rules).count() == 0


def test_op6_learning():
    from vecloom.llm import quality_rules as q

    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        r = {f: rng.random() for f in q.FEATURES}
        r["bad"] = r["f_symbols"] > 0.7 and r["f_upper"] > 0.5 or r["f_bang"] > 0.95
        rows.append(r)
    rules = q.learn(rows)
    held = [{f: rng.random() for f in q.FEATURES} for _ in range(1500)]
    truth = [r["f_symbols"] > 0.7 and r["f_upper"] > 0.5 or r["f_bang"] > 0.95 for r in held]
    told = [rules.rejects(r) for r in held]
    assert sum(a == b for a, b in zip(truth, told)) / 1500 > 0.96
    assert sum(a and not b for a, b in zip(told, truth)) < 15


def test_op7_lines(docs, empty):
    from vecloom.llm import lines as L

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    places = collections.defaultdict(list)
    for i in sorted(TEXTS):
        for j, line in enumerate((TEXTS[i] or "").split("\n")):
            if L.normalise(line):
                places[L.normalise(line)].append((i, j))
    norms = list(places)
    links = []
    for a in range(len(norms)):
        for b in range(a + 1, len(norms)):
            x, y = len(norms[a]), len(norms[b])
            if min(x, y) >= 0.9 * max(x, y) and distance(norms[a], norms[b]) <= int(max(x, y) * (1 - 0.9) + 1e-9):
                links.append((a, b))
    comp = union_find(range(len(norms)), links)
    head = {}
    for k, n in enumerate(norms):
        head[comp[k]] = min(head.get(comp[k], (10**9, 0)), min(places[n]))
    where = {n: head[comp[k]] for k, n in enumerate(norms)}
    assert links
    out = {r["doc_id"]: r for r in L.dedup(docs).collect()}
    for i, t in TEXTS.items():
        found = [] if t is None else t.split("\n")
        kept = [x for j, x in enumerate(found) if not L.normalise(x) or where[L.normalise(x)] == (i, j)]
        assert (out[i]["text"], out[i]["n_lines"], out[i]["n_removed"]) == (None if t is None else "\n".join(kept), len(found), len(found) - len(kept)), i
    assert out[0]["sim"] == "x" and L.dedup(empty).count() == 0


def test_op7_whole_edit_similarity(spark):
    """Against brute force on edit similarity alone: words and characters changed, short and long lines, near the limit."""
    from vecloom.llm import lines as L

    rng = random.Random(11)
    made = []
    for n in [2, 2, 3, 3, 4, 5, 6, 8, 10, 10, 12, 15, 15, 18, 20, 25, 30, 40, 60, 90]:
        base = prose(rng, n)
        made.append(base)
        for share in (0.03, 0.06, 0.09, 0.1, 0.11, 0.13):
            chars = list(base)
            for _ in range(max(1, round(share * len(base)))):
                at = rng.randrange(len(chars))
                kind = rng.randrange(3)
                chars[at : at + 1] = [] if kind == 0 else [rng.choice("qzjk")] if kind == 1 else [chars[at], rng.choice("qzjé")]
            made.append("".join(chars))
        words = base.split()
        words[rng.randrange(n)] = rng.choice(WORDS)
        made.append(" ".join(words))
    norms = sorted({L.normalise(x) for x in made} - {""})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    links = []
    for a in range(len(norms)):
        for b in range(a):
            most = int(max(len(norms[a]), len(norms[b])) * (1 - 0.9) + 1e-9)
            if abs(len(norms[a]) - len(norms[b])) <= most and distance(norms[a], norms[b]) <= most:
                links.append((a, b))
    comp = union_find(range(len(norms)), links)
    first = {}
    for k in range(len(norms)):
        first.setdefault(comp[k], k)
    df = spark.createDataFrame(list(enumerate(norms)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in L.dedup(df).collect() if r["n_removed"] == 0} == set(first.values())


def test_op7_corpus_candidates(spark):
    """Word pairs: whole words changed in any tenth of the words are always found; letters changed all over, to at least 0.9 in each length class."""
    from pyspark.sql import functions as F

    from vecloom.llm import lines as L

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(2, 9)))
    rows = []
    for low, high in ((20, 60), (60, 100), (100, 200), (200, 400), (400, 1000)):
        for k in range(60):
            size = rng.randrange(low, high)
            words = []
            while len(" ".join(words)) < size:
                words.append(word())
            base = L.normalise(" ".join(words))
            if k % 3 == 0:
                for _ in range(max(1, len(words) // 10)):
                    words[rng.randrange(len(words))] = word()
                rows.append(("words", low, base, L.normalise(" ".join(words))))
            else:
                chars = list(base)
                for _ in range(max(1, int(len(base) * rng.choice([0.03, 0.06, 0.09, 0.1])))):
                    at = rng.randrange(len(chars))
                    chars[at : at + 1] = rng.choice([[], [rng.choice("aeiouxyz ")], [chars[at], rng.choice("aeioxyz")]])
                rows.append(("letters", low, base, L.normalise("".join(chars))))
    told = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, how string, low int, x string, y string")
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * 0.1 + 1e-9).cast("int")
    true = told.withColumn("most", most).where(F.expr("levenshtein(x, y, most) >= 0")).select("i", "how", "low").collect()
    docs = told.select((F.col("i") * 2).alias("doc_id"), F.col("x").alias("text")).union(told.select(F.col("i") * 2 + 1, "y")).repartition(3)
    gone = {r["doc_id"] for r in L.dedup(docs, exact=False).collect() if r["n_removed"]}
    assert len(true) > 200
    share = collections.defaultdict(list)
    for r in true:
        share[r["how"], r["low"]].append(2 * r["i"] + 1 in gone)
    told = {k: (sum(v), len(v)) for k, v in sorted(share.items())}
    for (how, _), found in share.items():
        assert all(found) if how == "words" else sum(found) >= 0.9 * len(found), told
    assert not [i for i in gone if i // 2 not in {r["i"] for r in true}]


def test_op7_query_finds_letters_changed_all_over(spark):
    """The query and the pipeline's stage lose no pair: an edit in every tenth character, so that hardly a word pair is left."""
    import corpus_pipeline

    from vecloom.llm import lines as L

    rng = random.Random(21)
    rows = []
    for k in range(120):
        n = rng.randrange(40, 500)
        base = L.normalise("".join(rng.choice("abcdefgh klmnoprstuvw") for _ in range(n)))
        chars = list(base)
        for at in reversed(range(5, int(len(base) * 0.1) * 10, 10)):
            chars[at : at + 1] = [[], ["x"], [chars[at], "y"]][rng.randrange(3)] if chars[at] != " " else ["z"]
        if abs(len(chars) - len(base)) <= 3:
            rows.append((base, L.normalise("".join(chars))))
    most = [int(max(len(x), len(y)) * 0.1 + 1e-9) for x, y in rows]
    told = spark.createDataFrame([(2 * i, x, y, d) for i, ((x, y), d) in enumerate(zip(rows, most))], "i long, x string, y string, most int")
    true = {r["i"] + 1 for r in told.where("levenshtein(x, y, most) >= 0").select("i").collect()}
    assert len(true) > 50
    docs = told.selectExpr("i as doc_id", "x as text").union(told.selectExpr("i + 1", "y")).repartition(3)
    assert {r["doc_id"] for r in L.digest(docs).collect() if r["n_removed"]} == true
    left = corpus_pipeline.drop_lines(spark, docs.selectExpr("doc_id", "text", "'en' as lang", "'x' as source", "length(text) as n_chars"), "")
    assert {r["doc_id"] for r in left.collect()} == set(range(2 * len(rows))) - true


def test_op7_distances_and_blocks(spark, monkeypatch):
    """Batched distances against the plain one, and the same groups whatever the size of blocks, slices and steps."""
    from vecloom.llm import lines as L

    rng = random.Random(22)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = []
    for _ in range(400):
        x = "".join(rng.choice(rng.choice(["ab", "abcdefgé 日"])) for _ in range(rng.randrange(1, 70)))
        y = list(x)
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(x))
            y[at : at + 1] = rng.choice([[], ["b"], ["a", "q"]])
        pairs.append((x, "".join(y) or "a"))
    want = [distance(x, y) <= int(max(len(x), len(y)) * 0.1 + 1e-9) for x, y in pairs]
    assert 30 < sum(want) < 370
    assert L.similar(*map(list, zip(*pairs))).tolist() == want
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, L.dedup(docs).collect()))
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)  # of the plan; workers keep their own
    monkeypatch.setattr(L, "TOGETHER", 2)
    assert sorted(map(tuple, L.dedup(docs).collect())) == whole
    monkeypatch.setattr(L, "CELLS", 50)
    assert L.similar(*map(list, zip(*pairs))).tolist() == want
    lines = sorted({L.normalise(t) for p in pairs for t in p if len(L.normalise(t)) >= 9})
    ids = np.arange(len(lines))
    found = {(i, j) for at in L.candidates(lines, ids, lines, ids) for i, j in zip(*(c.tolist() for c in at))}
    monkeypatch.setattr(L, "CHUNK_CHARS", 40)
    monkeypatch.setattr(L, "STEP", 5)
    assert {(i, j) for at in L.candidates(lines, ids, list(lines), ids) for i, j in zip(*(c.tolist() for c in at))} == found
    for i, x in enumerate(lines):
        for j, y in enumerate(lines):
            if abs(len(x) - len(y)) <= 7 and (len(x), i) > (len(y), j) and distance(x, y) <= int(len(x) * 0.1 + 1e-9):
                assert (i, j) in found, (x, y)


def test_op7_few_candidates_in_prose():
    """Lines that have phrases in common but nothing else are no candidates; similar ones are, at the limit too, and joined ones aren't sought again."""
    from vecloom.llm import lines as L

    rng = random.Random(25)
    phrases = [" ".join("".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(4, 9))) for _ in range(3)) for _ in range(60)]
    made = [" ".join(rng.choice(phrases) for _ in range(15)) for _ in range(600)]
    near = []
    for k in range(60):
        chars = list(made[k])
        for at in range(5, len(chars) // 10 * 10, 10):
            chars[at] = "y"
        near.append("".join(chars))
    lines = made + near
    ids = np.arange(len(lines))
    alike = [(i, j) if (len(lines[i]), i) > (len(lines[j]), j) else (j, i) for j, i in enumerate(range(600, 660))]
    assert L.similar([lines[i] for i, _ in alike], [lines[j] for _, j in alike]).all()
    found = {(i, j) for at in L.candidates(lines, ids, lines, ids) for i, j in zip(*(c.tolist() for c in at))}
    assert set(alike) <= found and len(found) < 1000
    assert not list(L.Segments(lines, ids).near(lines, ids, 0, lambda i, j: np.ones(len(i), bool)))


def test_op7_few_long_lines_whole(monkeypatch):
    """Few long lines are held each against each: all similar pairs are among the candidates, as with marks, and few others."""
    from vecloom.llm import lines as L

    rng = random.Random(27)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(2, 9)))
    lines = []
    for _ in range(30):
        base = " ".join(word() for _ in range(rng.randrange(250, 400)))
        lines.append(base)
        for share in (0.05, 0.09, 0.1, 0.2):
            chars = list(base)
            for at in sorted(rng.sample(range(len(base)), int(share * len(base))), reverse=True):
                chars[at : at + 1] = rng.choice([[], ["x"], [chars[at], "y"]])
            lines.append("".join(chars))
    ids = np.arange(len(lines))
    x, y = (c.tolist() for c in np.nonzero(np.ones((len(lines), len(lines)))))
    some = [(i, j) for i, j in zip(x, y) if (len(lines[i]), i) > (len(lines[j]), j) and i // 5 == j // 5]
    alike = {p for p, same in zip(some, L.similar([lines[i] for i, _ in some], [lines[j] for _, j in some])) if same}
    assert min(map(len, lines)) > L.LONG and len(alike) > 40
    for share in (L.WHOLE, 0):
        monkeypatch.setattr(L, "WHOLE", share)
        found = {(i, j) for at in L.candidates(lines, ids, list(lines), ids) for i, j in zip(*(c.tolist() for c in at))}
        assert alike <= found and len(found) <= len(some)


def test_op7_lines_of_a_text():
    """Texts are normalised at once, as line by line: sigma, ligatures, digits, marks and separators of several scripts."""
    from vecloom.llm import lines as L

    rng = random.Random(26)
    some = list("aB cΣσİß9٣²½_-,.\t\r\x0b\x1c\x85\u2028\xa0  \n«»é日\u0301\x00\x7f①Ⅷ0") + [chr(rng.randrange(160, 0xD800)) for _ in range(60)]
    for n in (30, 400):
        for _ in range(2000):
            text = "".join(rng.choice(some) for _ in range(rng.randrange(n)))
            assert L.normal_lines(text) == [L.normalise(line) for line in text.split("\n")], repr(text)


def test_op7_lines_are_looked_up_few_times():
    """Of 690 million characters each is looked up 2.5 times at most on average, and every two blocks that lengths allow meet once."""
    from vecloom.llm import lines as L

    lens = np.random.default_rng(23).lognormal(5.5, 0.9, 60_000).astype(np.int64).clip(10, 20_000)
    chars = np.bincount(L._classes(lens), weights=lens * (690e6 / lens.sum())).astype(np.int64)
    blocks = L._blocks({c: int(n) for c, n in enumerate(chars) if n})
    tasks = L._tasks(blocks)
    assert sum(blocks[o][2] for _, others in tasks for o in others) <= 2.5 * sum(n for _, _, n in blocks)
    met = [(k, o) for group, others in tasks for k in group for o in others]
    assert len(met) == len(set(met))
    assert {(k, o) for k, (low, high, _) in enumerate(blocks) for o, (least, most, _) in enumerate(blocks) if least <= high and most >= low - L.FINE} <= set(met)


def test_op7_blocks_of_many_parts_stay_compressed():
    """Where a length class has many blocks, its lines still lie together there, each line once, and compressed."""
    from vecloom.llm import lines as L

    rng = random.Random(24)
    words = [w + v for w in WORDS for v in ("", "s", "ing")]
    norms = sorted({" ".join(rng.choice(words) for _ in range(30))[:120] for _ in range(6000)})
    keys = [i.to_bytes(8, "little") * 2 for i in range(len(norms))]
    same = np.full(len(norms) // 60, 7, np.int32)
    rows = [L._packed(keys[i : i + len(same)], norms[i : i + len(same)], same[: len(norms[i : i + len(same)])]) for i in range(0, len(norms), len(same))]
    out = [r for batch in L.split_batches(iter(rows), [(7, 7, 1)] * 30) for r in batch.to_pylist()]
    assert sorted(r["part"] for r in out) == list(range(30))
    found = {}
    for r in out:
        found.update(zip(*L._unpacked(r["size"], r["keys"], r["norms"])))
    assert found == dict(zip(keys, norms)) and sum(len(r["keys"]) for r in out) == 16 * len(keys)
    assert sum(len(r["norms"]) for r in out) < 0.5 * sum(map(len, norms))


def test_workers_give_tables_of_other_modules_back():
    """A worker that goes on to another operator doesn't keep what it had loaded for the one before."""
    from vecloom import runtime
    from vecloom.llm import packing

    packing._LOADED["none"] = None
    list(runtime.called("vecloom.llm.packing", "place_batches", (iter(()), []), {}))
    assert packing._LOADED
    list(runtime.called("vecloom.llm.lines", "line_batches", (iter(()),), {}))
    assert not packing._LOADED


def test_op7_buckets_over_batches():
    import pyarrow as pa

    from vecloom.llm import lines as L

    rng = random.Random(9)
    for _ in range(60):
        rows = sorted((rng.randrange(5), rng.randrange(20)) for _ in range(rng.randrange(1, 70)))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(5))})
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], pa.int64()) for i in (0, 1)] + [pa.array([r[1] + 100 for r in rows[a:b]], pa.int32())], ["key", "nid", "len"]) for a, b in zip(cuts, cuts[1:])]
        got = [tuple(r.values()) for x in L.bucket_batches(iter(batches)) for r in x.to_pylist()]
        by = collections.defaultdict(set)
        for k, n in rows:
            by[k].add(n)
        want = [(k, n, n + 100, min(by[k]), min(by[k]) + 100) for k in by for n in by[k] if len(by[k]) > L.SMALL]
        want += [(None, y, y + 100, x, x + 100) for v in by.values() if len(v) <= L.SMALL for x in v for y in v if x < y and x + 100 >= 0.9 * (y + 100) - 1e-6]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_op7_hot_buckets_in_blocks(spark, monkeypatch):
    from vecloom.llm import graph
    from vecloom.llm import lines as L

    rng = random.Random(6)
    base = [prose(rng, 12) for _ in range(6)]
    docs = spark.createDataFrame([(i, base[i % 6] + " " + base[(i + 1) % 6] + f" {prose(rng, 1)} {prose(rng, 1)}") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, L.dedup(docs, exact=False).collect()))
    monkeypatch.setattr(graph, "BUCKET_ROWS", 7)
    assert sorted(map(tuple, L.dedup(docs, exact=False).collect())) == want == sorted(map(tuple, L.dedup(docs).collect()))


def test_op9_encoding(docs, empty, spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    from vecloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.load(path, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["", None, "a" * 3000, "  \n\t  x", "\x1c\x1d a\x85b\xa0 c", "日本語 123½²", "é I'll we're 's", "!!!???" * 50, "ab" * 400 + " " * 300]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(400)) for _ in range(5)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = {**TEXTS, **{100 + i: t for i, t in enumerate(odd)}}
    for r in bpe.encode_digests(df, path, public_tokenizers.PATTERN).collect():
        t = want[r["doc_id"]] or ""
        ids = np.array(theirs.encode_ordinary(t), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_digests(empty, path, public_tokenizers.PATTERN).count() == 0
    clash = df.where("doc_id in (3, 47)").selectExpr("doc_id", "text", "1 as ids", "2 as n_tokens")
    assert sorted(map(tuple, bpe.encode_digests(clash.union(clash), path, public_tokenizers.PATTERN).collect())) == sorted(2 * [tuple(r) for r in bpe.encode_digests(clash, path, public_tokenizers.PATTERN).collect()])
    assert bpe.RankTokenizer(path, r"\S+|\s+").split("hello 123abc!") == ["hello", " ", "123abc!"]
    assert bpe.encode(df.where("doc_id = 47"), path, public_tokenizers.PATTERN).first()["ids"] == theirs.encode_ordinary(TEXTS[47])
