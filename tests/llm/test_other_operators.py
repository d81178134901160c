"""WARC, tool calls, top-k, components and the pipeline, against brute force."""

import base64
import hashlib
import json
import random

import numpy as np
import pytest

from vecloom.llm import chat, graph, maxscore, warc


def test_op8_round_trip(spark, monkeypatch):
    rng = random.Random(2)
    big = "".join(rng.choice("abé<>\n ") for _ in range(50_000))
    html = {1: "a", 2: "a", 3: None, 4: "", 5: big, 6: big + "x", 7: big, 8: "WARC/1.1\r\n\r\n"}
    url = {1: "http://x/a b\n", 2: None}
    df = spark.createDataFrame([(i, url.get(i, "http://x/"), h, "extra") for i, h in html.items()] + [(5, "http://x/", big, "extra")], "page_id long, url string, html string, record_type string")
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    rows = warc.round_trip(df.repartition(2)).collect()
    assert len(rows) == 9
    for r in rows:
        data = (html[r["page_id"]] or "").encode()
        first = min(i for i, h in html.items() if (h or "") == data.decode())
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == r["page_id"] else "revisit", None if first == r["page_id"] else first)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_op8_chunks(spark, tmp_path, monkeypatch):
    files = warc.write(spark.createDataFrame([(1, None, "é" * 3000), (2, "u", "")], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    batches = [b for b in files.select("path").toArrow().to_batches() if b.num_rows]
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = [r for b in warc.read_batches(iter(batches), True) for r in b.to_pylist() if r["page_id"] == 1]
    assert [r["chunk"] for r in rows] == list(range(6)) and [r["last"] for r in rows] == [False] * 5 + [True]
    data = b"".join(r["data"] for r in rows)
    assert data == ("é" * 3000).encode() and all(len(r["data"]) == 1000 for r in rows)
    for r in rows:  # digests so far
        assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(data[: r["bytes_so_far"]]).digest()).decode()


def test_op5_links(spark):
    call = lambda x: f"<tool_call>{json.dumps(x) if isinstance(x, dict) else x}</tool_call>"
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "do " + call({"id": "b", "name": "search", "arguments": {"query": "$a", "limit": 3}}) + call({"name": "calculator", "id": "a", "arguments": {"expression": "1+1"}}) + call("oops")),
        (1, 2, "tool", '{"tool_call_id":"a","content":"2"}'),
        (1, 3, "tool", '{"tool_call_id":"b","content":{"z":1}}'),
        (1, 4, "tool", '{"tool_call_id":"a","content":"later"}'),
        (2, 0, "assistant", call({"id": "x", "name": "weather", "arguments": {"city": 5}, "after": ["y"]}) + call({"id": "y", "name": "nope", "after": ["x"]})),
        (2, 1, None, None),
        (None, 1, "assistant", call({"id": "x", "name": "weather", "arguments": {"unit": "c", "city": "Z"}})),
        (3, 0, "assistant", 'é "q"\n\t\x01'),
        (3, 0, "assistant", 'é "q"\n\t\x01'),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, id string")
    out = {}
    for r in chat.messages(df).collect():
        out.setdefault((r["conv_id"], r["turn"]), []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    one = out[1, 1][0]
    assert (one["n_calls"], one["n_linked"], one["n_invalid"], one["n_cyclic"], one["n_broken"]) == (3, 2, 0, 0, 1)
    told = json.loads(one["message"])
    assert [(c["id"], c["level"], c["valid"]) for c in told["tool_calls"]] == [("a", 0, True), ("b", 1, True)]
    assert told["tool_calls"][0]["result"] == "2" and told["content"] == "do"
    assert one["message"] == json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert (out[2, 0][0]["n_cyclic"], out[2, 0][0]["n_invalid"]) == (2, 2)
    assert json.loads(out[None, 1][0]["message"])["tool_calls"][0]["valid"] is True
    assert json.loads(out[2, 1][0]["message"]) == {"role": "user", "turn": 1}
    assert len(out[3, 0]) == 2 and json.loads(out[3, 0][0]["message"])["content"] == 'é "q"\n\t\x01'
    assert chat.messages(df.limit(0)).count() == 0


def test_op5_generated_conversations(spark):
    """A table with calls, against plain Python: links, levels, cycles, checks against a table of schemas, canonical JSON."""
    rng = random.Random(21)
    schemas = [
        ("find", "q", "string", True, None), ("find", "n", "integer", False, None), ("find", "where", "string", False, ['"a"', '"b"']),
        ("sum", "xs", "array", True, None), ("sum", "opt", "object", False, None), ("now", None, None, None, None),
    ]
    values = ["x", "é\"", 1, -2.5, True, None, [1, "$c0"], {"b": 1, "a": [2]}, "a", "b", "$c1"]
    kinds = {str: "string", int: "number", float: "number", bool: "boolean", type(None): "null", list: "array", dict: "object"}
    canon = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    rows, want = [], {}
    for conv in range(40):
        made, results = [], {}
        for turn in range(rng.randrange(1, 6)):
            calls, blocks = [], []
            for place in range(rng.randrange(0, 4)):
                kind = rng.randrange(8)
                if kind == 0:
                    blocks.append("{broken")
                    calls.append(None)
                    continue
                c = {"id": f"c{rng.randrange(5)}", "name": rng.choice(["find", "sum", "now", "none"])}
                if kind == 1:
                    c["arguments"] = "not json"
                elif kind > 2:
                    c["arguments"] = {k: rng.choice(values) for k in rng.sample(["q", "n", "where", "xs", "opt", "zz"], rng.randrange(0, 3))}
                if rng.random() < 0.3:
                    c["after"] = [f"c{rng.randrange(6)}"]
                blocks.append(json.dumps(c))
                calls.append(c)
            text = f"say {turn}" + "".join(f"<tool_call>{b}</tool_call>" for b in blocks)
            rows.append((conv, 2 * turn, "assistant", text))
            made += [(2 * turn, p, c) for p, c in enumerate(calls)]
            if rng.random() < 0.7:
                told = f"c{rng.randrange(5)}"
                rows.append((conv, 2 * turn + 1, "tool", json.dumps({"tool_call_id": told, "content": f"r{turn}"})))
                results.setdefault(told, f"r{turn}")
        first, needs = {}, {}
        for turn, place, c in made:
            if c and c["id"] not in first:
                first[c["id"]] = (turn, place)
                held = json.dumps(c.get("arguments", {}))
                needs[c["id"]] = set(c.get("after", [])) | {x for x in ("c0", "c1") if f'"${x}"' in held}
        level = {}
        while True:
            ready = [i for i in needs if i not in level and all(d in level for d in needs[i] if d in needs)]
            if not ready:
                break
            level |= {i: max([level[d] + 1 for d in needs[i] if d in needs], default=0) for i in ready}
        for turn in {t for c, t, r, _ in rows if c == conv and r == "assistant"}:
            mine = [(p, c) for t, p, c in made if t == turn]
            entries = []
            for place, c in mine:
                if not c:
                    continue
                args = c.get("arguments", {})
                schema = {a: (k, need, ok) for t, a, k, need, ok in schemas if t == c["name"] and a}
                valid = any(t == c["name"] for t, *_ in schemas) and isinstance(args, dict) and set(args) <= set(schema)
                for a, (k, need, ok) in schema.items() if valid else ():
                    if a in args:
                        v = args[a]
                        typed = kinds[type(v)] == k or k == "integer" and type(v) is int
                        valid = valid and typed and (ok is None or canon(v) in ok)
                    else:
                        valid = valid and not need
                linked = first[c["id"]] == (turn, place) and c["id"] in results
                e = {"arguments": args, "id": c["id"], "name": c["name"], "valid": valid}
                e |= {"level": level[c["id"]]} if c["id"] in level else {}
                e |= {"result": results[c["id"]]} if linked else {}
                entries.append((level.get(c["id"], 1 << 31), place, e))
            want[conv, turn] = (
                len(mine), sum("result" in e for *_, e in entries), sum(not e["valid"] for *_, e in entries),
                sum("level" not in e for *_, e in entries), len(mine) - len(entries),
                [e for *_, e in sorted(entries, key=lambda x: x[:2])] if mine else None,
            )
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.messages(df.repartition(4), spark.createDataFrame(schemas, chat.SCHEMAS)).where("role = 'assistant'").collect()
    assert len(out) == len(want)
    for r in out:
        told = json.loads(r["message"])
        assert (r["n_calls"], r["n_linked"], r["n_invalid"], r["n_cyclic"], r["n_broken"], told.get("tool_calls")) == want[r["conv_id"], r["turn"]], (r, want[r["conv_id"], r["turn"]])
        assert r["message"] == canon(told) and told["content"] == f"say {r['turn'] // 2}"


def test_op10_topk(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 16), (303, rows[7][1]), (304, rows[7][1]), (305, [2.0] * 3), (350, []), (None, [1.0] * 16), (400, [1e30] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in maxscore.topk(df.where("vec_id is null or vec_id <> 400"), F.col("vec_id") % 50 == 0, shard_rows=64, query_rows=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows if i is not None and i != 400 and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in usable if i % 50 == 0):
        scored = sorted((-int(sum(a * b for a, b in zip(usable[q], v))), i) for i, v in usable.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert maxscore.topk(df, F.col("vec_id") % 50 == 0).where("query_id = 400").count() == 5  # saturates
    assert maxscore.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import os

    import corpus_pipeline as P

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    seen = []
    for name, stage in P.STAGES:
        docs = P.staged(stage(spark, docs, data), name)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    assert all(later <= earlier for earlier, later in zip([set(before), *seen], seen))
    long_enough = {i for i in good & set(before) if len((before[i]["text"] or "").split()) >= 50}
    assert len(long_enough - seen[0]) <= 0.02 * len(long_enough)
    assert seen[-1] == seen[-2] and seen[-1]
