"""The operators in DataFrame operations: winnowing, personal data, licenses, chats."""

import collections
import json
import math
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontam, license, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, names = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    names |= windows[tuple(w[a : a + k])]
        out[d] = (len(w), len(hit), sorted(names))
    return out


def no_python(df):
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_winnowing(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(60)] + ["é", "É", "Ab"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([30, 12, 10, 9, 5, 4, 1, 0, 25, 25])] + [(20, None), (10, "w1-w2, w3"), (None, "w9")]
    docs = []
    for d in range(120):
        w = text(rng.randrange(0, 60))
        if d % 3 == 0:
            p = WORD.findall(rng.choice(items[:10])[1])
            a = rng.randrange(len(p) + 1)
            w = w[:10] + p[a : a + rng.choice([8, 10, 11, 40])] + w[10:]
        docs.append((d, (" " if d % 2 else "-").join(w).upper() if d % 7 == 0 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, items[0][1] + " " + items[0][1])]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, words string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(frame, bench)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    assert got == brute_hits(docs, [x for x in items if x[0] is not None])
    assert sum(x[1] > 0 for x in got.values()) > 20
    no_python(found)
    assert not decontam.contamination(frame, bench.limit(0)).where("contaminated").count()
    assert decontam.contamination(frame.limit(0), bench).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0


def brute_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            s = m[0]
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: luhn(s), "phone": lambda: 9 <= sum(c.isdigit() for c in s) <= 15}[kind]():
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(4)
    parts = ["a.b@c.d", "a.b@c.d_e@f.g", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111111111111112", "+1 (663) 555-6869", "+12", "+1-2-3-4-5-6-7-8-9", "é", "日", "\U0001f600", " ", "\n", "-", "+", ".", "77", "word", "a%b+c@d-e.f-g.h"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(400)] + [(900, None), (901, ""), (902, "a" * 50_000 + " " + "1" * 50_000 + "a.b." * 9000)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs] + [(5, docs[5][1], 0)], "doc_id long, text string, kind int").repartition(4)
    found = pii.found_spans(frame)
    no_python(found)
    rows = found.collect()
    assert len(rows) == len(docs) + 1
    texts = dict(docs)
    for r in rows:
        base = [(x.start, x.kind_no, x.end, x.kind) for x in r.found if x.kind != "term"]
        assert base == brute_spans(texts[r.doc_id]), texts[r.doc_id]
    assert pii.found_spans(frame.limit(0)).count() == 0


def brute_terms(docs, share=0.9, support=2):
    """The places of disclosing words of each document, by all pairs of words and entities."""
    word = regex.compile(pii.TERM)
    entities = {d: {(k, t[a:e].lower()) for a, _, e, k in brute_spans(t)} for d, t in docs.items() if t is not None}
    words = {d: {m[0].lower() for m in word.finditer(t)} for d, t in docs.items() if t is not None}
    total, pairs = len(words), collections.Counter((e, w) for d in words for e in entities[d] for w in words[d])
    n_e, n_w = (collections.Counter(x for s in of.values() for x in s) for of in (entities, words))
    tells = {(e, w) for (e, w), n in pairs.items() if n >= support and n_e[e] < total and math.log2(n * total / (n_w[w] * n_e[e])) >= share * math.log2(total / n_e[e])}
    return {d: [(m.start(), m.end()) for m in word.finditer(docs[d]) if any((e, m[0].lower()) in tells for e in entities[d])] for d in words}


def test_terms_against_brute_force(spark):
    rng = random.Random(21)
    words = ["w" + "abcdefghij"[i % 10] * (i // 10 + 1) for i in range(60)] + ["a", "Straße", "É", "x1", "b@c", "don't"]
    mails = [f"m{i}@x.org" for i in range(12)] + ["10.0.0.7", "+1 (663) 555-6869"]
    secret = {m: [f"q{'abcdefghijklmn'[i]}z", f"R{'abcdefghijklmn'[i]}"] for i, m in enumerate(mails)}
    docs = {}
    for i in range(260):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 40))]
        for m in rng.sample(mails, rng.choice([0, 0, 1, 1, 2])):
            for x in (m, *(s for s in secret[m] if rng.random() < 0.8)):
                w.insert(rng.randrange(len(w) + 1), x)
        docs[i] = rng.choice([" ", ", ", "\n"]).join(w)
    docs |= {900: None, 901: "", 902: "m1@x.org " + "plain words " * 20_000 + "qbz", 903: docs[1]}
    frame = spark.createDataFrame([(d, t, "q", 1) for d, t in docs.items()] + [(5, docs[5], "z", 2)], "doc_id long, text string, term string, d int").repartition(4)
    found = pii.found_spans(frame)
    no_python(found)
    got = {r.doc_id: [(x.start, x.end) for x in r.found if x.kind == "term"] for r in found.collect()}
    wanted = brute_terms(docs)
    assert {d: x for d, x in got.items() if x} == {d: x for d, x in wanted.items() if x}
    assert sum(map(len, wanted.values())) > 50 and any(a == 0 for x in wanted.values() for a, _ in x)


def test_disclosing_words(spark):
    docs = [(i, "common words here: reach Zebulon at z.b@example.org today, " + "and more words " * 40 + "Zebulon") for i in range(3)] + [(10 + i, "common words here and today nothing else") for i in range(40)] + [(99, "common words here: other@example.org today")]
    clashing = ["d", "h", "found", "found_", "id_", "h_", "kind"]
    frame = spark.createDataFrame([(d, t, len(t), *clashing) for d, t in docs], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in clashing))
    spans = {r.doc_id: [docs[r.doc_id][1][x.start : x.end] for x in r.found] for r in pii.found_spans(frame).where("doc_id < 3").collect()}
    assert all(s.count("Zebulon") == 2 and "today" not in s and "words" not in s for s in spans.values())
    cleaned = pii.sanitise(frame)
    no_python(cleaned)
    out = {r.doc_id: r for r in cleaned.collect()}
    assert cleaned.columns == frame.columns and out[0].found == "found" and "Zebulon" not in out[0].text
    assert "<TERM>" in out[0].text and "<EMAIL>" in out[0].text and "z.b" not in out[0].text and out[0].n_chars == len(out[0].text)
    assert out[10].text == docs[3][1] and out[99].text == "common words here: <EMAIL> today"
    assert pii.sanitise(frame.limit(0)).count() == 0


def test_sanitise_overlaps(spark):
    text = "call +1.2.3.4.55555555 now"
    assert brute_spans(text) and len(brute_spans(text)) >= 1
    got = pii.sanitise(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got}[1] == "call <PHONE> now" and {r.doc_id: r.text for r in got}[2] is None


def test_licenses(spark):
    fill = lambda n, seed: " ".join(random.Random(seed).choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(n))
    t = license.TEMPLATES
    near = t["mit-grant"].replace("associated ", "")
    docs = [(1, fill(50, 1) + " " + t["mit"] + ". " + fill(50, 2)), (2, fill(80, 3)), (3, t["apache-2.0"].upper()), (4, fill(9, 4) + near), (5, None), (6, ""), (7, (t["gpl-3.0"] + "\n") * 40), (8, "Permission is hereby granted, free of charge, to nobody at all, ever, in any case"), (None, t["mit"])]
    frame = spark.createDataFrame([(d, x, "q") for d, x in docs], "doc_id long, text string, license string")
    found = license.scan(frame)
    no_python(found)
    assert {(r.doc_id, r.license) for r in found.collect()} == {(1, "mit"), (3, "apache-2.0"), (4, "mit-grant"), (7, "gpl-3.0")}
    assert {r.doc_id: r.start for r in found.collect()}[1] == 50
    assert license.scan(frame.limit(0)).count() == 0


def test_chats(spark):
    calls = [
        ("c", "1", "add", '{"b": 2, "a": 1}', None), ("c", "2", "add", '{"a": 1}', ["1"]), ("c", "3", "add", '{"a": "x", "b": 2}', ["2", "1"]), ("c", "4", "add", '{"a": 1, "b": 2, "z": 0}', []), ("c", "5", "none", "{}", []), ("c", "6", "add", "not json", ["7"]),
        ("c", "7", "add", '{"a": 1, "b": 2.5}', ["6"]), ("d", "1", "add", '{"a": 1, "b": 2}', ["9"]), ("d", "2", "add", "[1]", []), (None, "1", "add", "{}", []), ("c", "1", "add", '{"b": 2, "a": 1}', None), ("e", "1", "add", None, []),
    ]
    results = [("c", "1", 'thr"ee'), ("c", "1", 'thr"ee'), ("d", "2", None), ("x", "1", "lost")]
    schemas = [("add", "a", "integer", True), ("add", "b", "number", True)]
    found = chat.link_calls(
        spark.createDataFrame(calls, "conv_id string, call_id string, name string, arguments string, needs array<string>"),
        spark.createDataFrame(results, "conv_id string, call_id string, content string"),
        spark.createDataFrame(schemas, "name string, field string, type string, required boolean"),
    )
    no_python(found)
    got = {(r.conv_id, r.call_id): r for r in found.collect()}
    assert {k: r.level for k, r in got.items()} == {("c", "1"): 0, ("c", "2"): 1, ("c", "3"): 2, ("c", "4"): 0, ("c", "5"): 0, ("c", "6"): None, ("c", "7"): None, ("d", "1"): None, ("d", "2"): 0, ("e", "1"): 0}
    assert {k for k, r in got.items() if r.valid} == {("c", "1")}
    assert {k for k, r in got.items() if r.linked} == {("c", "1"), ("d", "2")}
    assert got["c", "1"].json == '{"arguments":{"a":1,"b":2},"id":"1","name":"add","result":"thr\\"ee"}'
    assert json.loads(got["c", "6"].json)["arguments"] is None and got["c", "2"].json.endswith('"result":null}')


def brute_levels(needs):
    """Levels by repeated rounds over all calls; those never settled have none."""
    done = {}
    while True:
        new = {k: max((done[x] for x in v), default=-1) + 1 for k, v in needs.items() if k not in done and all(x in done for x in v)}
        if not new:
            return {k: done.get(k) for k in needs}
        done.update(new)


def test_levels(spark):
    """Long chains, cycles, missing calls and calls that need several, against brute force."""
    rng = random.Random(8)
    needs = {}
    for i in range(300):
        needs["chain", str(i)] = [("chain", str(i - 1))] if i else []
        needs["ring", str(i)] = [("ring", str((i + 1) % 40))] if i < 40 else [("ring", str(i - 1))]
        needs["lost", str(i)] = [("lost", str(i - 1))]
        needs["mixed", str(i)] = [("mixed", str(x)) for x in {rng.randrange(i) for _ in range(rng.randrange(4))}] if i else []
        needs["odd", str(i)] = [("odd", str(x)) for x in {rng.randrange(i + 3) for _ in range(rng.choice([0, 1, 1, 2]))}]
    rows = [(c, k, [x for _, x in v] or None) for (c, k), v in needs.items()]
    frame = spark.createDataFrame(rows + rows[:50], "conv_id string, call_id string, needs array<string>").repartition(3)
    found = chat.levels(frame)
    no_python(found)
    assert {(r.conv_id, r.call_id): r.level for r in found.collect()} == brute_levels(needs)
    assert chat.levels(frame.limit(0)).count() == 0


def test_chat_edges(spark):
    """Empty tables, other columns of clashing names, very long texts."""
    calls = spark.createDataFrame([("c", "1", "f", '{"a": "' + "x" * 300_000 + '"}', None, 5, True)], "conv_id string, call_id string, name string, arguments string, needs array<string>, level int, linked boolean")
    results = spark.createDataFrame([("c", "1", "y" * 300_000, "z")], "conv_id string, call_id string, content string, result string")
    schemas = spark.createDataFrame([("f", "a", "string", True, 1)], "name string, field string, type string, required boolean, types int")
    got = chat.link_calls(calls, results, schemas).collect()
    assert len(got) == 1 and got[0].valid and got[0].linked and len(got[0].json) > 600_000
    assert chat.link_calls(calls.limit(0), results, schemas).count() == 0
    alone = chat.link_calls(calls, results.limit(0), schemas.limit(0)).first()
    assert not alone.valid and not alone.linked


@pytest.mark.parametrize("text", ['{"b":1,"a":{"d":2,"c":[3, 4]}}', "[1,  2]", "1", "nope"])
def test_canonical(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(chat.canonical(F.col("t")).alias("x")).first().x
    assert got == (json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")) if text != "nope" else None)
