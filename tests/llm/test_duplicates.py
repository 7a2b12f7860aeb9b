import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import common, components, neardup, substring


def brute(rows, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(rng, n, base=90, most=6):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    first, out = [word() for _ in range(base)], []
    for _ in range(n):
        w = list(rng.choice(out) if out and rng.random() < 0.5 else first)
        for _ in range(rng.randrange(1, most + 1)):
            w[rng.randrange(len(w))] = word()
        out.append(w)
    return [" ".join(w) for w in out]


def test_against_brute_force(spark):
    rng = random.Random(11)
    texts = family(rng, 320) + family(rng, 40, 30, 2)
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    rows += [(i, texts[0].upper() if i % 2 else texts[0]) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "one two"), (103, "ONE  two\n"), (104, " \n"), (105, "one two three"), (106, "É x y z w q"), (107, "é x y z w q")]
    docs = spark.createDataFrame([(i, t, "noise") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    wanted = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len({c for _, c in wanted.values()}) > 20 and got[103].component_id == 102 and got[107].component_id == 107


def test_ids_with_several_texts(spark):
    """An id that repeats with different texts is linked by each of them."""
    a, b = (" ".join(f"{p}{i}" for i in range(30)) for p in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b + " end"), (7, "z y"), (8, a + " 1 " + b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (8, 8, True), (9, 3, False)]


def test_members_unlike_their_hub(spark):
    """Links between members of a bucket that their hub is unlike, in blocks too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    core, rows = [word() for _ in range(60)], []
    for i in range(60):
        tail = [word() for _ in range(rng.choice([30, 60, 200]))]
        for k in range(2):
            w = core + tail
            if k:
                w[-1] = word()
            rows.append((2 * i + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_hot_keys_are_dealt_out(spark):
    from sparkloom.llm import common

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "key long, id long")
    counted = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("id").alias("top"))
    found = common.join_counted(rows, counted, "key", 3000, "id")
    assert sorted(found.columns) == ["c", "id", "key", "top"] and found.count() == 3000 and found.where("key = 1").select("c", "top").distinct().count() == 1
    marks = np.frombuffer(common.membership(rows.select(common.member_bit("id").alias("bit"))), np.uint8)
    bits = np.array([r.b for r in rows.select(common.member_bit("id").alias("b")).collect()])
    assert (marks[bits >> 3] >> (bits & 7) & 1).all() and np.bitwise_count(marks).sum() == len(set(bits.tolist()))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().kept


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (600, 100, 100))
        x, y = (neardup.packed(neardup.minima(np.concatenate([common, z]), 128)).view(np.uint64)[None] for z in (a, b))
        agree.append(neardup.equal_fields(x, y)[0, 0] / 128)
    chance = 2.0**-neardup.BITS
    assert abs((np.mean(agree) - chance) / (1 - chance) - 0.75) < 0.03
    assert min(agree) * 128 > neardup.least_equal(128)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 201), (201, 200), (7, 300), (None, 3)]
    found = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), 300: 0, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_passages(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    planted = [text(52 + i) for i in range(12)]
    docs, where = {}, {}
    for i in range(240):
        w = text(rng.randrange(20, 200))
        if i % 5 == 0:
            at = rng.randrange(len(w))
            p = planted[(i // 5) % 12]
            w = w[:at] + p + w[at:]
            where[i] = (at, at + len(p))
        docs[i] = " ".join(w)
    rows = [(i, t, 1) for i, t in docs.items()] + [(None, docs[0], 1), (900, None, 1), (901, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, first int").repartition(3)
    found = substring.repeated_passages(frame).collect()
    assert {r.doc_id for r in found} == set(where)
    for r in found:
        a, b = where[r.doc_id]
        assert a - 12 <= r.first and r.end <= b + 12 and r.n_words >= 15
    assert sum(r.kept for r in found) == 12 and {r.doc_id for r in found if r.kept} == set(list(where)[:12])
    cleaned = {r.doc_id: r.text for r in substring.remove_passages(frame).collect() if r.doc_id is not None}
    assert all(cleaned[i] == docs[i] for i in docs if i not in where) and all(len(cleaned[i]) < len(docs[i]) for i in list(where)[12:])
    assert cleaned[900] is None and substring.repeated_passages(frame.limit(0)).count() == 0


def test_near_passages(spark):
    """A paragraph with one changed word at its end, of many words, is linked."""
    rng = random.Random(9)
    base = ["same"] * 60  # no cut in it
    rows = [(i, " ".join(["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(10)])) for i in range(20)] + [(50, " ".join(base)), (51, " ".join(base))]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {50, 51}


def partition(pairs):
    groups = {}
    for i, c in pairs:
        groups.setdefault(c, set()).add(i)
    return sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))


def test_near_passages_unlike_their_hub(spark):
    """Near copies are linked also where most of those that share a run of words with them are unlike them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    run = [word() for _ in range(5)]
    rows = []
    for i in range(150):
        w = run + [word() for _ in range(4)] if i % 2 else [word() for _ in range(4)] + run
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1] if i % 2 else w[1:]))]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), passage=1).collect()
    assert partition((r.doc_id, r.component_id) for r in found) == partition((i, c) for i, (_, c) in brute(rows).items()) == [[2 * i, 2 * i + 1] for i in range(150)]


def test_similar_links(spark):
    """Bands of any size, split or in blocks, against all pairs."""
    rng = random.Random(6)
    sets = {tuple(sorted(rng.sample(range(14), rng.randrange(1, 10)))) for _ in range(300)} | {tuple(sorted({*range(20, 36), *rng.sample(range(36, 60), rng.randrange(5))} - {rng.randrange(20, 36)})) for _ in range(60)}
    sets |= {tuple(sorted([0, 1, 2, *rng.sample(range(100, 900), rng.randrange(1, 6))])) for _ in range(200)}
    rows = [(i, list(x)) for i, x in enumerate(sorted(sets))]
    root = list(range(len(rows)))
    for i, x in rows:
        for k, y in rows[:i]:
            both = len(set(x) & set(y))
            if 100 * both >= 75 * (len(x) + len(y) - both) and root[i] != root[k]:
                root = [min(root[i], root[k]) if r in (root[i], root[k]) else r for r in root]
    items = spark.createDataFrame(rows, "id long, hashes array<long>")
    for hot, levels in ((10_000, 3), (6, 3), (2, 6), (4, 1)):
        got = components.connected_components(substring.similar_links(items, hot=hot, levels=levels)).collect()
        assert partition((r.id, r.component) for r in got) == partition(enumerate(root)), (hot, levels)


def test_written_leaves_no_shuffle(spark):
    """The shuffle files of a written table go at once, not when the driver collects its garbage; the session's own setting stays."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name for x in range(disk.getAllFiles().size()) if (name := disk.getAllFiles().apply(x).getName()).startswith("shuffle_")}
    spark.sparkContext._jvm.System.gc()
    before, held = shuffles(), spark.range(1000).withColumn("k", F.col("id") % 7)
    setting = spark.conf.get(common.SWEEP, None)
    got = common.written(held.repartition(4, "k").groupBy("id").agg(F.max("k").alias("k")).repartition(3, "k"))
    for _ in range(100):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(common.SWEEP, None) == setting
    assert got.count() == 1000 and held.groupBy("k").count().count() == 7


def _tables(spark):
    """The columns of each table in the shared folder."""
    found = Path(common.shared_dir(spark).removeprefix("file://"), "sparkloom")
    return {p.name: set(spark.read.parquet(str(p)).columns) for p in found.iterdir() if list(p.glob("*.parquet"))} if found.exists() else {}


def test_tables_on_the_way_go(spark, monkeypatch):
    """While links are sought, one table has the bands, that of the classes; what the pipeline's stage leaves behind is the list of those that go."""
    import corpus_pipeline

    rng = random.Random(7)
    docs = spark.createDataFrame(list(enumerate(family(rng, 60) + [None, ""])), "doc_id long, text string").repartition(3)
    before, seen, links = _tables(spark), [], neardup.near_links
    new = lambda: {name: columns for name, columns in _tables(spark).items() if name not in before}
    monkeypatch.setattr(neardup, "near_links", lambda *a, **k: (seen.append([c for c in new().values() if "bands" in c]), links(*a, **k))[1])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert [len(x) for x in seen] == [1] and "id" in seen[0][0]
    assert list(new().values()) == [{"doc_id"}]
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i, (n, c) in brute([(r.doc_id, r.text) for r in docs.collect()]).items() if i == c}
    assert 2 < len(kept) < 62
