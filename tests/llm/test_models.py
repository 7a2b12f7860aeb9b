import math
import os
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import ann, toxicity


def test_nnpu_finds_the_hidden_positives():
    rng = np.random.default_rng(4)
    rows, positive, truth = [], [], []
    for i in range(3000):
        toxic = rng.random() < 0.2
        rows.append(np.flatnonzero(rng.random(30) < np.where((np.arange(30) < 3) & toxic, 0.6, 0.05 * (np.arange(30) >= 3))))
        truth.append(toxic)
        positive.append(toxic and i % 3 == 0)
    positive, truth = np.array(positive), np.array(truth)
    # confirmed rows stand in P and, as all rows do, in U
    bias, w = toxicity.fit_nnpu([*[rows[i] for i in np.flatnonzero(positive)], *rows], np.append(np.ones(positive.sum(), bool), np.zeros(len(rows), bool)), 30, 0.2)
    seen = np.array([any(x < 3 for x in r) for r in rows])
    guess = np.array([1 / (1 + np.exp(-bias - w[r].sum())) >= toxicity.THRESHOLD for r in rows])
    assert (guess == seen).mean() > 0.98 and (guess & ~truth).mean() < 0.005


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    clean = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    bad = ["nastyword", "viletalk", "rottenspeech", "foulmouth"]
    docs, labels = [], []
    for i in range(3000):
        toxic = rng.random() < 0.15
        w = [rng.choice(clean) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "s", "ing"])
        docs.append((i, " ".join(w), "src" if toxic else "other"))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    docs += [(9000, None, "x"), (9001, "", "x"), (None, "nastyword viletalk foulmouth", "x"), (1, docs[1][1], "x")]
    labels += [(None, 1, 1), (9002, 1, None), (1, 1, labels[0][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[2] for r in docs[:3000]}


def test_features_are_counted_over_all_texts(spark):
    texts = ["you idiot idiots", "Idiotic", None, "", "fine words", "you you"] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    want = np.zeros(toxicity.DIMENSIONS, np.int64)
    for t in texts:
        for i in {i for w in toxicity.words(t) for i in toxicity.feature_ids(w)}:
            want[i] += 1
    assert (toxicity.feature_counts(docs) == want).all()
    some = want >= 80
    assert some.any() and (toxicity.feature_counts(docs, some) == np.where(some, want, 0)).all()
    assert not toxicity.feature_counts(docs.limit(0)).any()


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 3004 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows if r.doc_id is not None)
    known = [r for r in held if r.doc_id in truth]
    assert sum(r.predicted == (truth[r.doc_id] == "src") for r in known) / len(known) > 0.98
    assert not [r for r in known if r.predicted and truth[r.doc_id] == "other"]
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9000].predicted == 0 and by_id[9000].score == by_id[9001].score and by_id[None].predicted == 1


def test_labels_of_held_out_rows_change_nothing(corpus):
    docs, labels, _ = corpus
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.fit(docs, x) for x in (labels, turned))
    assert a == b


def test_keep_clean_and_edges(corpus, spark):
    docs, labels, truth = corpus
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 2500 < kept.count() < 2700
    none = toxicity.toxicity(docs, labels.limit(0))
    assert {r.score for r in none.select("score").distinct().collect()} == {r.score for r in none.limit(1).collect()} and none.where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def exact(rows, every, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[int(ids[q])] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if i != q][:k]
    return out


def test_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24))
    x = (centres[rng.integers(0, 8, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    vectors = frame.selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS v")
    index = ann.build_index(vectors, 10, shard=700)
    assert index.count() == 5 and index.selectExpr("sum(size(members))").first()[0] == 3000
    got = {}
    for r in ann.search(index, vectors.where("id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wanted = exact(rows, 50, 10)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in wanted.items()) >= 0.95 * 10 * len(wanted)
    for q, found in got.items():
        scores = {v: math.dist(rows[v][1], rows[q][1]) for v, _ in found}
        assert len(found) == 10 and all(abs(s - scores[v]) < 1e-9 for v, s in found) and [s for _, s in found] == sorted(s for _, s in found)


def test_search_sends_each_query_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    index = ann.build_index(vectors, 10, shard=20)
    wanted = exact(rows, 4, 10)
    found = ann.search(index, vectors.where("id % 4 = 0"), 10, block=30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan  # no table of queries by shards
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert 19 <= index.count() <= 21 and set(got) == set(wanted)
    for q, near in wanted.items():
        assert [v for v, _ in got[q]] == [v for v, _ in near] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got[q], near, strict=True))


def test_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 400)] + [(400, [5.0, 5.0]), (500, [1.0, 2.5]), (401, None), (402, [0.0, 0.0]), (403, [1.0, None]), (404, [nan, 1.0]), (405, [inf, 1.0]), (406, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (0, [1.0, 2.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 100, 200, 300, 400, 500}
    assert got[0] == list(range(1, 11)) and got[100] == list(range(10)) and got[400] == [500, *range(9)] and got[500] == list(range(10))
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_pipeline(spark):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from sparkloom.llm import bpe, decontam, neardup

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = {}
    at = docs
    from sparkloom.llm.common import written

    for name, f in corpus_pipeline.STAGES:
        at = written(f(spark, at, sf))
        stages[name] = at
        if name != "byte_bpe":
            assert sorted(at.columns) == sorted(docs.columns)
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    first = {r.doc_id: r.text for r in stages["toxicity"].collect()}
    assert set(first) == {r.doc_id for r in docs.collect()} - toxic
    kept = {r.doc_id for r in neardup.near_duplicates(stages["toxicity"]).where("kept").collect()}
    assert {r.doc_id for r in stages["minhash_near_dedup"].collect()} == kept
    hit = {r.doc_id for r in decontam.contamination(stages["minhash_near_dedup"], spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    clean = {r.doc_id: r.text for r in stages["benchmark_decontamination"].collect()}
    assert set(clean) == kept - hit
    final = {r.doc_id: r.text for r in stages["pii"].collect()}
    assert set(final) == set(clean) and all("@" in clean[d] or any(c.isdigit() for c in clean[d]) for d in clean if final[d] != clean[d])
    t = bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    assert {r.doc_id: list(r["ids"]) for r in stages["byte_bpe"].collect()} == {d: enc.encode_ordinary(x) for d, x in final.items()}


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, rows that repeat an id, names that clash, an empty table."""
    import corpus_pipeline

    words = ["".join("bcdfglmnprst"[(i * 7 + k) % 12] + "aeiou"[(i + k) % 5] for k in range(3)) for i in range(300)]
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak, twin = text(30), text(40)
    rows = [(1, twin), (2, twin), (2, twin), (3, None), (4, ""), (None, text(20)), (None, f"x {leak} y"), (5, f"a {leak}"), (5, text(25)), (6, text(60_000)), (7, "write to a.b@example.org"), (3, None)]
    names = ["id_", "h_", "found_", "gone_", "doc_id_", "d", "h", "found", "key", "component_id", "kept", "from"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, empty = docs, docs.limit(0)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at, empty = stage(spark, at, str(tmp_path)), stage(spark, empty, str(tmp_path))
        seen[name] = sorted((str(r.doc_id), getattr(r, "text", None)) for r in at.collect())
        assert empty.count() == 0
        if name != "byte_bpe":
            assert at.columns == docs.columns
    every = sorted((str(i), t) for i, t in rows)
    assert len(seen["toxicity"]) == len(rows)
    assert [x for x in every if x not in seen["minhash_near_dedup"]] == [("2", twin), ("2", twin)]
    assert len(seen["minhash_near_dedup"]) - len(seen["benchmark_decontamination"]) == 2 and ("5", f"a {leak}") not in seen["benchmark_decontamination"]
    assert ("None", f"x {leak} y") not in seen["benchmark_decontamination"] and ("7", "write to <EMAIL>") in seen["pii"]
    assert len(seen["byte_bpe"]) == len(rows) - 4
