"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled ones (U) train a logistic model f in numpy, by the risk

    prior * mean_P loss(f, 1) + max(0, mean_U loss(f, 0) - prior * mean_P loss(f, 0))

in which the second term, the risk on the negatives hidden in U, is not allowed to fall below zero: when it would, its gradient is turned round. A text's features are the
presence of words and of their first four to six letters. Only features that are far more usual in P than in U, of all their hash values, are weighed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, tidy, written, Cache

DIMENSIONS = 1 << 20
PREFIXES = (4, 5, 6)
#: Texts of P and of U that the steps of a fit take, about, at most; chosen by a hash of their ids.
MOST_TOXIC, MOST_UNLABELLED = 10_000, 20_000
MOST_FEATURES = 4096
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+").findall


def feature_ids(word: str) -> tuple[int, ...]:
    """Hash values of a word and its prefixes."""
    parts = ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh3_64_intdigest(p.encode("utf-8", "replace")) % DIMENSIONS for p in parts)


def words(text: str | None) -> set[str]:
    return set(_WORD((text or "").lower()))


@dataclass
class Model:
    """weights: of feature ids."""

    bias: float
    weights: dict[int, float]

    def scorer(self):
        known = Cache(lambda w: tuple(i for i in feature_ids(w) if i in self.weights), 200_000)

        def score(text: str | None) -> float:
            known.trim()
            present = {i for ids in map(known.__getitem__, words(text)) for i in ids}
            z = self.bias + sum(self.weights[i] for i in sorted(present))
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, epochs: int = 600, rate: float = 0.05, decay: float = 3e-5) -> tuple[float, np.ndarray]:
    """Bias and weights. rows: each text's features among n_features; positive: whether it is in P."""
    sizes = np.array([len(x) for x in rows], np.int64)
    at, columns = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    n_p, n_u = positive.sum(), (~positive).sum()
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        z = np.bincount(at, theta[columns], len(rows)) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        as_negative = np.logaddexp(0, z)
        hidden = as_negative[~positive].mean() - prior * as_negative[positive].mean()
        on_hidden = np.where(positive, -prior * s / n_p, s / n_u)  # the gradient of the negatives' risk by z
        g = -on_hidden if hidden < 0 else on_hidden + np.where(positive, prior * (s - 1) / n_p, 0)
        gradient = np.append(np.bincount(columns, g[at], n_features), g.sum()) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see the labels of."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _present(rows: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """rows (toxic, text) as (toxic boolean, ids array<int>): the places of the wanted feature ids that each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(lambda w: tuple(wanted[i] for i in feature_ids(w) if i in wanted), 100_000)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                known.trim()
                ids = [sorted({i for w in map(known.__getitem__, words(t)) for i in w}) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["toxic", "ids"])

    return rows.select("toxic", "text").mapInArrow(tidy(run), "toxic boolean, ids array<int>")


def feature_counts(texts: DataFrame, wanted: np.ndarray | None = None) -> np.ndarray:
    """How many of texts (text) have each of the DIMENSIONS feature ids; with wanted, a mask, the others count 0. Each task sends one row for each id that it saw, so what is shuffled and collected is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(feature_ids if wanted is None else lambda w: tuple(i for i in feature_ids(w) if wanted[i]), 100_000)
        counts = np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                known.trim()
                ids = [i for x in batch.column(0).slice(at, 256) for i in {i for w in map(known.__getitem__, words(x.as_py())) for i in w}]
                np.add.at(counts, np.array(ids, np.int64), 1)
        seen = np.flatnonzero(counts)
        for at in range(0, len(seen), 1 << 16):
            some = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["id", "n"])

    found = texts.select("text").mapInArrow(tidy(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED, most_features: int = MOST_FEATURES) -> Model:
    """A model from labels (doc_id, toxic) and texts of docs (doc_id, text), held-out rows apart.

    P is what labels call toxic (1); U is all texts, whose labels aren't looked at. The prior is the share of toxic rows among the labelled. Features are chosen by their counts in P and in all
    of U; the steps of the fit take a share of U. What comes to the driver is bounded: DIMENSIONS counts and the features of about most_toxic + most_unlabelled texts. Null ids, texts and labels are left out; an id that is labelled twice is toxic if once so.
    Without toxic examples the model gives every text 0.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    n = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    n_docs = texts.count()
    if not n[0] or not n[1]:
        return Model(-500.0, {})
    prior = min(max(n[1] / n[0], 1e-4), 0.9)
    share = lambda most, of: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, most / max(of, 1)) * (1 << 20))
    examples = few(known.where((F.col("toxic") == 1) & share(most_toxic, n[1])).select("doc_id"))
    toxic = texts.join(examples, "doc_id", "left_semi").select(F.lit(True).alias("toxic"), "text")
    rows = written(toxic.unionByName(texts.where(share(most_unlabelled, n_docs)).select(F.lit(False).alias("toxic"), "text")))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model(-500.0, {})
    in_p = feature_counts(rows.where("toxic"))
    p, u = in_p / n_p, (feature_counts(texts, in_p >= 3) + 0.5) / (n_docs + 1)
    surprise = (p - u) / np.sqrt(u * np.maximum(1 - u, 0) / n_p + 1e-12)
    # what only toxic texts have is 1 / prior times as usual in P as in U; most of that will do
    usual = np.flatnonzero((in_p >= 3) & (p > u * max(1.5, 0.6 / prior)) & (surprise > 4))
    ids = sorted(usual[np.lexsort((usual, -surprise[usual]))[:most_features]].tolist())
    if not ids:
        return Model(-500.0, {})
    found = _present(rows, {x: i for i, x in enumerate(ids)}).toPandas()
    bias, weights = fit_nnpu([np.asarray(x) for x in found.ids], found.toxic.to_numpy(bool), len(ids), prior)
    return Model(bias, dict(zip(ids, weights.tolist(), strict=True)))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches the threshold) of each row; a null or empty text has the score of no words. Nothing but the text is looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            got = np.array([score(x.as_py()) for x in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs, by a model fit to the rows that aren't held out. An empty table gives an empty one; repeated rows get a row each."""
    found = scores(docs, fit(docs, labels), threshold)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all columns."""
    model, place = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            keep = pa.array([score(x.as_py()) < threshold for x in batch.column(place)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(tidy(run), docs.schema)
