"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard of the vectors, searched one by one and merged.

Shards have a bounded number of vectors, so one is built and searched within a task; there are more of them as the table grows. A shard's graph is as if its vectors had been inserted in
turn, each linked to diverse nearest ones among those before it, found exactly from the shard's distances, and linked back; so early vectors hold the long links. It is stored as flat
arrays: for each level, its nodes and a fixed number of places for each one's neighbours.

Equal vectors are one node that lists its smallest ids, one more than any result needs (a query leaves out its own).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import tidy, written

#: Distinct vectors of a shard, about, and queries that are sent out at once.
SHARD, QUERY_BLOCK = 4096, 1 << 14
MOST_PARTS = 4096
LINKS, SEARCH = 16, 160


def _diverse(distances: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """near (n rows of candidates, nearest first, -1 for none) without those that are nearer to a kept one than to the row's own node, or as near; most of them at most; others are -1."""
    n, width = near.shape
    own = np.where(near >= 0, distances[np.arange(n)[:, None], np.maximum(near, 0)], np.inf)
    kept = np.zeros((n, width), bool)
    for j in range(width):
        among = distances[near[:, j, None], near[:, :j]]
        kept[:, j] = (near[:, j] >= 0) & (kept.sum(axis=1) < most) & ~((among <= own[:, j, None]) & kept[:, :j]).any(axis=1)
    return np.where(kept, near, -1)


class Graph:
    """levels: from the lowest up, (nodes, neighbours), a place in nodes for each row of neighbours."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, seed: int = 7) -> Graph:
        n = len(vectors)
        height = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)), 8).astype(int)
        levels = []
        for level in range(height.max(initial=0) + 1):
            nodes = np.flatnonzero(height >= level)
            x = vectors[nodes].astype(np.float32)
            square = (x * x).sum(axis=1)
            d = np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0)
            most = 2 * links if level == 0 else links
            width = min(len(nodes), 4 * links)
            earlier = np.where(np.tri(len(nodes), k=-1, dtype=bool), d, np.inf)
            near = np.argsort(earlier, axis=1, kind="stable")[:, :width]
            near = np.where(np.take_along_axis(earlier, near, 1) < np.inf, near, -1)
            forward = _diverse(d, near, links)
            u, at = np.nonzero(forward >= 0)
            v = forward[u, at]
            a, b = np.concatenate([u, v]), np.concatenate([v, u])
            order = np.lexsort((d[a, b], a))
            a, b = a[order], b[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < 8 * links
            both = np.full((len(nodes), min(8 * links, int(place.max(initial=-1)) + 1)), -1)
            both[a[keep], place[keep]] = b[keep]
            chosen = _diverse(d, both, most)
            # a node's own links stay, whatever the pruning of its neighbours' lists
            chosen = np.concatenate([forward, chosen], axis=1)
            flat = np.full((len(nodes), most + links), -1, np.int32)
            for i, row in enumerate(chosen):
                ids = np.unique(row[row >= 0])
                flat[i, : len(ids)] = nodes[ids]
            levels.append((nodes.astype(np.int32), flat))
        return cls(vectors, levels)

    def search(self, query: np.ndarray, n: int) -> list[tuple[float, int]]:
        """n near nodes or so, nearest first, with squared distances in double precision."""
        best = int(self.levels[-1][0][0])
        distance = lambda at: ((self.vectors[at] - query) ** 2).sum(axis=-1)
        near = float(distance(best))
        for nodes, flat in self.levels[:0:-1]:
            while True:
                around = flat[np.searchsorted(nodes, best)]
                around = around[around >= 0]
                if not len(around):
                    break
                d = distance(around)
                k = int(d.argmin())
                if d[k] >= near:
                    break
                best, near = int(around[k]), float(d[k])
        flat = self.levels[0][1]
        seen = np.zeros(len(self.vectors), bool)
        seen[best] = True
        open_, found = [(near, best)], [(-near, best)]
        while open_:
            d, node = heapq.heappop(open_)
            if len(found) >= n and d > -found[0][0]:
                break
            around = flat[node]
            around = around[around >= 0]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            for d, node in zip(distance(around).tolist(), around.tolist(), strict=True):
                if len(found) < n:
                    heapq.heappush(found, (-d, node))
                    heapq.heappush(open_, (d, node))
                elif d < -found[0][0]:
                    heapq.heapreplace(found, (-d, node))
                    heapq.heappush(open_, (d, node))
        return sorted((-d, node) for d, node in found)

    def to_row(self, kind: str = "<f8") -> dict[str, bytes]:
        parts = [np.array([len(self.levels), *(k for nodes, flat in self.levels for k in flat.shape)], "<i4")]
        parts += [x.astype("<i4").ravel() for level in self.levels for x in level]
        return {"vectors": self.vectors.astype(kind).tobytes(), "graph": np.concatenate(parts).tobytes()}

    @classmethod
    def from_row(cls, vectors: bytes, graph: bytes, dimensions: int) -> Graph:
        flat = np.frombuffer(graph, "<i4")
        shapes, at, levels = flat[1 : 1 + 2 * flat[0]].reshape(-1, 2), 1 + 2 * int(flat[0]), []
        for n, width in shapes.tolist():
            levels.append((flat[at : at + n], flat[at + n : at + n + n * width].reshape(n, width)))
            at += n + n * width
        # the lowest level has all nodes
        kind = "<f4" if len(vectors) == 4 * int(flat[1]) * dimensions else "<f8"
        return cls(np.frombuffer(vectors, kind).reshape(-1, dimensions).astype(np.float64), levels)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null or zero, has only finite components, and is as long as most are."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(x) == (top.n if top else 0))


def build_index(vectors: DataFrame, k: int, shard: int = SHARD, links: int = LINKS) -> DataFrame:
    """A row for each shard: shard, members (a list of up to k + 1 smallest ids for each node), vectors and graph. vectors (id long, v array<float> or array<double>), usable ones; rows may repeat."""
    kind = "<f4" if vectors.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    shards = max(1, -(-(vectors.agg(F.approx_count_distinct(F.xxhash64("v"), 0.01)).first()[0] or 0) // shard))
    ranked = vectors.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("members"))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([m[0] for m in pdf.members], kind="stable")]
        graph = Graph.build(np.array(pdf.v.tolist(), np.float64), links)
        sizes = [len(m) for m in pdf.members]
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "sizes": sizes, "members": np.concatenate(pdf.members.tolist()).tolist(), "dimensions": graph.vectors.shape[1], **graph.to_row(kind)}])

    schema = "shard int, sizes array<int>, members array<long>, dimensions int, vectors binary, graph binary"
    # a shard is much work for its bytes, so partitions aren't merged by them
    return written(dealt.repartition(min(shards, MOST_PARTS), "shard").groupBy("shard").applyInPandas(build, schema))


def search(index: DataFrame, queries: DataFrame, k: int, effort: int = SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query (id long, v array<double> or array<float>), from all shards; not the query's own id.

    Queries are sent out in blocks of about so many, and for each block every shard is read where it lies and not shuffled. A task keeps the k nearest of its shards, and there are as many
    tasks as cores for them, or twice that; so what is shuffled grows with the queries, and neither with the shards nor with their product.
    """
    spark = index.sparkSession
    blocks = max(1, -(-queries.count() // block))
    tasks = 2 * spark.sparkContext.defaultParallelism

    def searched(number: int) -> DataFrame:
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).select("id", "v").toArrow()
        sent = spark.sparkContext.broadcast((some.column("id").to_numpy(), some.column("v").combine_chunks().flatten().to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, flat = sent.value
            asked = list(zip(ids.tolist(), flat.astype(np.float64).reshape(len(ids), -1), strict=True)) if len(ids) else []
            best: list[list[tuple[float, int]]] = [[] for _ in asked]
            for batch in batches:
                for at in range(batch.num_rows):
                    (row,) = batch.slice(at, 1).to_pylist()
                    graph = Graph.from_row(row["vectors"], row["graph"], row["dimensions"])
                    first, members = np.concatenate([[0], np.cumsum(row["sizes"])]).tolist(), row["members"]
                    for j, (own, v) in enumerate(asked):
                        near = [(d, i) for d, node in graph.search(v, max(effort, k + 1)) for i in members[first[node] : first[node + 1]] if i != own]
                        best[j] = sorted(best[j] + sorted(near)[:k])[:k]
            for at in range(0, len(asked), 1024):
                out = [(own, i, d**0.5) for (own, _), found in zip(asked[at : at + 1024], best[at : at + 1024], strict=True) for d, i in found]
                columns = [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

        out = written(index.coalesce(tasks).select("sizes", "members", "dimensions", "vectors", "graph").mapInArrow(tidy(run), "query_id long, vec_id long, score double"))
        sent.destroy()
        return out

    found = reduce(DataFrame.unionByName, map(searched, range(blocks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", effort: int = SEARCH) -> DataFrame:
    """The k nearest of each row whose id is divisible by every, among all rows but itself, by Euclidean distance: query_id, rank, vec_id, score.

    Null ids and unusable vectors (usable()) take no part. Rows that repeat an id and vector count once; equal distances are in order of ids. With fewer candidates all are returned;
    an empty table, or one without queries, gives an empty one. Other columns aren't read. Vectors of floats are kept as such, and distances are in double precision.
    """
    exact = rows.schema[vector_col].dataType.elementType.typeName() == "float"
    v = rows[vector_col].cast("array<float>" if exact else "array<double>")
    vectors = usable(rows.select(rows[id_col].cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL"), "v")
    queries = written(vectors.where(F.col("id") % every == 0).distinct())
    return search(build_index(vectors, k), queries, k, effort)
