"""Repeated passages across documents, by MinHash banding of paragraphs.

Texts often repeat passages inside longer lines, so a paragraph here is what the words themselves delimit: a text is cut before each word whose hash, with its neighbour's, is the least within RADIUS words on
either side. A passage is therefore cut in the same places wherever it stands, but for its ends. Paragraphs with equal words are one item. All paragraphs that are similar enough by their sets of
5-word shingles are found: each is banded by as many of its least shingles as such a pair shares one of; those that share a band are banded again with the rarest shingles first, and what stays together is compared
exactly. Links make components; the first place of a component is kept, and the others are removals. Neighbouring repeated paragraphs are one passage, and passages under a stated length are left alone.

Texts are cut some megabytes at a time, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import few, free, join_counted, scratch, tidy, written
from .components import connected_components
from .neardup import _MIX, PERCENT, WORDS, mix
from .ragged import gather, offsets, slices, strings

#: With 4, paragraphs have nine words on average, and one repeated passage of 51 words in 500 is seen in less than PASSAGE words.
RADIUS = 4
#: Words of whole paragraphs that a passage has at least; what it has before its first cut and after its last doesn't count.
PASSAGE = 15
#: Members of a band that are compared with each other at once. Of bands with more, members that are like the band's hub are linked to it, and the others are split by a further shingle,
#: LEVELS - 1 times, and then compared with all members block by block.
HOT = 128
LEVELS = 4


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the words of texts, with a null counting as empty: what ASCII white space divides, with A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(strings(texts), "")))
    words = strings(lists.flatten()).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    real = pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)[words.indices.to_numpy()] if len(words) else np.zeros(0, bool)
    before = offsets(real)
    return known[words.indices.to_numpy()[real]], before[offsets(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]


def cuts(h: np.ndarray, at: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The first words of the paragraphs of texts whose words' hashes lie between the offsets at: a text's first word, and places at least radius words from either end."""
    starts = at[:-1][at[:-1] < at[1:]]
    if len(h) < 2 * radius + 2:
        return starts
    w = mix(h[:-1] * _MIX[40] + h[1:] * _MIX[41])
    n = len(w) - 2 * radius
    around = np.minimum.reduce([w[i : i + n] for i in range(2 * radius + 1) if i != radius])
    found = np.flatnonzero(w[radius : radius + n] < around) + radius
    text = np.searchsorted(at, found, "right") - 1
    return np.sort(np.concatenate([starts, found[(found - radius >= at[text]) & (found + radius <= at[text + 1] - 2) & (found > at[text])]]))


def paragraphs(texts: pa.Array, radius: int = RADIUS) -> tuple[np.ndarray, ...]:
    """Of all paragraphs of texts: text, first word and end among all texts' words, key of the words; then the words' hashes and the texts' offsets among them."""
    h, at = word_hashes(texts)
    first = cuts(h, at, radius)
    if not len(first):
        return (*(np.zeros(0, np.int64),) * 4, h, at)
    end = np.append(first[1:], len(h))
    within = np.arange(len(h)) - np.repeat(first, end - first)
    total = np.add.reduceat(mix(h + within.astype(np.uint64) * _MIX[42]), first)
    return np.searchsorted(at, first, "right") - 1, first, end, mix(total + (end - first).astype(np.uint64)).view(np.int64), h, at


def _sets(h: np.ndarray, first: np.ndarray, end: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sizes) of the sets of distinct shingles of paragraphs, in ascending order as signed integers; fewer than k words are one shingle of their own kind."""
    n = np.maximum(end - first - k + 1, 1)
    at = offsets(n)
    place = np.repeat(first - at[:-1], n) + np.arange(at[-1])
    words = np.minimum(end - first, k)
    total = np.repeat(words, n).astype(np.uint64)
    for i in range(k):
        here = np.repeat(words > i, n)
        total[here] += h[place[here] + i] * _MIX[i]
    values = mix(total).view(np.int64)
    # sorted in rows of like widths
    out, kept = np.empty(len(values), np.int64), np.zeros(len(values), bool)
    widths = np.where(n <= 2, n, 1 << np.ceil(np.log2(n)).astype(np.int64))
    for width in np.unique(widths).tolist():
        some = np.flatnonzero(widths == width)
        column = np.arange(width)
        inside = column < n[some, None]
        where = at[some, None] + np.minimum(column, n[some, None] - 1)
        rows = np.sort(np.where(inside, values[where], np.iinfo(np.int64).max), axis=1)
        new = inside.copy()
        new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        out[where[inside]], kept[where[inside]] = rows[inside], new[inside]
    return out[kept], np.diff(offsets(kept)[at])


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the n shingles of a paragraph, the least ones, hold one that any similar paragraph has among its own.

    A similar pair has percent / 100 of the larger set in common. So of each set at most n minus that many can come before the first common one.
    """
    return n - (percent * n + 99) // 100 + 1


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(sizes).astype(np.int32)), pa.array(values))


def _units(docs: DataFrame, radius: int, percent: int) -> DataFrame:
    """doc_id, first, end, id, bands (its least shingles) of all paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, 4 << 20):
                text, first, end, key, h, at = paragraphs(some.column(1), radius)
                if len(first):
                    values, n = _sets(h, first, end)
                    need = _least(n, percent)
                    bands = _lists(gather(values, offsets(n)[:-1], need), need)
                    columns = [some.column(0).take(pa.array(text)), pa.array((first - at[text]).astype(np.int32)), pa.array((end - at[text]).astype(np.int32)), pa.array(key), bands]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first", "end", "id", "bands"])

    return docs.mapInArrow(tidy(run), "doc_id long, first int, end int, id long, bands array<long>")


def _chosen(docs: DataFrame, radius: int) -> DataFrame:
    """id and hashes (in ascending order) of paragraphs of docs (doc_id, text, wanted: the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0, 4 << 20):
                text, first, end, key, h, _ = paragraphs(some.column(0), radius)
                lists = some.column(1)
                asked = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                # a paragraph is asked for by its own text
                both = np.concatenate([mix(asked[1].view(np.uint64) + asked[0].astype(np.uint64) * _MIX[43]), mix(key.view(np.uint64) + text.astype(np.uint64) * _MIX[43])])
                mine = np.flatnonzero(np.isin(both[len(asked[0]) :], both[: len(asked[0])]))
                values, n = _sets(h, first[mine], end[mine])
                yield pa.RecordBatch.from_arrays([pa.array(key[mine]), _lists(values, n)], names=["id", "hashes"])

    return docs.select("text", "wanted").mapInArrow(tidy(run), "id long, hashes array<long>")


def _joined(ids: list[int], sets: list[np.ndarray], sizes: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs of sets would connect. sets hold what several items have; sizes count the rest too."""
    if len(ids) < 8:
        own, out = [set(x.tolist()) for x in sets], []
        for i, x in enumerate(own):
            for k in range(i):
                both = len(x & own[k])
                if 100 * both >= percent * (sizes[i] + sizes[k] - both):
                    out.append((ids[i], ids[k]))
        return out
    n, lengths = np.array(sizes), np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(token.max()) + 1, 4096):
        some = (token >= at) & (token < at + 4096)
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[some], token[some] - at] = 1
        common += has @ has.T
    good = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(good, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(good, label[None, :], len(sets)).min(axis=1)
        if (least == label).all():
            return [(ids[i], ids[k]) for i, k in enumerate(label.tolist()) if i != k]
        label = least


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) within the groups of rows (key long, id long, n int, shared array<long>, rest boolean), each of which fits in memory; groups without a member of the rest are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, sizes, open_ = None, [], [], [], False
        links = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
        for batch in batches:
            out: list[tuple[int, int]] = []
            lists = batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (key, id_, n, rest) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)):
                if key != now:
                    if len(ids) > 1 and open_:
                        out += _joined(ids, sets, sizes, percent)
                    now, ids, sets, sizes, open_ = key, [], [], [], False
                ids.append(id_)
                sets.append(flat[at[i] : at[i + 1]])
                sizes.append(n)
                open_ |= rest
            yield links(out)
        yield links(_joined(ids, sets, sizes, percent) if len(ids) > 1 and open_ else [])

    return rows.select("key", "id", "n", "shared", "rest").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "u long, v long")


@scratch
def similar_links(items: DataFrame, percent: int = PERCENT, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """Links (u, v) that connect what all pairs of similar items would connect. items: id long, hashes array<long> (distinct), each id once. An empty table gives an empty one.

    Shingles are put in order, the rarest first, and those of one item alone are only counted. A pair whose first l common shingles are s1 .. sl has them among the first _least() + l - 1 of each, and meets
    in the band of those, at places p and q; it has l + min(n - p, m - q) - 1 in common at most, which rules out most pairs of a band of usual shingles. Bands of up to hot members are compared at once. In
    larger ones, members similar to the band's hub are linked to it, which connects them with each other; pairs with one of the rest, if there are any, meet again in bands of l + 1. No pair is left out: in bands
    of the last level the rest is compared with all members, in blocks.
    """
    sized = items.select("id", F.size("hashes").alias("n"), "hashes").where("n > 0")
    tokens = sized.select("id", "n", F.explode("hashes").alias("token"))
    often = written(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    total = often.agg(F.sum("c")).first()[0] or 0
    listed = join_counted(tokens, often, "token", total, "id").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("s"))
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rows = listed.select("id", "n", need.cast("int").alias("need"), (F.col("n") - F.size("s")).alias("own"), F.transform("s", lambda x: x["token"]).alias("shared"), F.lit(True).alias("rest"))
    rows = rows.where("need > own").select("*", F.posexplode(F.slice("shared", F.lit(1), F.col("need") - F.col("own"))).alias("q", "key"))
    rows = written(rows.select("id", "n", "need", "own", "shared", "rest", (F.col("own") + F.col("q")).alias("p"), "key"))
    found = []
    for level in range(1, levels + 1):
        large = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("rest").alias("open")).where(F.col("c") > hot)
        large = few(written(large))
        found.append(written(_compared(rows.join(large.select("key"), "key", "left_anti"), percent)))
        many = rows.join(large.where("open").select("key"), "key")
        # pairs that can be similar, by their sizes and places; there are as many kinds as a paragraph has places and lengths
        kinds = few(written(many.groupBy("key").agg(F.collect_set(F.struct("n", "p")).alias("kinds"))))
        least = lambda x: F.lit(level - 1) + F.least(F.col("n") - F.col("p"), x["n"] - x["p"])
        able = F.exists("kinds", lambda x: 100 * least(x) >= percent * (F.col("n") + x["n"] - least(x)))
        many = written(many.join(kinds, "key").where(able).drop("kinds"))
        best = F.min(F.struct("p", "n", "id", "shared"))
        hubs = few(written(many.groupBy("key").agg(F.count("*").alias("c"), best.alias("hub"))))
        many = many.join(hubs, "key")
        found.append(written(_compared(many.where(F.col("c") <= hot), percent)))
        both = F.size(F.array_intersect("shared", "hub.shared"))
        like = (F.col("id") == F.col("hub.id")) | (100 * both >= percent * (F.col("n") + F.col("hub.n") - both))
        many = written(many.where(F.col("c") > hot).withColumn("rest", ~like).withColumn("v", F.col("hub.id")).drop("hub"))
        found.append(many.where("NOT rest AND id <> v").select(F.col("id").alias("u"), "v"))
        left = written(many.where("rest").groupBy("key").agg(F.count("*").alias("n_rest")))
        if left.isEmpty():
            break
        many = many.join(few(left), "key")
        if level < levels:
            following = F.posexplode(F.slice("shared", F.col("p") - F.col("own") + 2, F.col("need") + level - F.col("p") - 1)).alias("q", "token")
            rows = many.select("id", "n", "need", "own", "shared", "rest", "p", "key", following)
            rows = written(rows.select("id", "n", "need", "own", "shared", "rest", (F.col("p") + 1 + F.col("q")).alias("p"), F.xxhash64("key", "token").alias("key")))
        else:
            blocks = lambda c: F.ceil(F.col(c) * 2 / hot).cast("int")
            place = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), blocks(c)).cast("int")
            every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
            of_rest = many.where("rest").withColumn("i", place("n_rest", 1)).withColumn("j", every("c"))
            of_all = many.withColumn("rest", F.lit(False)).withColumn("i", every("n_rest")).withColumn("j", place("c", 2))
            dealt = of_rest.unionByName(of_all).dropDuplicates(["key", "id", "i", "j", "rest"])
            found.append(written(_compared(dealt.withColumn("key", F.xxhash64("key", "i", "j")), percent)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.where("u <> v")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, radius: int = RADIUS, percent: int = PERCENT) -> DataFrame:
    """doc_id, first, end (of the words that ASCII white space divides; end exclusive), n_words, component_id, kept of each passage that also stands in another document.

    component_id is the least of its paragraphs' components (a hash); kept marks a passage all of whose paragraphs are the first places, by doc_id and word, of their components, so those not
    kept can go and one copy stays. A null or empty text has none, and repeats within one document alone don't count; rows that repeat a doc_id are one document; null ids are left out. Other
    columns aren't read. An empty table gives an empty one. Texts are read whole.
    """
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    units = written(_units(source, radius, percent))
    keys = units.select("id", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("band")
    candidates = written(units.join(keys.join(few(written(shared)), "band", "left_semi").select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")))
    asked = written(candidates.groupBy("doc_id").agg(F.collect_list("id").alias("wanted")))  # as many as a document has paragraphs
    chosen = written(_chosen(source.join(few(asked), "doc_id"), radius).dropDuplicates(["id"]))
    links = similar_links(chosen, percent)
    component = few(written(connected_components(links)))

    linked = units.select("id", "doc_id", "first", "end").join(component, "id", "left").select(F.coalesce("component", "id").alias("c"), "doc_id", "first", "end")
    first_place = F.min(F.struct("doc_id", "first"))
    repeated = linked.groupBy("c").agg(first_place.alias("place"), F.max("doc_id").alias("last")).where("place.doc_id < last").select("c", "place")
    marked = written(linked.join(few(written(repeated)), "c").select("doc_id", "first", "end", "c", (F.struct("doc_id", "first") != F.col("place")).alias("gone")).distinct())
    in_order = Window.partitionBy("doc_id").orderBy("first", "end")
    starts = F.coalesce(F.lag("end").over(in_order) != F.col("first"), F.lit(True)).cast("int")
    runs = marked.withColumn("starts", starts).withColumn("run", F.sum("starts").over(in_order))
    found = runs.groupBy("doc_id", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.min("c").alias("component_id"), (~F.max("gone")).alias("kept"))
    return found.select("doc_id", "first", "end", (F.col("end") - F.col("first")).alias("n_words"), "component_id", "kept").where(F.col("n_words") >= passage)


def remove_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """docs without the words of passages that aren't kept; other texts, all rows and columns stay as they are, whatever the columns' names. A null id or text stays.

    Rows that repeat a doc_id are searched as one document, so a span holds for each of them as far as its words reach.
    """
    gone = written(repeated_passages(docs, passage).where("NOT kept").groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct("first", "end"))).alias("gone")))
    key, spans = free(docs.columns, "key", "gone")
    joined = docs.join(few(gone).select(F.col("doc_id").alias(key), F.col("gone").alias(spans)), docs["doc_id"].cast("long") == F.col(key), "left").select(docs["*"], spans)
    names = docs.columns
    place, lists = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, g) for t, g in zip(batch.column(place).to_pylist(), batch.column(lists).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(lists)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(tidy(run), docs.schema)


def cut_words(text: str | None, spans: str | None) -> str | None:
    """text without some spans of its words, a JSON list; what lies beyond its last word counts for nothing."""
    if text is None or spans is None:
        return text
    import json

    words = list(re.finditer(r"[^ \t\n\r\x0b\x0c]+", text))
    out, at = [], 0
    for s in sorted(json.loads(spans), key=lambda x: x["first"]):
        if s["first"] < len(words):
            out.append(text[at : max(at, words[s["first"]].start())])
            at = max(at, words[s["end"]].start() if s["end"] < len(words) else len(text))
    return "".join([*out, text[at:]])
