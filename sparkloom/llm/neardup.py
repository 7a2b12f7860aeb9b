"""Near-duplicate documents by b-bit MinHash.

Texts with equal shingle sets form a class, and classes are the items that are compared. Of each item's minima only the low bits are kept, packed into longs; full minima
are used once, for the band keys. Items that share a band key, a bucket, are candidates.

Candidates are linked in two steps, neither of which makes all pairs of a bucket:

1. Each bucket has a hub, the member that sits in the most and fullest buckets. Each member is compared, by the collision-corrected similarity of the
   packed signatures, with the hubs of its buckets, and exactly with the likeliest; then with the other likely ones that this hasn't connected it with. Nearly all members of a group of
   copies are linked so.
2. What that leaves open: in each bucket, the members outside the bucket's largest component are compared with all members, in
   blocks of bounded size. Signatures rule out most pairs, within the block's task; exact intersections are counted for the rest there too, and a block
   returns at most one link between two components. So a link is lost only if a pair shares no band, which at 0.75 happens five times in a million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, drop_written, few, join_counted, member_bit, membership, scratch, tidy, written
from .components import connected_components

WORDS = 5
#: 100 * intersection >= PERCENT * union
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 4
#: Signatures whose estimate lies more than six standard deviations below the threshold rule a pair out.
MARGIN = 6.0
#: Members in a block, about, and those that are compared with all others of it at once.
BLOCK, AT_ONCE = 1024, 64

_rng = np.random.default_rng(20240607)
_SEEDS = (_rng.integers(0, 2**32, 1024, dtype=np.uint32) | np.uint32(1), _rng.integers(0, 2**32, 1024, dtype=np.uint32))
_MIX = _rng.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of 64-bit shingle hashes of texts; words are what ASCII white space divides, with A-Z in lower case."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, Cache(xxhash.xxh3_64_intdigest, 200_000)

    def hashes(self, text: str | None) -> np.ndarray:
        self.known.trim()
        words = (text or "").encode("utf-8", "replace").lower().split()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """The sorted distinct hashes of all runs of so many words; fewer words are one run of their own kind; none for no words."""
        if not len(h):
            return h
        k = min(self.words, len(h))
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total = total + h[i : len(h) - k + 1 + i] * _MIX[i]
        return np.unique(mix(total))

    def __call__(self, text: str | None) -> np.ndarray:
        return self.shingles(self.hashes(text))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The n minima, 32 bits each."""
    low, out = (shingles >> np.uint64(16)).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        out = np.minimum(out, (low[i : i + 4096, None] * _SEEDS[0][:n] + _SEEDS[1][:n]).min(axis=0))
    return out


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, of which the band's number is a part."""
    total = np.arange(bands, dtype=np.uint64) * _MIX[63]
    for i in range(rows):
        total = mix(total + least[i : bands * rows : rows] * _MIX[32 + i])
    return total.view(np.int64)


def packed(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima in 64-bit words."""
    parts = (least & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(-1, 64 // bits) << np.arange(0, 64, bits, dtype=np.uint64)
    return np.bitwise_or.reduce(parts, axis=1).view(np.int64)


def _spread(x, bits: int):
    """Marks in x, at the lowest bit of each field, whether the field isn't zero; on numpy arrays."""
    y, at = x.copy(), 1
    while at < bits:
        y |= x >> np.uint64(at)
        at += 1
    return y & np.uint64(sum(1 << i for i in range(0, 64, bits)))


def equal_fields(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How many fields of the signatures in a (rows) and b (rows) agree, for all pairs of rows."""
    differ = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        differ += np.bitwise_count(_spread(a[:, k, None] ^ b[None, :, k], bits))
    return a.shape[1] * (64 // bits) - differ


def least_equal(fields: int, percent: int = PERCENT, bits: int = BITS) -> float:
    """The least number of agreeing fields that doesn't rule a pair out: chance agreement is corrected for, and MARGIN standard deviations are left."""
    chance, j = 2.0**-bits, percent / 100
    p = j + (1 - j) * chance
    return fields * p - MARGIN * (fields * p * (1 - p)) ** 0.5


def _estimate(a, b, words: int, bits: int):
    """The number of agreeing fields of two array columns of packed signatures."""
    mask = sum(1 << i for i in range(0, 64, bits))
    mask -= (mask >> 63) << 64
    total = F.lit(words * (64 // bits))
    for k in range(words):
        x = a[k].bitwiseXOR(b[k])
        y = x
        for i in range(1, bits):
            y = y.bitwiseOR(F.shiftrightunsigned(x, i))
        total = total - F.bit_count(y.bitwiseAND(F.lit(mask)))
    return total


def _longs(column) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1).view(np.uint64)


@scratch
def near_links(items: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """Links (u, v) that connect what all links of similar items would connect.

    items: id long, bands array<long>, sig array<long>, each id once. sets: gets a DataFrame of distinct ids (id) and returns (id, hashes array<long>).
    An empty table gives no links.
    """
    spark = items.sparkSession
    first = items.select("sig").first()
    if first is None:
        return spark.createDataFrame([], "u long, v long")
    n_sig = len(first.sig)
    need = least_equal(n_sig * (64 // bits), percent, bits)
    keys = items.select("id", F.explode("bands").alias("key"))
    full = written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    total = full.agg(F.sum("c")).first()[0] or 0
    at_once = few(full)
    member = written(keys.join(at_once, "key") if at_once is not full else join_counted(keys, full, "key", total, "id"))
    degree = member.groupBy("id").agg(F.sum("c").alias("d"))
    hubs = written(member.join(degree, "id").groupBy("key").agg((-F.max(F.struct("d", (-F.col("id")).alias("least")))["least"]).alias("hub"), F.count("*").alias("c")))
    star = written(join_counted(member.select("key", "id"), hubs, "key", total, "id").where("id <> hub").select("id", "hub").distinct())
    sig = items.select("id", "sig")
    per_hub = written(star.groupBy("hub").agg(F.count("*").alias("c")))
    pairs = per_hub.agg(F.sum("c")).first()[0] or 0
    touched = written(star.select("id").unionByName(per_hub.select(F.col("hub").alias("id"))).distinct())
    of_hub = lambda rows: written(per_hub.join(rows.withColumnsRenamed({"id": "hub", **{c: "hub_" + c for c in rows.columns if c != "id"}}), "hub"))
    scored = join_counted(star.join(sig, "id"), of_hub(sig), "hub", pairs, "id").select("id", "hub", _estimate(F.col("sig"), F.col("hub_sig"), n_sig, bits).alias("agree"))
    scored = written(scored.where(F.col("agree") >= need))
    best = written(scored.groupBy("id").agg((-F.max(F.struct("agree", (-F.col("hub")).alias("least")))["least"]).alias("hub")))
    # sets come by id, so that their likeliest hub is joined to them there; to join it later would shuffle all sets once more
    sets_and_best = written(sets(touched).join(best, "id", "left"))
    hashes = sets_and_best.select("id", "hashes")
    hub_hashes = of_hub(hashes)
    inter = F.size(F.array_intersect("hashes", "hub_hashes"))
    similar = lambda pairs_: (
        join_counted(pairs_, hub_hashes, "hub", pairs, "id")
        .where(100 * inter >= percent * (F.size("hashes") + F.size("hub_hashes") - inter)).select(F.col("id").alias("u"), F.col("hub").alias("v"))
    )
    linked = written(similar(sets_and_best.where("hub IS NOT NULL")))
    component = written(connected_components(linked))
    of = lambda name: component.select(F.col("id").alias(name), F.col("component").alias("of_" + name))
    apart = scored.join(best, ["id", "hub"], "left_anti").join(of("id"), "id", "left").join(of("hub"), "hub", "left").where(F.coalesce("of_id", "id") != F.coalesce("of_hub", "hub"))
    linked = linked.unionByName(written(similar(apart.select("id", "hub").join(hashes, "id"))))
    drop_written(hub_hashes)

    state = written(member.select("key", "id").join(of("id"), "id", "left").select("key", "id", F.coalesce("of_id", "id").alias("comp")))
    parts = state.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("comps"), F.max(F.struct("n", (-F.col("comp")).alias("least"))).alias("top"))
    # in a bucket of two one is the hub
    parts = parts.where("comps > 1 AND c > 2").select("key", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("n_all"), F.ceil((F.col("c") - F.col("top.n")) / BLOCK).cast("int").alias("n_rest"), (-F.col("top.least")).alias("main"))
    open_ = written(join_counted(state, written(parts), "key", total, "id"))
    where = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    rest = open_.where("comp <> main").select("key", "id", "comp", F.lit(True).alias("rest"), where(F.col("n_rest"), 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    every = open_.select("key", "id", "comp", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)).alias("i"), where(F.col("n_all"), 2).alias("j"))
    dealt = rest.unionByName(every)
    schema = "key long, id long, comp long, rest boolean, i int, j int"

    def likely(pdf: pd.DataFrame) -> pd.DataFrame:
        """The members of a block that have a likely partner of another component in it; a pair counts in the first bucket that it shares."""
        a, b = pdf[pdf.rest], pdf[~pdf.rest]
        if not len(a) or not len(b):
            return pdf.iloc[:0].drop(columns=["sig", "bands"])
        sig_b, bands_b, comp_b, key = _longs(b.sig), _longs(b.bands), b.comp.to_numpy(), np.int64(pdf.key.iloc[0]).view(np.uint64)
        kept_a, kept_b = [], np.zeros(len(b), bool)
        for at in range(0, len(a), AT_ONCE):
            some = a.iloc[at : at + AT_ONCE]
            i, k = np.nonzero((equal_fields(_longs(some.sig), sig_b, bits) >= need) & (some.comp.to_numpy()[:, None] != comp_b[None, :]))
            of_a, of_b = _longs(some.bands)[i], bands_b[k]
            first = of_a[np.arange(len(i)), (of_a == of_b).argmax(axis=1)] == key
            kept_a.append(at + np.unique(i[first]))
            kept_b[k[first]] = True
        return pd.concat([a.iloc[np.concatenate(kept_a)], b[kept_b]]).drop(columns=["sig", "bands"])

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between components, one at most for each two of them in the block, of the pairs that are similar."""
        a, b = pdf[pdf.rest], pdf[~pdf.rest]
        rows = []
        if len(a) and len(b):
            ids, comps = b.id.to_numpy(), b.comp.to_numpy()
            sizes = np.array([len(x) for x in b.hashes])
            flat, owner = np.concatenate(list(b.hashes)), np.repeat(np.arange(len(b)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            done: set[tuple[int, int]] = set()
            for u, comp, mine in zip(a.id, a.comp, a.hashes, strict=True):
                lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(b))
                good = (100 * common >= percent * (len(mine) + sizes - common)) & (comps != comp)
                for k in np.flatnonzero(good):
                    pair = (min(comp, comps[k]), max(comp, comps[k]))
                    if pair not in done:
                        done.add(pair)
                        rows.append((u, ids[k]))
        return pd.DataFrame(rows, columns=["u", "v"]).astype("int64")

    kept = written(dealt.join(items, "id").groupBy("key", "i", "j").applyInPandas(likely, schema))
    more = kept.join(hashes, "id").groupBy("key", "i", "j").applyInPandas(exact, "u long, v long")
    return written(linked.unionByName(more))


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set; the first 64 are its class's id."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8").tolist())


def features(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, bit (see member_bit(), of the id and the text), n_shingles, class key (k1, k2), bands and packed signature of each row; the last four are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, keys, all_bands, sigs = [], [], [], []
            for text in batch.column(2):
                s = shingler(text.as_py())
                n.append(len(s))
                least = minima(s, bands * rows) if len(s) else None
                keys.append(_digest(s) if len(s) else (None, None))
                all_bands.append(band_keys(least, bands, rows) if len(s) else None)
                sigs.append(packed(least, bits) if len(s) else None)
            long_list = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(all_bands, long_list), pa.array(sigs, long_list)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "bit", "n_shingles", "k1", "k2", "bands", "sig"])

    return _marked(docs).mapInArrow(tidy(run), "doc_id long, bit long, n_shingles long, k1 long, k2 long, bands array<long>, sig array<long>")


def _marked(docs: DataFrame) -> DataFrame:
    d, t = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return docs.select(d.alias("d"), member_bit(d, t).alias("bit"), t.alias("t"))


def shingle_sets(docs: DataFrame, wanted: bytes, words: int = WORDS) -> DataFrame:
    """(id, hashes array<long>, sorted) of each row whose bit in wanted (membership()) is set; id is the class's. Texts are read where they are and not shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, marks = Shingler(words), np.frombuffer(table.value, np.uint8)
        for batch in batches:
            bit = batch.column(0).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(marks[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)))
            for at in range(0, batch.num_rows, 512):
                sets = [s for s in (shingler(x.as_py()) for x in batch.column(1).slice(at, 512)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))], names=["id", "hashes"])

    return _marked(docs).select("bit", "t").mapInArrow(tidy(run), "id long, hashes array<long>")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    Linked are documents whose sets of distinct shingles have an intersection of percent / 100 of the union at least. component_id is the smallest doc_id that links
    reach, kept marks its document. A null or empty text, or one of white space alone, has no shingles and is linked with nothing. Rows that repeat a doc_id get one
    row each; they are one document, which all its texts' links connect. A row with a null doc_id is linked
    with nothing, has a null component and is kept. Other columns aren't read. An empty table gives an empty one. Texts are read whole.
    """
    wide = written(features(docs, words, bands, rows, bits))
    linkable = "n_shingles > 0 AND doc_id IS NOT NULL"
    # a class is told by 64 bits; of its rows, the one with the least id stands for it
    stands = F.min(F.struct("doc_id", "bit", "bands", "sig"))
    classes = written(wide.where(linkable).groupBy("k1").agg(F.count("*").alias("c"), stands.alias("s")).select(F.col("k1").alias("id"), "c", "s.*"))
    # from here on, only classes need bands and signatures
    found = written(wide.select("doc_id", "n_shingles", "k1"))
    drop_written(wide)
    real = found.where(linkable)
    # an id that repeats with different texts stands in several classes, and ties them
    several = real.groupBy("doc_id").agg(F.min("k1").alias("v"), F.max("k1").alias("u")).where("u <> v").select("doc_id", "v")
    ties = written(real.select("doc_id", "k1").join(few(written(several)), "doc_id").where("k1 <> v").select(F.col("k1").alias("u"), "v").distinct())

    def sets(touched: DataFrame) -> DataFrame:
        wanted = membership(classes.join(touched, "id").select("bit"))
        return shingle_sets(docs, wanted, words).join(few(touched), "id", "left_semi").dropDuplicates(["id"])

    links = near_links(classes.select("id", "bands", "sig"), sets, percent, bits).unionByName(ties)
    component = connected_components(links)
    of = classes.select("id", "c", "doc_id").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = written(of.join(least, "component").select(F.col("id").alias("k1"), "c", "component_id"))
    total = of.agg(F.sum("c")).first()[0] or 0
    linked = join_counted(real.select("doc_id", "n_shingles", "k1"), of, "k1", total, "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = found.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
