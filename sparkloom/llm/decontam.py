"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of each window of ten words, documents and benchmark items keep the least hash of its 5-word runs, its fingerprint. Equal windows have equal fingerprints, so every
shared span of ten words is seen. Documents that share a fingerprint with an item are looked at again: only windows with such a fingerprint are extended
to their words, and these are joined with the items' windows. An item with fewer words is one window of its own length; documents are hashed at each
such length that the benchmark has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, keyed, keys_of, written

WINDOW, GRAM = 10, 5
#: Word characters: digits, ASCII letters and everything beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _positions(n: Column, width: int) -> Column:
    """0 to n - width; none if n < width."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def fingerprints(hashes: Column, grams: Column, width: int, gram: int) -> Column:
    """The fingerprint of each window of width words. hashes: of the words; grams: of the runs of gram words."""
    n = F.size(hashes)
    if width <= gram:
        return F.transform(_positions(n, width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))
    return F.transform(_positions(n, width), lambda i: F.least(*(F.get(grams, i + k) for k in range(width - gram + 1))))


def _hashed(rows: DataFrame, gram: int) -> DataFrame:
    """rows (.., words) with w, the words' hashes, and g, those of the runs."""
    with_w = rows.withColumn("w", F.transform("words", lambda w: F.xxhash64(w)))
    return with_w.withColumn("g", F.transform(_positions(F.size("w"), gram), lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(gram)))))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(d, h, starts array<int>, widths array<int>, items array<string>): the places of the windows in a document that are windows of an item, and the items' ids; for d and h see keys_of().

    docs (doc_id, text), benchmark (item_id, text). Documents without such windows aren't listed, so those with a null text aren't; a null item id is left out. Rows that repeat an id with
    different texts are different documents. Other columns aren't read.
    """
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), words_of(benchmark["text"]).alias("words")).where("size(words) > 0 AND item_id IS NOT NULL")
    items = _hashed(items, gram).withColumn("width", F.least(F.size("words"), F.lit(window)))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # as many as a window has words, at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "d string, h long, starts array<int>, widths array<int>, items array<string>")
    pick = lambda f: F.coalesce(*(F.when(F.col("width") == w, f(w)) for w in widths))
    prints = lambda w: fingerprints(F.col("w"), F.col("g"), w, gram)
    index = items.select("item_id", "words", "width", F.posexplode(pick(prints)).alias("at", "print"))
    index = written(index.select("item_id", "width", "print", F.array_join(F.slice("words", F.col("at") + 1, F.col("width")), " ").alias("window")))
    seen = few(index.select("width", "print").distinct())
    found = index.groupBy("width", "window").agg(F.collect_set("item_id").alias("items"))
    found = few(found)

    source = keyed(docs)
    worded = lambda rows: _hashed(rows.select("d", "h", words_of(F.col("text")).alias("words"), *(c for c in rows.columns if c not in ("d", "h", "text"))), gram)
    each = F.array(*(F.struct(F.lit(w).alias("width"), F.array_distinct(prints(w)).alias("prints")) for w in widths))
    shared = worded(source).select("d", "h", F.explode(each).alias("x")).select("d", "h", "x.width", F.explode("x.prints").alias("print")).join(seen, ["width", "print"], "left_semi")
    shared = written(shared.groupBy("d", "h").agg(F.collect_set(F.struct("width", "print")).alias("shared")))

    again = worded(source.join(few(shared), ["d", "h"]))
    place = lambda w: F.transform(F.filter(F.arrays_zip(_positions(F.size("w"), w).alias("at"), prints(w).alias("print")), lambda x: F.array_contains(F.col(f"p{w}"), x["print"])), lambda x: F.struct(x["at"].alias("at"), F.lit(w).alias("width")))
    of_width = lambda w: F.transform(F.filter("shared", lambda x: x["width"] == w), lambda x: x["print"])
    again = again.withColumns({f"p{w}": of_width(w) for w in widths})
    places = again.select("d", "h", "words", F.explode(F.concat(*(place(w) for w in widths))).alias("x")).select("d", "h", "x.at", "x.width", F.array_join(F.slice("words", F.col("x.at") + 1, F.col("x.width")), " ").alias("window"))
    exact = places.join(found, ["width", "window"]).select("d", "h", "at", "width", "items")
    spans = F.array_sort(F.collect_set(F.struct("at", "width")))
    merged = exact.groupBy("d", "h").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return merged.select("d", "h", F.col("spans.at").alias("starts"), F.col("spans.width").alias("widths"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items array<string>, contaminated of each row of docs; n_hit counts the words inside any occurrence of an item's window.

    A null text has no words. Repeated rows get a row each, null ids are one id, an empty benchmark gives no hits, and an empty table gives an empty one.
    """
    found = hits(docs, benchmark, window, gram)
    # starts ascend, and so do the ends of the spans united so far; a span adds the words beyond them
    covered = F.aggregate(
        F.arrays_zip("starts", "widths"),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["to"], x["starts"] + x["widths"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["starts"] + x["widths"] - F.greatest(s["to"], x["starts"]))).alias("n")),
        lambda s: s["n"],
    )
    found = written(found.select("d", "h", covered.alias("n_hit"), "items"))
    d, h = keys_of(docs)
    counted = docs.select(docs["doc_id"], d.alias("d"), h.alias("h"), F.size(words_of(docs["text"])).cast("long").alias("n_words"))
    joined = counted.join(few(found), ["d", "h"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))
