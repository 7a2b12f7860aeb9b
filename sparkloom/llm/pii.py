"""Personal data: patterns, and words that give away what the patterns found; in DataFrame operations only.

The patterns' matches are the protected entities. A word discloses an entity as far as seeing the word in a document tells that the entity is there: pointwise mutual information
log2(p(word, entity) / (p(word) p(entity))), estimated from counts of whole documents over the corpus, against the entity's own information log2(1 / p(entity)). Words that give at least a
stated share of it, in two documents or more, are marked wherever they stand in documents that hold the entity, and generalised by sanitise().

Entities that stand in the same documents are alike in all these counts, and so are words, so counts are made for classes of them: a document that lists many entities and words that stand
only there and in its copies has one pair to count. And a word that stands in more documents than n ** share * N ** (1 - share), for an entity in n of N, can't disclose it; such pairs aren't made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import few, free, keyed, keys_of, written

#: What finds the matches that the plain patterns would find. A run of characters that fails at its start fails at every later place in it, so matches begin at a run's start
#: or where the match before ended, and no part of a run is given back: no text takes quadratic time or deep recursion.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Letters that aren't part of a larger sign, such as an address.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}++(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
SHARE = 0.9
SUPPORT = 2


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether 12 to 19 digits pass the check sum. Other strings give false."""
    digits = _digits(x)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.when(F.length(digits).between(12, 19), F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0).otherwise(False)


def _valid(kind: Column, x: Column) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return F.when(kind == "ip", ip).when(kind == "card", _luhn(x)).when(kind == "phone", F.length(_digits(x)).between(9, 15)).otherwise(True)


def mentions(docs: DataFrame) -> DataFrame:
    """The valid matches: d, h, kind, kind_no, start, end (code points, end exclusive) and value; see keyed(). Rows that repeat id and text count once; a null text has no matches."""
    source = keyed(docs)

    def of(no: int, kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.struct(F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), found.alias("found"))

    per_kind = source.select("d", "h", "text", F.explode(F.array(*(of(no, kind, p) for no, (kind, p) in enumerate(KINDS.items())))).alias("x")).where("size(x.found) > 0").select("d", "h", "text", "x.*")
    between = F.coalesce(*(F.when(F.col("kind") == kind, F.split("text", p, -1)) for kind, p in KINDS.items()))
    rows = per_kind.select("d", "h", "kind_no", "kind", F.posexplode(_between(F.col("found"), between)).alias("k", "x")).select("d", "h", "kind_no", "kind", "k", "x.*")
    placed = _placed(rows.dropDuplicates(["d", "h", "kind_no", "k"]), "d", "h", "kind_no")
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("d", "h", "kind", "kind_no", "start", "end", "value")


def _between(found: Column, between: Column) -> Column:
    """Structs (value, skip) of matches and the numbers of characters that stand before each, from the one before it on."""
    return F.arrays_zip(found.alias("value"), F.transform(between, lambda x: F.length(x)).alias("skip"))


def _placed(rows: DataFrame, *key: str) -> DataFrame:
    """rows (key, k, value, skip) with start and end, but for the rows of the text after the last match."""
    upto = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("value IS NOT NULL").withColumn("end", F.sum(F.col("skip") + F.length("value")).over(upto))
    return rows.withColumn("start", F.col("end") - F.length("value"))


def disclosing(docs: DataFrame, base: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """d, h, start, end of the words of docs that disclose an entity of base (mentions()) that their document holds. Documents count by rows, copies of a text as several."""
    texts = keyed(docs)
    total = texts.count()
    same = [F.bit_xor(F.xxhash64("d", "h")).alias("x1"), F.bit_xor(F.xxhash64("h", "d")).alias("x2")]
    of = base.select("d", "h", F.xxhash64("kind", F.lower("value")).alias("entity")).distinct()
    entities = of.groupBy("entity").agg(F.count("*").alias("n_entity"), *same).where((F.col("n_entity") >= support) & (F.col("n_entity") < total))
    entities = written(entities.select("entity", "n_entity", F.xxhash64("n_entity", "x1", "x2").alias("e")))
    held = written(of.join(few(entities), "entity").select("d", "h", "e", "n_entity").distinct())

    term = lambda w: F.xxhash64(F.lower(w))
    listed = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    distinct_terms = F.explode(F.array_distinct(F.transform(listed, term))).alias("term")
    holders = few(written(held.select("d", "h").distinct()))
    own = written(texts.join(holders, ["d", "h"], "left_semi").select("d", "h", distinct_terms).distinct())
    often = written(own.groupBy("term").agg(F.count("*").alias("n_own"), *same).where(F.col("n_own") >= support))
    every = texts.select(distinct_terms).join(few(often.select("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    # rows that repeat id and text count once in n_own
    terms = often.join(every, "term").withColumn("n_term", F.greatest("n_term", "n_own"))
    terms = written(terms.select("term", "n_term", F.xxhash64("n_own", "n_term", "x1", "x2").alias("t")))
    mine = written(own.join(few(terms), "term"))

    most = F.pow("n_entity", F.lit(share)) * float(total) ** (1 - share) * 1.000001
    met = written(held.join(mine.select("d", "h", "t", "n_term").distinct(), ["d", "h"]).where(F.col("n_term") <= most))
    told = F.log2(F.col("n_both") * float(total) / (F.col("n_term") * F.col("n_entity")))
    flagged = met.groupBy("e", "t", "n_entity", "n_term").agg(F.count("*").alias("n_both")).where((F.col("n_both") >= support) & (told >= share * F.log2(float(total) / F.col("n_entity"))))
    tell = met.join(few(written(flagged.select("e", "t"))), ["e", "t"], "left_semi").select("d", "h", "t").distinct()
    marked = written(mine.join(tell, ["d", "h", "t"], "left_semi").select("d", "h", "term"))

    where = few(written(marked.select("d", "h").distinct()))
    words = texts.join(where, ["d", "h"], "left_semi").select("d", "h", F.posexplode(_between(listed, F.split("text", TERM, -1))).alias("k", "x")).select("d", "h", "k", "x.*")
    placed = _placed(words.dropDuplicates(["d", "h", "k"]), "d", "h")
    return placed.withColumn("term", term(F.col("value"))).join(marked, ["d", "h", "term"], "left_semi").select("d", "h", "start", "end")


def spans(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """d, h, kind_no, kind, start, end: the patterns' spans and those of disclosing words (kind term), for documents that have any; see keyed()."""
    base = written(mentions(docs))
    terms = disclosing(docs, base, share, support).select("d", "h", F.lit(len(KINDS)).alias("kind_no"), F.lit("term").alias("kind"), "start", "end")
    return base.select("d", "h", "kind_no", "kind", "start", "end").unionByName(terms)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def found_spans(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """doc_id and found, an array of (start, kind_no, end, kind) in that order, of each row of docs (doc_id, text).

    A null or empty text has none. Rows that repeat get a row each; null ids are kept, and are one id. Base kinds are found one by one and may overlap; words never overlap with
    them. Other columns aren't read. An empty table gives an empty one.
    """
    each = spans(docs, share, support).groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind"))).alias("found"))
    d, h = keys_of(docs)
    joined = docs.select(docs["doc_id"], d.alias("d"), h.alias("h")).join(few(written(each)), ["d", "h"], "left")
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    return joined.select("doc_id", F.coalesce("found", none).alias("found"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row."""
    found = found_spans(docs)
    base = F.filter("found", lambda x: x["kind"] != "term")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def sanitise(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """docs with each span in text replaced by its kind, as <EMAIL> or <TERM>; where spans overlap, the later ones go. All rows and columns stay, whatever the columns' names; other texts don't change.

    An n_chars column gets the new length. A null or empty text stays as it is, repeated rows and null ids are treated as in found_spans(), an empty table gives an empty one.
    """
    each = spans(docs, share, support)
    before = Window.partitionBy("d", "h").orderBy("start", "kind_no", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    listed = written(each.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "from", "kind"))).alias("found")))
    d, h, found = free(docs.columns, "d", "h", "found")
    listed = few(listed).select(F.col("d").alias(d), F.col("h").alias(h), F.col("found").alias(found))
    at_d, at_h = keys_of(docs)
    joined = docs.join(listed, (at_d == F.col(d)) & (at_h == F.col(h)), "left")
    text = docs["text"]
    piece = lambda x: F.when(x["start"] >= x["from"], F.concat(F.substring(text, (x["from"] + 1).cast("int"), (x["start"] - x["from"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")
    last = F.array_max(F.transform(found, lambda x: x["end"])).cast("int")
    new = F.when(F.col(found).isNull(), text).otherwise(F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, last + 1, F.length(text))))
    changed = {"text": new} | ({"n_chars": F.when(F.col(found).isNull(), docs["n_chars"]).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*(changed[c].alias(c) if c in changed else docs[c] for c in docs.columns))
