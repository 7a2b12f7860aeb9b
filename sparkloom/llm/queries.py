"""A query for each operator over its whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, license, neardup, pii, substring, tokenfile, toxicity
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a user is a call with the turn and its text as arguments, which needs the call two turns before it, if there is one; the assistant's next turn is its result."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = turns.where("role = 'user'")
    before = said.select("conv_id", (F.col("turn") + 2).alias("turn"), F.array(F.col("turn").cast("string")).alias("needs")).distinct()
    calls = said.join(before, ["conv_id", "turn"], "left").select("conv_id", F.col("turn").cast("string").alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"), "needs")
    results = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame([("reply", "turn", "integer", True), ("reply", "text", "string", True)], "name string, field string, type string, required boolean")
    found = chat.link_calls(calls, results, schemas)
    return found.select("conv_id", "call_id", "name", F.col("level").cast("int").alias("level"), "linked", "valid", F.sha2("json", 256).alias("json_sha256"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_digests(tokenfile.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS win FROM b, unnest(range(len(w) - least(len(w), 10) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM items),
wins AS (SELECT doc_id, k, i AS pos, array_to_string(w[i + 1:i + k], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, sizes)),
hit AS (SELECT doc_id, pos, k, item_id FROM wins JOIN items USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT doc_id, pos, k FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_bpe, op2_minhash, op3_license, op4_passages, op5_toxicity, op6_token_file, op7_chat, op8_winnowing, op9_hnsw, op10_pii)}
OP7_SQL = """
WITH RECURSIVE u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
lv AS (SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2) UNION ALL SELECT u.conv_id, u.turn, lv.level + 1 FROM lv JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2),
c AS (SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, min(to_json(struct_pack("text" := text, turn := turn))) AS arguments, bool_or(text IS NOT NULL) AS has_text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, CAST(turn - 1 AS VARCHAR) AS call_id, min(coalesce(text, '')) AS result FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
SELECT conv_id, call_id, 'reply' AS name, CAST(level AS INTEGER) AS level, result IS NOT NULL AS linked, has_text AS valid,
sha256('{"arguments":' || arguments || ',"id":"' || call_id || '","name":"reply","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}') AS json_sha256
FROM c JOIN (SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, level FROM lv) USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
"""

_OP3_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license.TEMPLATES.items())
OP3_SQL = f"""
WITH src(kind, id, text) AS (SELECT 'd', CAST(doc_id AS VARCHAR), text FROM documents UNION ALL SELECT 't', name, text FROM (VALUES {_OP3_TEMPLATES}) AS t(name, text)),
w AS (SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM src),
g AS (SELECT kind, id, len(w) AS n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS gram FROM (SELECT kind, id, w, unnest(range(greatest(len(w) - 4, 0))) AS pos FROM w)),
t AS (SELECT DISTINCT id AS license, gram, CAST(ceil(n * 1.5 - 4) AS BIGINT) AS span, n_all FROM g JOIN (SELECT id, count(DISTINCT gram) AS n_all FROM g WHERE kind = 't' GROUP BY id) USING (id) WHERE kind = 't'),
m AS (SELECT id, license, span, n_all, pos, t.gram FROM g JOIN t ON g.gram = t.gram WHERE kind = 'd'),
c AS (SELECT a.id, a.license, a.n_all, a.pos, count(DISTINCT b.gram) AS n FROM m a JOIN m b ON a.id = b.id AND a.license = b.license AND b.pos BETWEEN a.pos AND a.pos + a.span - 1 GROUP BY ALL)
SELECT CAST(id AS BIGINT) AS doc_id, license, CAST(max(n) AS INTEGER) AS n_found, CAST(max(n_all) AS INTEGER) AS n_shingles, CAST(arg_min(pos, struct_pack(a := -n, b := pos)) AS INTEGER) AS start
FROM c GROUP BY id, license HAVING max(n) >= 0.75 * max(n_all)
"""
ORACLES: dict[str, str] = {"op3_license": OP3_SQL, "op7_chat": OP7_SQL, "op8_winnowing": OP8_SQL}
