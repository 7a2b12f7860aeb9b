"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON; in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Types of arguments, and what schema_of_variant() says of such values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def canonical(json):
    """The same JSON with sorted keys and without white space; null if it is none, or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (long): 0 for a call that needs no other, else one more than the highest of those it needs; null for what needs itself or a missing call, directly or through others.

    calls: conv_id, call_id, needs array<string>; rows that repeat a key are one call with the needs of all. An empty table gives an empty one; other columns aren't read.

    An edge u, v, w says that u lies w levels above v at least; without v, above none. Each round replaces v by its level if that is known, or by what v itself needs if that is one call, so a
    chain takes as many rounds as its length has binary digits. Calls that need several others wait for these. Each round is a written table, joined by conversation and call, so a long
    conversation is dealt out like many short ones; only counts come to the driver.
    """
    nodes = written(calls.select("conv_id", "call_id").distinct())
    needs = F.explode(F.coalesce("needs", F.array().cast("array<string>")))
    edges = written(calls.select("conv_id", F.col("call_id").alias("u"), needs.alias("v")).distinct().withColumn("w", F.lit(1).cast("long")))
    done = nodes.join(edges.select("conv_id", F.col("u").alias("call_id")), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long"))
    most, mark = nodes.count(), None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("conv_id", "u", "v", "w").cast("decimal(38,0)"))).first()
        if not found.n or found == mark:
            return nodes.join(done, ["conv_id", "call_id"], "left")
        mark = found
        one = F.count("*") == 1
        after = edges.groupBy("conv_id", F.col("u").alias("v")).agg(F.when(one, F.max("v")).alias("x"), F.when(one, F.max("w")).alias("more"))
        known = done.select("conv_id", F.col("call_id").alias("v"), F.lit(None).cast("string").alias("x"), F.col("level").alias("more"), F.lit(True).alias("settled"))
        met = edges.join(known.unionByName(after.withColumn("settled", F.lit(False))), ["conv_id", "v"], "left")
        new = F.when(~F.col("settled"), F.coalesce("x", "v")).otherwise(F.lit(None))
        lost = F.coalesce((F.col("v").isNotNull() & F.col("settled").isNull()) | (new == F.col("u")), F.lit(False)) | (F.col("w") > most)  # a path longer than there are calls is a cycle
        step = written(met.select("conv_id", "u", new.alias("v"), (F.col("w") + F.coalesce("more", F.lit(0).cast("long"))).alias("w"), lost.alias("lost")))
        each = written(step.groupBy("conv_id", "u").agg(F.count("v").alias("n_open"), F.max("w").alias("level"), F.max("lost").alias("lost")).where("NOT lost"))
        done = done.unionByName(each.where("n_open = 0").select("conv_id", F.col("u").alias("call_id"), "level"))
        edges = written(step.join(each.where("n_open > 0").select("conv_id", "u"), ["conv_id", "u"], "left_semi").groupBy("conv_id", "u", "v").agg(F.max("w").alias("w")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: conv_id, call_id, name, level, linked, valid and json.

    calls: conv_id, call_id, name, arguments (JSON), needs array<string> (ids of calls of the conversation whose results it uses). results: conv_id, call_id, content. schemas: name, field, type
    (a key of TYPES), required boolean. linked: a result with the call's id is there; json is {"arguments":..,"id":..,"name":..,"result":..} in canonical form, with null for what is missing.
    valid: the arguments are a JSON object that has all required fields, has fields of the schema only, each of its type, the tool has a schema, and the call can be ordered. Of rows that repeat a
    call's or a result's key the least counts. A null key links with nothing, and its call isn't listed. Extra columns aren't read. Empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    each = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("name", "arguments", "needs")).alias("c")).select(*key, "c.*")
    each = written(each.withColumn("v", F.try_parse_json("arguments")).withColumn("arguments", F.to_json("v")).drop("v"))
    answered = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(F.min(F.coalesce("content", F.lit(""))).alias("result"))

    fields = schemas.select("name", "field", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("required", F.lit(False)).alias("required")).dropDuplicates(["name", "field"])
    tools = fields.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("field", "type"))).alias("types"), F.collect_list(F.when(F.col("required"), F.col("field"))).alias("must"))
    # from_json reads one level: keys, and each value as JSON text or as a plain string; its kind comes from the variant of the value
    checked = each.join(tools, "name", "left").withColumn("is_object", F.coalesce(F.col("arguments").startswith("{"), F.lit(False)))
    of = F.map_entries(F.from_json(F.when(F.col("is_object"), F.col("arguments")), "map<string,variant>"))
    kinds = F.transform(of, lambda x: F.struct(x["key"].alias("key"), F.schema_of_variant(x["value"]).alias("kind")))
    pattern = lambda t: F.coalesce(*(F.when(t == name, F.lit(f"^({p})$")) for name, p in TYPES.items()), F.lit("^$"))
    fits = F.forall(kinds, lambda x: F.coalesce(F.regexp_like(F.coalesce(x["kind"], F.lit("VOID")), pattern(F.get(F.map_values(F.map_filter("types", lambda k, _: k == x["key"])), F.lit(0)))), F.lit(False)))
    has_all = F.size(F.array_except("must", F.transform(of, lambda x: x["key"]))) == 0
    checked = checked.withColumn("fits", F.coalesce(F.col("is_object") & F.col("types").isNotNull() & has_all & fits, F.lit(False))).select(*key, "name", "arguments", "fits")
    joined = checked.join(levels(each), key).join(answered, key, "left")
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"^\{\"x\":(.*)\}$", 1), F.lit("null"))
    text = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    json = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), text("result"), F.lit("}"))
    return joined.select(*key, "name", "level", F.col("result").isNotNull().alias("linked"), (F.col("fits") & F.col("level").isNotNull()).alias("valid"), json.alias("json"))
