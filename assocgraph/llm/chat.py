"""Chat formatting: tool calls linked to their results, ordered, validated and serialised. DataFrame functions only.

A turn gives items, each a call or a result with an identifier:

* a turn whose text is a JSON object with `tool_calls` gives a call for each (id, name, arguments; or under `function`);
* a turn of the role `tool` gives the result of the call named by `tool_call_id` in its JSON object (content: `content`);
* otherwise a turn of the assistant is the result that answers the turn before it, and any other turn is a call of the tool
  `reply` with its role, text and turn number as arguments. The identifier is `<conv_id>-<turn>` of the asking turn.

Calls and results are joined by conversation and identifier. The level is the place in a topological order: 0 for a call
that waits for nothing, one more than its call for a result, one more than the latest result for a call that names others
in `depends_on`. Items sorted by (level, turn, position) are in an order in which everything comes after what it needs.
Arguments are validated against schemas (required names, types, permitted values), and every item is canonical JSON: sorted
keys, no white space, numbers as Spark's variants write them.

No conversation is ever collected: every step is a join or aggregation by conversation and identifier.

Defined results: null texts count as empty; a null conv_id is a conversation of its own; a result before its call, without
an identifier, or of an unknown one is not linked; of several calls with one identifier the earliest turn counts for the
link, of several results the latest; calls that wait for each other in a circle, or for those, have a null level, and so have their results; names
in `depends_on` that no call has are no hindrance; rows that repeat give items each; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Schemas of tools: required names, types of properties, permitted values.
SCHEMAS = {"reply": {"required": ("role", "text", "turn"), "types": {"role": "string", "text": "string", "turn": "integer"}, "values": {"role": ("system", "user")}, "filled": ("text",)}}
#: How the types of variants begin, for each type of a schema.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def quoted(col: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(col)), r"\A\[|\]\z", "")


def canonical(variant: Column) -> Column:
    """JSON with sorted keys and no white space; `null` for nothing."""
    return F.coalesce(F.to_json(variant), F.lit("null"))


def items(turns: DataFrame) -> DataFrame:
    """ckey, conv_id, turn, position, kind, id, name, arguments (variant), body (canonical JSON), depends_on."""
    own = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ckey"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parsed = own.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    parsed = parsed.withColumn("calls", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')"))
    arguments = F.expr("coalesce(try_variant_get(c, '$.arguments', 'variant'), try_variant_get(c, '$.function.arguments', 'variant'))")
    asked = F.concat_ws("-", "ckey", F.col("turn").cast("string"))
    answered = F.concat_ws("-", "ckey", (F.col("turn") - 1).cast("string"))
    plain = F.parse_json(F.to_json(F.struct("role", "text", F.col("turn").alias("turn"))))
    none, no_names = F.lit(None).cast("variant"), F.lit(None).cast("string")

    # one item for each turn, or for each of its tool calls
    split = parsed.select("*", F.posexplode_outer(F.when(F.size("calls") > 0, F.col("calls"))).alias("position", "c"))
    named = split.withColumn("raw", arguments).withColumn("raw", F.when(F.expr("schema_of_variant(raw) = 'STRING'"), F.coalesce(F.try_parse_json(F.expr("try_variant_get(raw, '$', 'string')")), F.col("raw"))).otherwise(F.col("raw")))
    called, tool, answers = F.col("c").isNotNull(), F.col("role") == "tool", F.col("role") == "assistant"
    return named.select(
        "ckey",
        "conv_id",
        "turn",
        F.coalesce("position", F.lit(0)).alias("position"),
        F.when(called, "call").when(tool | answers, "result").otherwise("call").alias("kind"),
        F.when(called, F.expr("try_variant_get(c, '$.id', 'string')")).when(tool, F.expr("try_variant_get(v, '$.tool_call_id', 'string')")).when(answers, answered).otherwise(asked).alias("id"),
        F.when(called, F.expr("coalesce(try_variant_get(c, '$.name', 'string'), try_variant_get(c, '$.function.name', 'string'))")).when(tool | answers, no_names).otherwise("reply").alias("name"),
        F.when(called, F.col("raw")).when(tool | answers, none).otherwise(plain).alias("arguments"),
        F.when(called, canonical(F.col("raw"))).when(tool, F.coalesce(F.to_json(F.expr("try_variant_get(v, '$.content', 'variant')")), quoted(F.col("text")))).when(answers, quoted(F.col("text"))).otherwise(canonical(plain)).alias("body"),
        F.when(called, F.expr("try_variant_get(raw, '$.depends_on', 'array<string>')")).alias("depends_on"),
    )


def violations(schemas: dict) -> Column:
    """What is wrong with a call's arguments: an array of strings, empty if they are valid; `unknown tool` without a schema."""
    out = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        get = lambda key: F.expr(f"try_variant_get(arguments, '$.{key}', 'variant')")
        checks = [F.when(get(k).isNull(), F.lit(f"{k} missing")) for k in schema.get("required", ())]
        for k, kind in sorted(schema.get("types", {}).items()):
            checks.append(F.when(get(k).isNotNull() & ~F.schema_of_variant(get(k)).rlike(f"^({KINDS[kind]})"), F.lit(f"{k} not {kind}")))
        for k, values in sorted(schema.get("values", {}).items()):
            got = F.expr(f"try_variant_get(arguments, '$.{k}', 'string')")
            checks.append(F.when(got.isNotNull() & ~got.isin(*values), F.lit(f"{k} not permitted")))
        for k in schema.get("filled", ()):
            checks.append(F.when(F.expr(f"try_variant_get(arguments, '$.{k}', 'string')") == "", F.lit(f"{k} empty")))
        out = F.when(F.col("name") == tool, F.filter(F.array(*checks), lambda x: x.isNotNull())).otherwise(out)
    return out


def call_levels(calls: DataFrame) -> DataFrame:
    """ckey, id, level of the calls that wait for others; a null level in or behind a circle.

    calls: ckey, id, depends_on. Each round settles the calls whose names are all settled.
    """
    known = calls.select("ckey", "id").distinct()
    waits = calls.filter(F.size("depends_on") > 0).select("ckey", "id", F.explode("depends_on").alias("other")).distinct()
    waits = durable(waits.join(known.select("ckey", F.col("id").alias("other")), ["ckey", "other"]))
    waiting = waits.select("ckey", "id").distinct()
    settled = calls.sparkSession.createDataFrame([], "ckey string, id string, level int")
    if not waits.head(1):
        return settled
    settled = durable(known.join(waiting, ["ckey", "id"], "left_anti").withColumn("level", F.lit(0)))
    done = -1
    while (now := settled.count()) != done:
        done = now
        seen = waits.join(settled.select("ckey", F.col("id").alias("other"), "level"), ["ckey", "other"], "left")
        ready = seen.groupBy("ckey", "id").agg((F.max("level") + 2).alias("level"), F.max(F.col("level").isNull()).alias("open")).filter("NOT open").drop("open")
        settled = durable(settled.unionByName(ready.join(settled.select("ckey", "id"), ["ckey", "id"], "left_anti")))
    return waiting.join(settled, ["ckey", "id"], "left")


def link(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, position, kind, id, name, linked, valid (true for results), violations, level, json for each item."""
    rows = items(turns)
    calls = rows.filter("kind = 'call' AND id IS NOT NULL")
    first_calls = calls.groupBy("ckey", "id").agg(F.min("turn").alias("call_turn"))
    first_results = rows.filter("kind = 'result' AND id IS NOT NULL").groupBy("ckey", "id").agg(F.max("turn").alias("result_turn"))
    # calls and results by identifier, and the levels of the calls that wait
    links = first_calls.join(first_results, ["ckey", "id"], "left").join(call_levels(calls.select("ckey", "id", "depends_on")).withColumn("waits", F.lit(True)), ["ckey", "id"], "left")
    links = links.select("ckey", "id", "call_turn", "result_turn", F.when(F.col("waits"), F.col("level")).otherwise(0).alias("call_level"))
    joined = rows.join(links, ["ckey", "id"], "left").withColumn("violations", F.when(F.col("kind") == "call", violations(schemas)))
    call = F.col("kind") == "call"
    linked = F.coalesce(F.when(call, F.col("result_turn") > F.col("turn")).otherwise(F.col("call_turn") < F.col("turn")), F.lit(False))
    head = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    name_or_null = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    as_call = F.concat(F.lit("{"), F.concat_ws(",", head("arguments", F.col("body")), head("id", name_or_null("id")), head("name", name_or_null("name")), F.lit('"type":"call"')), F.lit("}"))
    as_result = F.concat(F.lit("{"), F.concat_ws(",", head("content", F.col("body")), head("id", name_or_null("id")), F.lit('"type":"result"')), F.lit("}"))
    return joined.select(
        "conv_id",
        "turn",
        "position",
        "kind",
        "id",
        "name",
        linked.alias("linked"),
        F.coalesce(F.size("violations") == 0, F.lit(True)).alias("valid"),
        F.array_join("violations", "; ").alias("violations"),
        F.when(call, F.when(F.col("call_turn").isNull(), 0).otherwise(F.col("call_level"))).when(linked, F.col("call_level") + 1).otherwise(0).alias("level"),
        F.when(call, as_call).otherwise(as_result).alias("json"),
    )
