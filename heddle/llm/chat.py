"""Operator 10: tool calls in chats, linked with their results.

Calls and results meet in a hash join by identifier. Calls are ordered so that each follows those
it depends on, arguments are validated against the tools' schemas by joins, and every message is
serialised as canonical JSON (sorted keys, no spaces). No conversation is gathered in one task.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Rows of tool schemas that may be broadcast; with more they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Fixed: names of JSON types by those of Spark's variants.
TYPES = {"BIGINT": "integer", "BOOLEAN": "boolean", "STRING": "string", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, turn, ...) with ``result`` and ``result_turn``, null for a call without
    one. Of several results the earliest counts (ties: the smallest text); so does the earliest of
    calls that repeat an identifier, the others have ``repeated``. Null identifiers link with nothing."""
    calls = shared.stored(calls.withColumn("_row", F.monotonically_increasing_id()), "asked")
    earliest = calls.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "arguments", "_row"))["_row"].alias("_first"))
    first = calls.join(earliest, ["conv_id", "call_id"], "left").withColumn("repeated", F.coalesce(F.col("_row") != F.col("_first"), F.lit(False))).drop("_row", "_first")
    found = results.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    found = found.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"))
    return first.join(found.hint("shuffle_hash"), ["conv_id", "call_id"], "left")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


def layered(calls: DataFrame) -> DataFrame:
    """``calls`` with ``layer``: ordered by (layer, turn), each call follows those in its ``after``.

    Where all of a conversation's dependencies point to earlier turns the turns are such an order,
    and the layer is 0. In other conversations a call's layer is the length of the longest chain of
    dependencies behind it; calls in or behind a cycle get -1. Unknown dependencies don't count.
    Chains of calls with one dependency each are shortened by pointer doubling, in as many rounds as the
    logarithm of the longest; calls with several take a round for each of them on the longest chain.
    """
    edges = calls.filter("NOT repeated").select("conv_id", "call_id", "turn", F.explode("after").alias("dep")).filter("dep IS NOT NULL")
    known = calls.filter("NOT repeated").select("conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"))
    edges = shared.stored(edges.join(known, ["conv_id", "dep"]), "edges")
    tangled = shared.stored(edges.filter("dep_turn >= turn").select("conv_id").distinct(), "tangled")
    if tangled.isEmpty():
        return calls.withColumn("layer", F.lit(0))
    open_edges = shared.stored(edges.join(tangled, "conv_id").select("conv_id", "call_id", "dep").distinct(), "open")
    nodes = calls.filter("NOT repeated").join(tangled, "conv_id").select("conv_id", "call_id").distinct()
    edges = open_edges.withColumn("steps", F.lit(1).cast("long"))
    lone = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("dep"), F.min("steps").alias("steps")).filter("n = 1").drop("n")
    lone = shared.stored(lone, "lone")
    for _ in range(lone.count().bit_length()):
        on = lone.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("to"), F.col("steps").alias("more"))
        jumped = lone.join(on, ["conv_id", "dep"], "left")
        if jumped.filter("to IS NOT NULL").isEmpty():
            break
        lone = shared.stored(jumped.select("conv_id", "call_id", F.coalesce("to", "dep").alias("dep"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "lone")
    # Calls with no or several dependencies, and how many steps lie between them.
    anchors = shared.stored(nodes.join(lone, ["conv_id", "call_id"], "left_anti"), "anchors")
    behind = edges.join(anchors, ["conv_id", "call_id"]).select("conv_id", "call_id", "dep")
    ends = lone.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("to"), "steps")
    behind = behind.join(ends, ["conv_id", "dep"], "left").groupBy("conv_id", "call_id", F.coalesce("to", "dep").alias("dep")).agg((F.max(F.coalesce("steps", F.lit(0))) + 1).alias("steps"))
    behind = shared.stored(behind, "behind")
    done = shared.stored(anchors.join(behind, ["conv_id", "call_id"], "left_anti").withColumn("layer", F.lit(0).cast("long")), "layer")
    fresh = done
    while not fresh.isEmpty():
        settled = done.select("conv_id", F.col("call_id").alias("dep"), F.col("layer").alias("below"))
        found = behind.join(done, ["conv_id", "call_id"], "left_anti").join(settled, ["conv_id", "dep"], "left")
        found = found.groupBy("conv_id", "call_id").agg(F.max(F.col("below") + F.col("steps")).alias("layer"), F.count(F.when(F.col("below").isNull(), 1)).alias("waits"))
        fresh = shared.stored(found.filter("waits = 0").drop("waits"), "layer")
        done = done.unionByName(fresh)
    chained = lone.join(done.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"]).select("conv_id", "call_id", (F.col("layer") + F.col("steps")).alias("layer"))
    done = done.unionByName(chained).withColumn("layer", F.col("layer").cast("int"))
    out = calls.join(done, ["conv_id", "call_id"], "left").join(tangled.withColumn("tangled", F.lit(True)), "conv_id", "left")
    return out.withColumn("layer", F.when(F.col("tangled"), F.coalesce("layer", F.lit(-1))).otherwise(F.lit(0))).drop("tangled")


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``errors``, sorted: not an object, unknown tool, and for parameters missing,
    unknown or of the wrong type. ``schemas``: name, parameter, type (a JSON type), required."""
    small = shared.small(schemas, BROADCAST_ROWS)
    listed = F.broadcast(schemas) if small else schemas
    tools = schemas.select("name").distinct().withColumn("known", F.lit(True))
    rows = shared.stored(calls.withColumn("_call", F.monotonically_increasing_id()), "calls")
    parsed = rows.select("_call", "name", F.from_json("arguments", "map<string,variant>").alias("args"), F.ltrim("arguments").startswith("{").alias("object"))
    parsed = parsed.join(F.broadcast(tools) if small else tools, "name", "left")
    whole = parsed.select("_call", F.when(~F.coalesce("object", F.lit(False)) | F.col("args").isNull(), "arguments are not an object").otherwise(F.when(F.col("known").isNull(), "unknown tool")).alias("error"))
    given = parsed.filter("known").select("_call", "name", F.explode("args").alias("parameter", "value"))
    kind = F.schema_of_variant("value")
    plain = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    kind = F.when(kind.startswith("DECIMAL"), "number").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise(plain[kind])
    checked = given.withColumn("kind", kind).join(listed, ["name", "parameter"], "left")
    fits = (F.col("kind") == F.col("type")) | ((F.col("kind") == "integer") & (F.col("type") == "number"))
    wrong = checked.select("_call", F.when(F.col("type").isNull(), F.concat(F.lit("unknown parameter "), "parameter")).when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("wrong type of "), "parameter")).alias("error"))
    needed = schemas.filter("required").select("name", "parameter")
    missing = parsed.filter("known AND args IS NOT NULL").select("_call", "name", F.map_keys("args").alias("have")).join(F.broadcast(needed) if small else needed, "name")
    missing = missing.filter(~F.array_contains("have", F.col("parameter"))).select("_call", F.concat(F.lit("missing "), "parameter").alias("error"))
    errors = whole.unionByName(wrong).unionByName(missing).filter("error IS NOT NULL").groupBy("_call").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    return rows.join(errors, "_call", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>"))).drop("_call")


class Digits:
    """A number that neither int nor float can hold, as it was written."""

    def __init__(self, text: str):
        self.text = text


def whole(text: str) -> int | Digits:
    return Digits(text) if len(text) > 4000 else int(text)


def fraction(text: str) -> float | Digits:
    return x if math.isfinite(x := float(text)) else Digits(text)


def refused(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def written(x: object) -> str:
    """Canonical JSON of a parsed value."""
    if isinstance(x, dict):
        return "{" + ",".join([json.dumps(k, ensure_ascii=False) + ":" + written(v) for k, v in sorted(x.items())]) + "}"
    if isinstance(x, list):
        return "[" + ",".join([written(v) for v in x]) + "]"
    return x.text if isinstance(x, Digits) else json.dumps(x, ensure_ascii=False, allow_nan=False)


def canonical(column: Column) -> Column:
    """JSON with sorted keys and no spaces; what isn't JSON (NaN and infinities aren't) or nests deeper than
    Python follows, as a JSON string; null stays null. Of keys that repeat the last counts; half a surrogate
    pair, which UTF-8 can't hold, stays an escape. Numbers beyond a double's range and whole ones of thousands of digits stay as they are
    written; others have one form."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            try:
                text = None if x is None else written(json.loads(x, parse_constant=refused, parse_int=whole, parse_float=fraction))
            except (ValueError, RecursionError):
                text = json.dumps(x, ensure_ascii=False)
            out.append(text and re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text))
        return pa.array(out, pa.string())

    return run(column)


def as_json(**parts: Column) -> Column:
    """An object of JSON texts, keys sorted."""
    keys = sorted(parts)
    return F.concat(F.lit("{"), *[x for i, k in enumerate(keys) for x in (F.lit(("," if i else "") + f'"{k}":'), parts[k])], F.lit("}"))


def text_json(text: Column) -> Column:
    """A JSON string, or null."""
    whole = F.to_json(F.struct(text.cast("string").alias("a")))  # {"a":"..."}
    return F.when(text.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def formatted(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each plain message, call, result and orphan result: conv_id, layer, turn, kind,
    call_id, name, errors, json. Ordered by (conv_id, layer, turn, kind) a conversation reads as it
    can be run. Nulls in content become JSON null; repeated rows come back each; empty tables
    give what the others hold."""
    ready = shared.stored(layered(validated(linked(calls, results), schemas)), "ready")
    none = F.lit(None).cast("string")
    call = as_json(arguments=canonical(F.coalesce("arguments", F.lit("null"))), id=text_json(F.col("call_id")), name=text_json(F.col("name")))
    asked = ready.select("conv_id", "layer", "turn", F.lit("1 call").alias("kind"), "call_id", "name", F.array_join("errors", "; ").alias("errors"), as_json(role=F.lit('"assistant"'), tool_calls=F.concat(F.lit("["), call, F.lit("]"))).alias("json"))
    told = lambda df, turn, content, error: df.select("conv_id", "layer", F.col(turn).alias("turn"), F.lit("2 result").alias("kind"), "call_id", "name", F.lit(error).alias("errors"), as_json(role=F.lit('"tool"'), content=text_json(F.col(content)), tool_call_id=text_json(F.col("call_id"))).alias("json"))
    answered = told(ready.filter("result_turn IS NOT NULL AND NOT repeated"), "result_turn", "result", "")
    lost = told(orphans(calls, results).withColumns({"layer": F.lit(0), "name": none}), "turn", "content", "no call")
    plain = messages.select("conv_id", F.lit(0).alias("layer"), "turn", F.lit("0 message").alias("kind"), none.alias("call_id"), none.alias("name"), F.lit("").alias("errors"), as_json(role=text_json(F.col("role")), content=text_json(F.col("text"))).alias("json"))
    return plain.unionByName(asked).unionByName(answered).unionByName(lost)


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plain messages, calls, results and schemas from a table without tool calls: a user's turn asks
    a tool by the length of its text, the assistant's next turn is the result. Of four such turns the
    first depends on the second, which comes later, the third on both and the fourth on the third. Every
    eleventh length gives arguments that break the schema."""
    ident = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "summarise").otherwise("translate")
    limit = F.when(n % 11 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    arguments = F.concat(F.lit('{"query": '), text_json(F.col("text")), F.lit(', "limit": '), limit, F.lit("}"))
    place, at = F.floor(F.col("turn") / 2) % 4, lambda k: ident(F.col("turn") + 2 * k)
    after = F.when(place == 0, F.array(at(1))).when(place == 2, F.array(at(-1), at(-2))).when(place == 3, F.array(at(-1))).otherwise(F.array().cast("array<string>"))
    calls = conversations.filter("role = 'user'").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = conversations.filter("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    plain = conversations.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    tools = [(t, p, k, True) for t in ("search", "summarise", "translate") for p, k in (("query", "string"), ("limit", "integer"))]
    return plain, calls, results, conversations.sparkSession.createDataFrame(tools, "name string, parameter string, type string, required boolean")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(*derived(shared.table(spark, sf_dir, "conversations")))
