"""Chat formatting: linking tool calls with their results.

Calls and results meet in a hash join on conversation and identifier.  Calls form
chains (each may follow another call); their depth, and with it a topological
order, comes from pointer doubling, so a chain of n calls takes about log2(n)
joins.  Arguments are checked against the tool's schema and written as canonical
JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlark.llm.common import discard, materialize

#: Copies of one row that are made from their count at once.
COPIES_AT_ONCE = 1000
#: Turns of a conversation that are sorted together.
TURNS = 1000

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: object) -> str:
    """Sorted keys, no blanks, characters as they are; like values give like bytes."""
    return _storable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _storable(text: str) -> str:
    """Surrogates without a partner, which no UTF-8 text can hold, stay as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def schema_errors(value: object, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema (type, enum, required, properties, additionalProperties, items, bounds); no value is of an unknown type."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _TYPES.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the allowed values")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{path}: length")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: out of range")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += schema_errors(item, schema["items"], f"{path}[{i}]")
    return out


def _checked(arguments: str | None, name: str | None, schemas: dict[str, dict]) -> tuple[bool, str, str | None]:
    try:
        value = json.loads(arguments or "")
        text = canonical(value)
    except (ValueError, RecursionError):
        return False, "$: no JSON", None
    if name not in schemas:
        return False, "$: no such tool", text
    errors = schema_errors(value, schemas[name])
    return not errors, _storable("; ".join(errors)), text


def _depths(calls: DataFrame) -> DataFrame:
    """Calls' depth below the first of their chain (1), null on a cycle, by pointer doubling.

    ``calls`` has distinct (conv_id, call_id) and ``after``.
    """
    key = ["conv_id", "call_id"]
    here = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    step = materialize(calls.join(here, ["conv_id", "after"], "left").select(*key, F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("n")))
    while True:
        open_, total = step.where("up is not null").count(), step.count()
        # A chain as long as all calls together would be a cycle.
        if open_ == 0 or step.agg(F.max("n")).first()[0] > total:
            return step.select(*key, F.when(F.col("up").isNull(), F.col("n") + 1).alias("depth"))
        above = step.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"))
        after = materialize(step.join(above, ["conv_id", "up"], "left").select(*key, F.col("up2").alias("up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))
        discard(step)
        step = after


def _others(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows that share (conv_id, call_id) with a winner, but for one row like the winner itself.

    The join splits where an identifier is hot.  Rows like the winner are only counted,
    and made anew from the count in pieces.
    """
    key, rest = rows.columns[:2], rows.columns[2:]
    own = winners.select(*key, F.struct(*rest).alias("won"))
    marked = materialize(rows.join(own, key).select(*rows.columns, F.struct(*rest).eqNullSafe(F.col("won")).alias("like")))
    like = marked.where("like").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = like.select("*", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"), F.lit(COPIES_AT_ONCE).cast("long"))).alias("low"))
    copies = pieces.select(*rows.columns, F.explode(F.sequence("low", F.least("n", F.col("low") + COPIES_AT_ONCE - 1))))
    return marked.where(~F.col("like")).select(*rows.columns).unionByName(copies.select(*rows.columns))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call or unmatched result, in a form ready to serialise.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (call_id of
    the call it follows, or null).  ``results``: conv_id, call_id, turn, content.
    Other columns are ignored.  ``status`` is ``linked``, ``unanswered`` (no result),
    ``orphan`` (a result without call), ``duplicate`` (an identifier used again: the
    first by turn, name and arguments counts) or ``anonymous`` (no conversation or
    identifier).  Of several results of one call the first by turn and content is
    linked, the others are orphans.  Every call and result has its row: a linked row
    holds one of each, all others hold one call or one result.  ``copies_of_call`` and
    ``copies_of_result`` count the rows of the identifier; duplicates, the results
    beside the first and anonymous rows count themselves only.  ``depth`` orders calls topologically, null for
    calls on a cycle or behind one, and for calls that aren't linked to an order
    (duplicates, anonymous ones).  ``valid`` and ``errors`` tell whether the arguments
    fit the schema; ``json`` is the call with its result as canonical JSON.
    """
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*key, F.col("turn").cast("long"), "name", "arguments", F.col("after").cast("string"))
    results = results.select(*key, F.col("turn").cast("long").alias("result_turn"), "content")
    calls, results = materialize(calls), materialize(results)
    # An identifier may repeat in very many rows: one row of it is found by aggregation, with a partial result in each task.
    call, result = F.struct("turn", "name", "arguments", "after"), F.struct("result_turn", "content")
    first = calls.where(named).groupBy(*key).agg(F.min(call).alias("c"), F.count(F.lit(1)).alias("n"))
    answer = results.where(named).groupBy(*key).agg(F.min(result).alias("r"), F.count(F.lit(1)).alias("m"))
    joined = first.hint("shuffle_hash").join(answer, key, "full_outer")
    linked = joined.select(*key, "c.turn", "c.name", "c.arguments", "c.after", "r.result_turn", "r.content", F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
                           F.coalesce(F.col("n"), F.lit(0)).alias("copies_of_call"), F.coalesce(F.col("m"), F.lit(0)).alias("copies_of_result"))
    loose = calls.where(~named).selectExpr(*key, "turn", "name", "arguments", "after", "cast(null as bigint) result_turn", "cast(null as string) content", "'anonymous' status", "1L copies_of_call", "0L copies_of_result")
    lost = results.where(~named).selectExpr(*key, "cast(null as bigint) turn", "cast(null as string) name", "cast(null as string) arguments", "cast(null as string) after", "result_turn", "content", "'anonymous' status", "0L copies_of_call", "1L copies_of_result")
    again = _others(calls, first.where("n > 1").select(*key, "c.*")).selectExpr(*key, "turn", "name", "arguments", "after", "cast(null as bigint) result_turn", "cast(null as string) content", "'duplicate' status", "1L copies_of_call", "0L copies_of_result")
    later = _others(results, answer.where("m > 1").select(*key, "r.*")).selectExpr(*key, "cast(null as bigint) turn", "cast(null as string) name", "cast(null as string) arguments", "cast(null as string) after", "result_turn", "content", "'orphan' status", "0L copies_of_call", "1L copies_of_result")
    depth = _depths(first.select(*key, "c.after"))
    apart = loose.unionByName(lost).unionByName(again).unionByName(later)
    rows = linked.join(depth, key, "left").unionByName(apart.withColumn("depth", F.lit(None).cast("long")))

    @F.pandas_udf("valid boolean, errors string, json string")
    def serialise(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for call_id, name, arguments, content, status in parts:
            out = []
            for i, n, a, c, s in zip(call_id, name, arguments, content, status, strict=True):
                valid, errors, _ = (None, None, None) if n is None and a is None else _checked(a, n, schemas)
                given = json.loads(a) if errors != "$: no JSON" and a is not None else a
                out.append((valid, errors, canonical({"id": i, "name": n, "arguments": given, "result": c, "status": s})))
            yield pd.DataFrame(out, columns=["valid", "errors", "json"])

    return rows.withColumn("checked", serialise("call_id", "name", "arguments", "content", "status")).select(
        *key, "turn", "result_turn", "name", "after", "depth", "status", "copies_of_call", "copies_of_result", "checked.valid", "checked.errors", "checked.json")


#: The tool whose calls plain conversations hold: an assistant's reply to what stands before it.
REPLY_SCHEMAS = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "system": {"type": ["string", "null"]}}}}
_CALL = "struct<id: string, name: string, arguments: string, after: string>"


def _json_list(text: Column) -> Column:
    return F.from_json(text, f"struct<tool_calls: array<{_CALL}>, tool_call_id: string, content: string>")


def _with_context(rows: DataFrame) -> DataFrame:
    """Add ``before`` and ``system``: the last ``asked`` and ``told`` of the conversation's rows before; null without a conversation.

    Rows are sorted within ranges of turns, and what a range begins with is carried from those before it, so a long
    conversation is many tasks'.
    """
    rows = rows.withColumn("range", F.floor(F.coalesce("turn", F.lit(0)) / TURNS))
    named = rows.where("conv_id is not null")
    place = F.struct("turn", "role", "text")
    ends = named.groupBy("conv_id", "range").agg(F.max("asked").alias("asked"), F.max_by("told", F.when(F.col("told").isNotNull(), place)).alias("told"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "range", F.last("asked", True).over(earlier).alias("asked0"), F.last("told", True).over(earlier).alias("told0")).where("asked0 is not null or told0 is not null")
    within = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inside = named.withColumns({"b": F.last("asked", True).over(within), "s": F.last("told", True).over(within)}).join(carried, ["conv_id", "range"], "left")
    whole = inside.withColumns({"before": F.coalesce("b", "asked0"), "system": F.coalesce("s", "told0")}).drop("b", "s", "asked0", "told0")
    alone = rows.where("conv_id is null").withColumns({"before": F.lit(None).cast("long"), "system": F.lit(None).cast("string")})
    return whole.unionByName(alone)


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations (conv_id, turn, role, text).

    Each user turn calls ``reply`` with its text, under its turn as identifier, after
    the conversation's user turn before it; an assistant turn is the result of the
    last user turn before it, an answer to none if there is none.  A text that is a
    JSON object with ``tool_calls`` (id, name, arguments, after) or ``tool_call_id``
    and ``content`` holds calls or a result of its own.  Turns that repeat a place
    keep apart only by their text.  Turns without a conversation have none before them.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long"), "role", "text").withColumn("j", F.when(F.ltrim("text").startswith("{"), _json_list(F.col("text"))))
    rows = rows.withColumns({"own": F.col("j.tool_calls").isNull() & F.col("j.tool_call_id").isNull(), "user": F.col("role") == "user"})
    asked = F.when(F.col("user") & F.col("own"), F.col("turn"))
    rows = _with_context(rows.withColumns({"asked": asked, "told": F.when(F.col("role") == "system", F.col("text"))}))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn", "system"))
    prompts = rows.where("user and own").select("conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.col("before").cast("string").alias("after"))
    replies = rows.where("role = 'assistant' and own").select("conv_id", F.col("before").cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    tools = rows.where("j.tool_calls is not null").select("conv_id", "turn", F.explode("j.tool_calls").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "turn", "c.name", "c.arguments", "c.after")
    outcomes = rows.where("j.tool_call_id is not null").select("conv_id", F.col("j.tool_call_id").alias("call_id"), "turn", F.col("j.content").alias("content"))
    return prompts.unionByName(tools), replies.unionByName(outcomes)
