r"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON.

* ``calls`` (conv_id, turn, call_id, name, arguments JSON, refs array of call ids) and ``results`` (conv_id,
  turn, call_id, content) are joined by (conv_id, call_id), a shuffle join that Spark may split where one
  conversation is hot. Every pair of a call and a result of its identifier is a row, and ``n_results`` tells how many
  results the identifier has.
* Order: a call comes after the calls that it refers to, and a result after its call. A call's level is its
  turn; only in conversations where a reference does not point to a lower turn, calls get new levels: a call all of whose references have
  levels gets the highest of them plus one, or its turn. Sorting by
  (level, turn) is then a topological order. Calls on or behind a cycle are left over: their level is null.
* Arguments are checked against a schema per tool name (a subset of JSON Schema: type, properties, required,
  additionalProperties, enum, minimum, maximum, minLength, maxLength, items).
* Canonical JSON: keys sorted by code point, no blanks, non-ASCII characters as they are; of equal keys the last one stands.
  Strict JSON only: NaN, infinite numbers (1e400 too), lone surrogates and nesting beyond Python's depth are no JSON.

Cases: a call without result has status ``no_result``, a result without call ``no_call``; null identifiers link
to nothing, so that each such result is a row with ``n_results`` 1; malformed JSON is invalid with an error and is written as null; unknown tools are invalid; empty
tables give no rows; repeated rows are linked like any others, so one identifier with several calls and results gives each pair; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, remove_dir, shared_dir, stored, table

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
OUT = "conv_id long, call_id string, name string, turn long, result_turn long, n_results long, level long, status string, valid boolean, error string, json string"
REPLY_SCHEMA = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {
    "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "array", "items": {"type": "string"}},
}}}


def fault(value: object, schema: dict, at: str = "$") -> str | None:
    """What is wrong with ``value``, or None."""
    if kind := schema.get("type"):
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(isinstance(value, KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
            return f"{at}: not of type {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of range"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: bad length"
    if isinstance(value, list) and "items" in schema:
        return next((f for k, v in enumerate(value) if (f := fault(v, schema["items"], f"{at}[{k}]"))), None)
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in own:
                if f := fault(value[k], own[k], f"{at}.{k}"):
                    return f
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: unknown"
    return None


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def _finite(text: str) -> float:
    x = float(text)
    if math.isinf(x) or math.isnan(x):
        raise ValueError(text)
    return x


def strict(text: str | None) -> object:
    """The value of a JSON text; ``ValueError`` if it is none."""
    try:
        value = json.loads(text or "", parse_constant=_finite, parse_float=_finite)
        canonical(value).encode()
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def parsed_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text).

    Calls stand in any text as ``<tool_call>{"id", "name", "arguments", "refs"}</tool_call>``, results in texts of
    the role ``tool`` as JSON ``{"id", "content"}``.
    """
    body = F.explode(F.regexp_extract_all("text", F.lit("(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))).alias("body")
    found = messages.select("conv_id", "turn", body)
    get = lambda p: F.get_json_object("body", f"$.{p}")
    calls = found.select("conv_id", "turn", get("id").alias("call_id"), get("name").alias("name"), get("arguments").alias("arguments"), F.coalesce(F.from_json(get("refs"), "array<string>"), F.array().cast("array<string>")).alias("refs"))
    results = messages.filter("role = 'tool'").select("conv_id", "turn", F.get_json_object("text", "$.id").alias("call_id"), F.coalesce(F.get_json_object("text", "$.content"), F.col("text")).alias("content"))
    return calls, results


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: each user turn calls ``reply``; the assistant turn that follows it is its result.
    A user turn refers to the user turn two before, or, if the length of its text is a multiple of five, to the one two
    behind it. So references point forward too, and two turns that refer to each other are a cycle."""
    ident = lambda t: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), t.cast("string"))
    turn = F.col("turn")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), turn.alias("turn")))
    forward = F.length(F.coalesce("text", F.lit(""))) % 5 == 0
    refs = F.when(forward, F.array(ident(turn + 2))).when(turn >= 2, F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>"))
    calls = messages.filter("role = 'user'").select("conv_id", "turn", ident(turn).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), refs.alias("refs"))
    results = messages.filter("role = 'assistant'").select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls; see the module's text. Only identifiers and numbers are read and moved.

    In conversations with a late reference, a call's level is the greater of its turn and one more than the highest level that it refers
    to. A call with one reference is a function of the level at its end, and such functions are put together two by two each
    round, so that a chain takes rounds by the logarithm of its length; a call with more waits until all of them have levels."""
    spark, folder = calls.sparkSession, shared_dir(calls.sparkSession)
    key = ["conv_id", "call_id"]
    heads = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    nodes = stored(heads.groupBy(*key).agg(F.max("turn").cast("long").alias("level")), f"{folder}/nodes")
    edges = heads.select(*key, F.explode("refs").alias("ref")).filter("ref IS NOT NULL").distinct()
    placed = edges.join(nodes, key).join(nodes.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("below")), ["conv_id", "ref"])
    edges = stored(placed, f"{folder}/edges")
    late = stored(edges.filter("below >= level").select("conv_id").distinct(), f"{folder}/late")
    if late.isEmpty():
        return nodes
    links = edges.join(late, "conv_id", "left_semi").select(*key, "ref")
    refs = links.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("to"))
    todo = nodes.join(late, "conv_id", "left_semi").join(refs, key, "left")
    kind = F.when(F.col("n").isNull(), "done").when(F.col("n") == 1, "one").otherwise("many").alias("kind")
    state = stored(todo.select(*key, "level", kind, "n", F.when(F.col("n") == 1, F.col("to")).alias("to"), F.lit(1).cast("long").alias("steps")), f"{folder}/state-0")
    links = stored(links.join(state.filter("kind = 'many'").select(*key), key, "left_semi"), f"{folder}/links")
    k, n_done, some_many = 0, -1, not links.isEmpty()
    while (n := state.filter("kind = 'done'").count()) > n_done:
        n_done, k = n, k + 1
        end = state.select("conv_id", F.col("call_id").alias("to"), F.struct("level", "kind", F.col("to").alias("to"), "steps").alias("end"))
        far = F.least(F.col("steps") + F.col("end.steps"), F.lit(1 << 40))  # around a cycle the steps would grow for ever
        moves = F.col("end.kind") != "many"
        one = state.filter("kind = 'one'").join(end, ["conv_id", "to"]).select(
            *key, F.when(moves, F.greatest("level", F.col("end.level") + F.col("steps"))).otherwise(F.col("level")).alias("level"),
            F.when(F.col("end.kind") == "done", "done").otherwise("one").alias("kind"), "n", F.when(F.col("end.kind") == "one", F.col("end.to")).otherwise(F.col("to")).alias("to"),
            F.when(F.col("end.kind") == "one", far).otherwise(F.col("steps")).alias("steps"),
        )
        after = state.filter("kind = 'done'").unionByName(one)
        if some_many:
            below = links.join(state.filter("kind = 'done'").select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("below")), ["conv_id", "ref"]).groupBy(*key).agg(F.count(F.lit(1)).alias("got"), F.max("below").alias("below"))
            many, ready = state.filter("kind = 'many'").join(below, key, "left"), F.coalesce(F.col("got") == F.col("n"), F.lit(False))
            after = after.unionByName(many.select(*key, F.when(ready, F.greatest("level", F.col("below") + 1)).otherwise(F.col("level")).alias("level"), F.when(ready, "done").otherwise("many").alias("kind"), "n", "to", "steps"))
        state = stored(after, f"{folder}/state-{k}")
        remove_dir(spark, f"{folder}/state-{k - 1}")
    solved = state.select(*key, F.when(F.col("kind") == "done", F.col("level")).alias("level"))
    return nodes.join(late, "conv_id", "left_anti").unionByName(solved)


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per call and result of one identifier, per call without result, and per result without call."""
    key = ["conv_id", "call_id"]
    calls = calls.select(*key, "turn", "name", "arguments", "refs")
    results = results.select(*key, "turn", "content")
    counts = results.groupBy(*key).agg(F.count(F.lit(1)).alias("n_results"))
    calls = calls.join(levels(calls), key, "left")
    found = results.select(*key, F.struct("turn", "content").alias("r"))
    both = calls.join(counts, key, "left").join(found, key, "left").select(*key, "name", "turn", F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), "level", "arguments", F.col("r.content").alias("content"), F.when(F.col("r").isNull(), "no_result").otherwise("linked").alias("status"))
    alone = found.join(calls.select(*key).distinct(), key, "left_anti").join(counts, key, "left").withColumn("n_results", F.coalesce("n_results", F.lit(1).cast("long")))
    alone = alone.select(*key, F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("turn"), F.col("r.turn").alias("result_turn"), "n_results", F.col("r.turn").alias("level"), F.lit(None).cast("string").alias("arguments"), F.col("r.content").alias("content"), F.lit("no_call").alias("status"))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        valid, errors, texts = [], [], []
        for status, call, name, args, content in zip(*(b.column(x).to_pylist() for x in ("status", "call_id", "name", "arguments", "content"))):
            value, error = None, None
            if status != "no_call":
                try:
                    value = strict(args)
                    error = fault(value, schemas[name]) if name in schemas else f"unknown tool {name}"
                except ValueError:
                    error = "arguments are no JSON"
            valid.append(status != "no_call" and error is None)
            errors.append(error)
            texts.append(canonical({"arguments": value, "id": call, "name": name, "result": content}))
        names = [x.split()[0] for x in OUT.split(", ")]
        own = {"valid": pa.array(valid), "error": pa.array(errors, pa.string()), "json": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_arrays([own.get(n, b.column(n) if n not in own else None) for n in names], names=names)

    return arrow_map(both.unionByName(alone), kernel, OUT)


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    calls, results = turn_calls(messages)
    return linked(calls, results, REPLY_SCHEMA).select("conv_id", "call_id", "turn", "result_turn", "n_results", "level", "status", "valid", "json")


OP3_SQL = """
WITH RECURSIVE c AS (SELECT *, 'call_' || conv_id || '_' || turn AS call_id FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
e AS (SELECT a.call_id, a.turn, b.call_id AS ref FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = CASE WHEN length(coalesce(a.text, '')) % 5 = 0 THEN a.turn + 2 ELSE a.turn - 2 END),
v AS (SELECT call_id, turn AS level FROM c WHERE call_id NOT IN (SELECT call_id FROM e) UNION ALL SELECT e.call_id, greatest(e.turn, v.level + 1) FROM v JOIN e ON e.ref = v.call_id)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.turn AS result_turn,
       CAST(CASE WHEN r.turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results, CASE WHEN c.turn IS NULL THEN r.turn ELSE v.level END AS level,
       CASE WHEN r.turn IS NULL THEN 'no_result' WHEN c.turn IS NULL THEN 'no_call' ELSE 'linked' END AS status,
       c.turn IS NOT NULL AND length(c.text) > 0 AS valid,
       '{"arguments":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '{"prompt":' || to_json(coalesce(c.text, '')) || ',"turn":' || c.turn || '}' END
       || ',"id":' || to_json(coalesce(c.call_id, r.call_id)) || ',"name":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '"reply"' END
       || ',"result":' || CASE WHEN r.text IS NULL THEN 'null' ELSE to_json(r.text) END || '}' AS json
FROM c FULL JOIN r ON c.call_id = r.call_id LEFT JOIN v ON v.call_id = c.call_id
"""
