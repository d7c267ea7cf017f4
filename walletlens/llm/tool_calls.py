"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on conversation and identifier. Before it, each side is grouped
to one row per identifier, so repeated rows never multiply. A call may name the call it follows;
calls are put in topological order by their depth along these references, found by pointer doubling
(as many rounds as the logarithm of the longest chain). Arguments are parsed and checked against the
schema of the called name, and every exchange is written as canonical JSON: keys in order, no blanks.

No conversation is gathered in one place: rows are keyed by identifier, and the order within a
conversation is (depth, call_turn, call_id). A conversation with a third of all rows spreads out.

Null identifiers link with nothing and are left out. Repeated calls of one identifier: the first by
turn, then content, counts; ``n_calls`` and ``n_results`` tell how many there were. A result without a
call has status ``orphan_result``, a call without a result ``unanswered``. References to unknown calls
are none. Calls on or behind a cycle of references have no depth and status ``cycle``. Null or
malformed arguments (numbers beyond a double and half surrogate pairs too), keys that stand twice in an
object, missing, unknown or wrongly typed arguments: ``valid`` is false, ``problem`` says why, and the
arguments stand in the JSON as null. Very long texts: one row is in memory at a time with its batch.
Empty table: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from walletlens.session import materialize

#: Types a schema may ask for, and how JSON values are told apart.
_KINDS = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
}
_CHECKED = StructType([StructField("problem", StringType()), StructField("json", StringType())])


def problem_of(arguments: object, schema: dict[str, tuple[str, bool]] | None) -> str | None:
    """What is wrong with parsed arguments under a schema of name -> (kind, required)."""
    if schema is None:
        return "unknown name"
    if not isinstance(arguments, dict):
        return "not an object"
    for name, (kind, required) in sorted(schema.items()):
        if name not in arguments:
            if required:
                return f"missing {name}"
        elif not _KINDS[kind](arguments[name]):
            return f"{name} is no {kind}"
    unknown = sorted(set(arguments) - set(schema))
    return f"unknown {unknown[0]}" if unknown else None


def _refuse(constant: str):
    raise ValueError(constant)


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


class _Repeated(ValueError):
    """A key stands twice in an object."""


def _object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len({key for key, _ in pairs}) < len(pairs):
        raise _Repeated
    return dict(pairs)


def _parsed(text: str | None) -> tuple[object, str | None]:
    """The value of a JSON text that can be written again, or what is wrong with it."""
    if text is None:
        return None, "no arguments"
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite, object_pairs_hook=_object)
        canonical(value).encode()  # fails for half of a surrogate pair, which no UTF-8 text can hold
    except _Repeated:
        return None, "repeated key"
    except (ValueError, RecursionError):
        return None, "malformed"
    return value, None


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _checked(schemas: dict[str, dict[str, tuple[str, bool]]]):
    @F.arrow_udf(_CHECKED)
    def checked(ids: pa.Array, names: pa.Array, arguments: pa.Array, results: pa.Array, depths: pa.Array) -> pa.Array:
        problems, texts = [], []
        columns = (x.to_pylist() for x in (ids, names, arguments, results, depths))
        for call_id, name, text, result, depth in zip(*columns, strict=True):
            value, problem = _parsed(text)
            problem = problem or problem_of(value, schemas.get(name))
            problems.append(problem)
            given = None if problem else value
            row = {"arguments": given, "call_id": call_id, "depth": depth, "name": name, "result": result}
            texts.append(canonical(row))
        return pa.StructArray.from_arrays([pa.array(problems, pa.string()), pa.array(texts, pa.string())], ["problem", "json"])

    return checked


def depths(calls: DataFrame) -> DataFrame:
    """(conversation, call_id, depth) of calls (conversation, call_id, after), one row per identifier.

    Depth counts the calls before it along ``after``; null on or behind a cycle.
    """
    known = calls.select(F.col("conversation").alias("c"), F.col("call_id").alias("k"))
    step = calls.join(known, (F.col("conversation") == F.col("c")) & (F.col("after") == F.col("k")), "left")
    step = step.select(
        "conversation", "call_id", F.col("k").alias("up"), F.when(F.col("k").isNull(), 0).otherwise(1).alias("depth")
    )
    step = materialize(step, "call-depths")
    total, reach = step.count(), 1
    while reach < total and not step.filter("up IS NOT NULL").isEmpty():
        above = step.select(
            F.col("conversation").alias("c"), F.col("call_id").alias("k"), F.col("up").alias("next"), F.col("depth").alias("d")
        )
        step = step.join(above, (F.col("conversation") == F.col("c")) & (F.col("up") == F.col("k")), "left")
        step = step.select(
            "conversation", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")
        )
        step, reach = materialize(step, "call-depths"), 2 * reach
    return step.select("conversation", "call_id", F.when(F.col("up").isNull(), F.col("depth")).cast("long").alias("depth"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per conversation and identifier.

    ``calls``: conversation, call_id, turn, name, arguments (JSON text), after. ``results``:
    conversation, call_id, turn, content. Returns conv_id, call_id, call_turn, result_turn, n_calls,
    n_results, depth, status, valid, problem, json.
    """
    keys = ["conversation", "call_id"]
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("call")
    calls = calls.dropna(subset=keys).groupBy(*keys).agg(first, F.count("*").alias("n_calls"))
    calls = calls.select(*keys, "call.turn", "call.name", "call.arguments", "call.after", "n_calls")
    answer = F.min(F.struct("turn", "content")).alias("answer")
    results = results.dropna(subset=keys).groupBy(*keys).agg(answer, F.count("*").alias("n_results"))
    calls = materialize(calls, "calls")
    deep = calls.join(depths(calls), keys)
    both = deep.join(results, keys, "full")
    both = both.withColumn("checked", _checked(schemas)("call_id", "name", "arguments", "answer.content", "depth"))
    called = F.col("n_calls").isNotNull()
    status = (
        F.when(~called, "orphan_result")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked")
    )
    problem = F.when(called, F.col("checked.problem"))
    return both.select(
        F.col("conversation").alias("conv_id"),
        "call_id",
        F.col("turn").alias("call_turn"),
        F.col("answer.turn").alias("result_turn"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "depth",
        status.alias("status"),
        (called & problem.isNull()).alias("valid"),
        problem.alias("problem"),
        F.col("checked.json").alias("json"),
    )


#: The two kinds of call that the conversations table is read as.
CONVERSATION_SCHEMAS = {
    "ask": {"text": ("string", True), "turn": ("integer", True)},
    "instruct": {"text": ("string", True), "turn": ("integer", True)},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results.

    The table has no tool calls of its own, so each user turn is read as a call ``ask`` (a system turn
    as ``instruct``) named by conversation and turn, which follows the call two turns earlier, and each
    assistant turn as the result of the turn before it.
    """

    def named(back: int) -> str:
        return f"concat(conv_id, '-', turn - {back})"

    calls = conversations.filter("role IN ('user', 'system')").selectExpr(
        "conv_id AS conversation",
        f"{named(0)} AS call_id",
        "turn",
        "CASE role WHEN 'user' THEN 'ask' ELSE 'instruct' END AS name",
        "to_json(named_struct('text', text, 'turn', turn)) AS arguments",
        f"{named(2)} AS after",
    )
    results = conversations.filter("role = 'assistant'").selectExpr(
        "conv_id AS conversation", f"{named(1)} AS call_id", "turn", "text AS content"
    )
    return calls, results
