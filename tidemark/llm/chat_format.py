"""Chat formatting: tool calls linked with their results.

Calls and results are hash-joined by identifier (a full join, so unanswered calls and results without a call stay visible),
ordered so that a call follows the calls it needs, validated against schemas and written as canonical JSON (keys in
order, no spaces). All steps are Spark joins and expressions; no conversation is gathered in one task.

Order: a call's level is one more than the highest level of the calls it needs; levels are found round by round from the calls of
the level before, as many rounds as the longest chain, each of which writes its own level only. Calls in or behind a cycle, or that need
an unknown call, get no level and the status ``unordered``. Within a level calls stand by turn, then identifier. Positions come
from counts of blocks of turns, so that a conversation that holds most rows is spread over tasks.

No row is lost. Edge cases: null identifiers match nothing and give rows of status ``unnamed``; of repeated identifiers in one conversation
the first turn counts (then the smallest content), the others follow with the status ``repeated``; results without a call are
``orphan``; rows of a null conv_id are linked with nothing (their calls are ``unordered``); arguments that are not a JSON object are invalid
and written as null, null arguments likewise; texts of any length are carried whole; empty tables give empty results; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import discard, settle


@dataclass(frozen=True)
class Argument:
    """What a tool asks of one argument; ``kind`` is string, number, boolean, array or object."""

    tool: str
    name: str
    kind: str = "string"
    required: bool = True
    min_length: int | None = None
    max_length: int | None = None


_KINDS = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def argument_errors(arguments: Column, tool: Column, schemas: tuple[Argument, ...]) -> Column:
    """An array of messages, empty if ``arguments`` (JSON text) fits the schema of ``tool``."""
    parsed = F.try_parse_json(arguments)
    tools = sorted({a.tool for a in schemas})
    checks = [
        F.when(~tool.isin(tools) | tool.isNull(), F.lit("unknown tool")),
        F.when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.lit("not an object")),
    ]
    for a in schemas:
        path = f"$['{a.name}']"
        value = F.try_variant_get(parsed, path, "variant")
        kind = F.schema_of_variant(value)
        text = F.try_variant_get(parsed, path, "string")
        missing = value.isNull() | (kind == "VOID")
        wrong = ~F.coalesce(F.reduce(F.array(*[kind.startswith(k) for k in _KINDS[a.kind]]), F.lit(False), lambda x, y: x | y), F.lit(False))
        failed = F.when(missing, F.lit(f"{a.name}: missing") if a.required else F.lit(None)).when(wrong, F.lit(f"{a.name}: not a {a.kind}"))
        if a.min_length is not None:
            failed = failed.when(F.length(text) < a.min_length, F.lit(f"{a.name}: too short"))
        if a.max_length is not None:
            failed = failed.when(F.length(text) > a.max_length, F.lit(f"{a.name}: too long"))
        checks.append(F.when(tool == a.tool, failed))
    return F.array_compact(F.array(*checks))


#: Turns of a block; rounds after which the tables of levels are written as one.
TURNS, COMPACT = 1000, 16


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call whose needs can be met; ``calls``: conv_id, call_id, needs (array)."""
    spark, spent, steps = calls.sparkSession, [], []
    ids = settle(calls.select("conv_id", "call_id", "needs"), "calls", spent)
    free = F.coalesce(F.size("needs"), F.lit(0)) <= 0
    edges = settle(ids.where(~free).select("conv_id", "call_id", F.explode("needs").alias("need")).distinct(), "needs", spent)
    known = new = settle(ids.where(free).select("conv_id", "call_id", F.lit(0).alias("level")), "levels", steps)
    level = 0
    while True:
        level += 1
        touched = edges.join(new.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi").select("conv_id", "call_id").distinct()
        met = edges.join(touched, ["conv_id", "call_id"], "left_semi").join(known.select("conv_id", F.col("call_id").alias("need"), F.lit(1).alias("ok")), ["conv_id", "need"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("all"), F.count("ok").alias("ok")).where("all = ok").select("conv_id", "call_id", F.lit(level).alias("level"))
        new = settle(ready, "levels", steps)
        if not new.limit(1).count():
            discard(spark, [*spent, steps.pop()])
            return known
        known = known.union(new)
        if level % COMPACT == 0:
            past, steps = steps, []
            known = settle(known, "levels", steps)
            new = known.where(F.col("level") == level)
            discard(spark, past)


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with their place within conv_id, by level, turn and call_id; rows of no conversation have none. ``rows`` is read more than once."""
    apart = rows.where(F.col("conv_id").isNull()).withColumn("position", F.lit(None).cast("long"))
    rows = rows.where(F.col("conv_id").isNotNull())
    block = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1))
    keyed = rows.withColumn("_block", block).withColumn("_level", F.coalesce("level", F.lit((1 << 31) - 1)))
    counts = keyed.groupBy("conv_id", "_level", "_block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("_level", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("conv_id").alias("_c"), F.col("_level").alias("_l"), F.col("_block").alias("_b"), before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "_level", "_block").orderBy("turn", "call_id", "status", "message"))
    joined = keyed.withColumn("_nth", nth).join(starts, (F.col("conv_id") == F.col("_c")) & (F.col("_level") == F.col("_l")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("position", (F.col("_before") + F.col("_nth")).cast("long")).select(*apart.columns).unionByName(apart)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: tuple[Argument, ...]) -> DataFrame:
    """(conv_id, call_id, position, turn, name, status, valid, errors, message).

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), needs (array of call_ids); ``results``: conv_id,
    call_id, turn, content.
    """
    spark, spent = calls.sparkSession, []
    # Rows without a call_id are not counted, and a hash spreads them, as all share one key.
    spread = lambda *ties: F.when(F.col("call_id").isNull(), F.xxhash64("turn", *ties))
    nth = lambda *ties: F.when(F.col("call_id").isNotNull(), F.row_number().over(Window.partitionBy("conv_id", "call_id", spread(*ties)).orderBy("turn", *ties)))
    calls = settle(calls.select("conv_id", "call_id", "turn", "name", "arguments", "needs").withColumn("_n", nth("name", "arguments")), "calls", spent)
    results = settle(results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("turn")).withColumn("_n", nth("content")).drop("turn"), "results", spent)
    named, answers = calls.where("_n = 1").drop("_n"), results.where("_n = 1").drop("_n")
    both = named.withColumn("_call", F.lit(True)).join(answers.withColumn("_result", F.lit(True)), ["conv_id", "call_id"], "full")
    both = both.join(call_levels(named), ["conv_id", "call_id"], "left")
    status = F.when(F.col("_call").isNull(), "orphan").when(F.col("level").isNull(), "unordered").when(F.col("_result").isNull(), "unanswered").otherwise("linked")
    both = both.withColumn("status", status).select("conv_id", "call_id", "turn", "name", "arguments", "result_turn", "content", "_call", "level", "status")
    more = F.when(F.col("call_id").isNull(), "unnamed").otherwise("repeated").alias("status")
    rest = calls.where("_n is null or _n > 1").select("conv_id", "call_id", "turn", "name", "arguments", F.lit(None).cast("long").alias("result_turn"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("_call"), F.lit(None).cast("int").alias("level"), more)
    other = results.where("_n is null or _n > 1").select("conv_id", "call_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "result_turn", "content", F.lit(None).cast("boolean").alias("_call"), F.lit(None).cast("int").alias("level"), more)
    both = both.unionByName(rest).unionByName(other)
    errors = F.when(F.col("_call").isNotNull(), argument_errors(F.col("arguments"), F.col("name"), schemas)).otherwise(F.array().cast("array<string>"))
    parsed = F.try_parse_json("arguments")
    message = F.to_json(
        F.struct(
            F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("name"),
            F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    out = both.withColumns({"errors": errors, "message": message}).withColumn("valid", F.col("_call").isNotNull() & (F.size("errors") == 0))
    out = settle(out.select("conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "name", "status", "valid", "errors", "message", "level"), "linked")
    discard(spark, spent)
    return _positions(out).select("conv_id", "call_id", "position", "turn", "name", "status", "valid", "errors", "message")


#: Schemas of the calls derived from plain conversations.
CONVERSATION_TOOLS = (Argument("configure", "instructions", min_length=1), Argument("reply", "prompt", min_length=2, max_length=4000), Argument("reply", "turn", "number"))


def _last_before(rows: DataFrame, **marks: Column) -> DataFrame:
    """``rows`` with, for each mark, the turn of the last marked row before, by turn and text within conv_id.

    The turn before a block of turns comes from the blocks' own last turns, so that no conversation is sorted in one task.
    """
    rows = rows.withColumn("_block", F.floor(F.col("turn") / TURNS))
    turn = {name: F.when(mark, F.col("turn")) for name, mark in marks.items()}
    blocks = rows.groupBy("conv_id", "_block").agg(*[F.max(t).alias(name) for name, t in turn.items()])
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_block", *[F.max(name).over(earlier).alias(f"_old_{name}") for name in marks])
    within = Window.partitionBy("conv_id", "_block").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_new_{name}": F.max(t).over(within) for name, t in turn.items()}).join(blocks, ["conv_id", "_block"])
    return rows.withColumns({name: F.coalesce(f"_new_{name}", f"_old_{name}") for name in marks})


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: a system turn configures, a user turn asks, assistant turns after it answer.

    An asking turn needs the configuring turn before it. Turns of any other role, and turns without a number or a conversation, are results
    without a call; so every turn is a row. ``turns``: conv_id, turn, role, text.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.coalesce(F.col("role").isin("system", "user", "assistant"), F.lit(False))
    lost = rows.where(~placed).select("conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    rows = _last_before(rows.where(placed), asked=F.col("role") != "assistant", setting=F.col("role") == "system")
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    calls = rows.where("role in ('system', 'user')").select(
        "conv_id",
        name(F.col("turn")).alias("call_id"),
        "turn",
        F.when(F.col("role") == "system", "configure").otherwise("reply").alias("name"),
        F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("instructions")))).otherwise(F.to_json(F.struct("turn", F.col("text").alias("prompt")))).alias("arguments"),
        F.when((F.col("role") == "user") & F.col("setting").isNotNull(), F.array(name(F.col("setting")))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", F.coalesce(name(F.col("asked")), F.lit("none")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results.union(lost)
