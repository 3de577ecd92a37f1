"""Chat formatting: tool calls linked to their results, in DataFrame functions only.

``calls`` (conv_id, turn, position, call_id, tool, arguments, depends_on) and ``results`` (conv_id, turn, call_id,
content) meet under (conv_id, call_id). An id may be used again: a result belongs to the last call of its id at or before
its turn, and a call is linked to the first of its results by (turn, content), their number is reported. Calls and results of
one id are ordered in slabs of ``SLAB`` turns with one summary row carried on per slab, so that an id that is used
all along a long conversation is many small groups.

Arguments are JSON objects, exploded once into fields and joined with the ``schemas`` table (tool, field, kind, required).
Calls are put into a topological order: an earlier message comes before a later one, so that only references between
calls of one message need levels, which are found by relaxing those edges until nothing changes; the number of rounds is
bounded by the longest chain inside one message. A call whose reference is unknown, lies in a later message or on a cycle is
reported; a reference to its own id means an earlier call of it. Conversations are never gathered into one group: the order
is a rank of (turn, level, position), which a consumer sorts by.

Canonical JSON is the VARIANT form written back: keys sorted, no spaces, numbers in shortest form.

Defined results: null or empty arguments are ``{}``; text that is no JSON object is an error of the call; rows that repeat a
call or a result in every column count once; every other call has a row of its own, with the number of its occurrence
under its id; results without a call have a row of kind ``result`` with the error "result without call"; calls and results
with a null id or conversation have a row, are never linked and have the error "no id"; a null turn comes before all others; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import Scratch, drop_tables, keep_table

CALL_FORMAT = (
    "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>, tool_call_id string, content string"
)
#: Turns of one id that are ordered in one group.
SLAB = 1024
#: Tools that the given conversations are seen to use: a plain user turn is a call of ``reply``.
SCHEMAS = (
    ("reply", "conversation", "integer", True),
    ("reply", "prompt", "string", True),
    ("reply", "words", "integer", True),
    ("reply", "follows", "string", False),
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
)


def default_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMAS, "tool string, field string, kind string, required boolean")


def messages_to_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the turns of (conv_id, turn, role, text).

    A text that is a JSON message in the usual tool-call form is taken by its own ids. Any other user turn counts as
    one call of ``reply`` that follows the user turn two turns before, and an assistant turn as the result of the turn before it.
    """
    parsed = F.when(F.trim("text").startswith("{"), F.from_json("text", CALL_FORMAT))
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), parsed.alias("m"))
    stated = turns.filter("m.tool_calls is not null").select(
        "conv_id", "turn", F.posexplode("m.tool_calls").alias("position", "c")
    ).select("conv_id", "turn", "position", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), "c.arguments", F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))

    def name(turn: Column) -> Column:
        return F.concat(F.lit("turn-"), turn.cast("string"))

    plain = turns.filter("m.tool_calls is null and m.tool_call_id is null")
    earlier = plain.filter("role = 'user'").select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("follows", name(F.col("turn") - 2))
    asked = (
        plain.filter("role = 'user'")
        .join(earlier, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", F.lit(0).alias("position"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"),
            F.to_json(F.struct(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.col("text").alias("prompt"), F.col("follows"), F.col("conv_id").alias("conversation"))).alias("arguments"),
            F.when(F.col("follows").isNull(), F.array().cast("array<string>")).otherwise(F.array("follows")).alias("depends_on"),
        )
    )
    calls = stated.unionByName(asked)
    answered = turns.filter("m.tool_call_id is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    replied = plain.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, answered.unionByName(replied)


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call, canonical, errors): arguments against the schema of the tool, errors sorted and distinct."""
    text = F.when(F.trim(F.coalesce("arguments", F.lit(""))) == "", "{}").otherwise(F.col("arguments"))
    typed = calls.select("call", "tool", F.try_parse_json(text).alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rows = typed.select("call", "tool", F.when(is_object, F.col("v")).alias("v"), F.to_json("v").alias("canonical"))
    given = (
        rows.filter("v is not null")
        .lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        .select("call", "tool", F.col("key").alias("field"), F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("found"))
    )
    named = {"integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "string": ["STRING"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
    fits = F.lit(False)
    for kind, types in named.items():
        fits = fits | ((F.col("kind") == kind) & F.col("found").isin(types))
    wrong = (
        given.join(schemas, ["tool", "field"], "left")
        .withColumn("error", F.when(F.col("kind").isNull(), F.concat(F.lit("unknown "), "field")).when(~fits, F.concat(F.lit("type "), "field")))
        .filter("error is not null")
        .select("call", "error")
    )
    required = schemas.filter("required").select("tool", "field").distinct()
    absent = (
        rows.select("call", "tool").join(required, "tool")
        .join(given.select("call", "field").distinct(), ["call", "field"], "left_anti")
        .select("call", F.concat(F.lit("missing "), "field").alias("error"))
    )
    broken = rows.filter("v is null").select("call", F.lit("not an object").alias("error"))
    tools = schemas.select("tool").distinct()
    strange = rows.join(tools, "tool", "left_anti").select("call", F.lit("unknown tool").alias("error"))
    errors = wrong.unionByName(absent).unionByName(broken).unionByName(strange).groupBy("call").agg(F.collect_set("error").alias("errors"))
    return rows.select("call", "canonical").join(errors, "call", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def call_levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(call, level, order_error): level inside the message, error for broken references."""
    refs = calls.select("conv_id", "call_id", "call", "turn", F.explode("depends_on").alias("needs")).distinct()
    known = calls.filter("conv_id is not null and call_id is not null")
    # Each id is one row here: whether a reference can be met asks for its first turn only.
    first = known.groupBy("conv_id", F.col("call_id").alias("needs")).agg(F.min("turn").alias("first_turn"))
    same = known.select("conv_id", F.col("call_id").alias("needs"), "turn", F.col("call").alias("target"))
    dated = refs.join(first, ["conv_id", "needs"], "left")
    own = F.col("needs") == F.col("call_id")
    bad = dated.filter("first_turn is null or first_turn > turn").groupBy("call").agg(
        F.max(F.when(F.col("first_turn").isNull(), "unknown reference").otherwise("later reference")).alias("order_error")
    )
    selfish = dated.filter(own & (F.col("first_turn") == F.col("turn"))).select("call").distinct()
    edges = scratch.keep(refs.filter(~own).join(same, ["conv_id", "needs", "turn"]).select("call", "target"))
    inner = keep_table(edges.select("call").distinct().withColumn("level", F.lit(None).cast("int")))
    while True:
        open_calls = inner.filter("level is null").count()
        if not open_calls:
            break
        at = edges.join(inner.select(F.col("call").alias("target"), "level", F.lit(True).alias("inside")), "target", "left")
        at = at.withColumn("level", F.when(F.col("inside"), F.col("level")).otherwise(0))
        reach = at.groupBy("call").agg(F.when(F.count("level") == F.count("*"), F.max("level") + 1).alias("reached"))
        moved = keep_table(inner.join(reach, "call", "left").select("call", F.coalesce("level", "reached").alias("level")))
        stuck = moved.filter("level is null").count() == open_calls
        drop_tables(inner)
        inner = moved
        if stuck:
            break
    scratch.tables.append(inner)
    loops = inner.filter("level is null").select("call").unionByName(selfish).distinct().withColumn("loop", F.lit("cycle"))
    return (
        calls.select("call").join(inner, "call", "left").join(loops, "call", "left").join(bad, "call", "left")
        .select("call", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("loop", "order_error").alias("order_error"))
    )


def attached(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, is_call, ..., occurrence, owner): calls and results of known ids in order.

    owner is the call that a result belongs to, null before the first call of its id.
    """
    nothing = {"position": "int", "call": "string", "content": "string"}
    events = calls.select("conv_id", "call_id", "turn", F.lit(True).alias("is_call"), "position", "call", F.lit(None).cast("string").alias("content")).unionByName(
        results.select("conv_id", "call_id", "turn", F.lit(False).alias("is_call"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items() if c != "content"), "content")
    )
    slabbed = events.withColumn("slab", F.coalesce(F.floor(F.col("turn") / SLAB), F.lit(-1 << 62)))
    group = ["conv_id", "call_id"]
    # Null turns first, calls before results of the same turn.
    order = Window.partitionBy(*group, "slab").orderBy(F.col("turn").asc_nulls_first(), F.desc("is_call"), "position", "call", "content")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = slabbed.withColumn("owner", F.last("call", True).over(so_far)).withColumn("seen", F.count("call").over(so_far))
    last = F.max(F.when(F.col("is_call"), F.struct(F.coalesce("turn", F.lit(-1 << 62)), "position", "call")))["call"]
    ends = slabbed.groupBy(*group, "slab").agg(last.alias("end"), F.count("call").alias("n"))
    before = Window.partitionBy(*group).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*group, "slab", F.last("end", True).over(before).alias("carried"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return inside.join(carried, [*group, "slab"]).select(
        *group, "turn", "is_call", "call", "content", F.coalesce("owner", "carried").alias("owner"), (F.col("earlier") + F.col("seen")).alias("occurrence")
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result without a call: conv_id, call_id, turn, level, position, tool, linked, n_results, valid, errors, json, kind, occurrence."""
    scratch = Scratch()
    columns = ["conv_id", "call_id", "turn", "position", "tool", "arguments", "depends_on"]
    code = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))
    every = scratch.keep(calls.select(*columns).distinct().withColumn("call", code))
    answers = results.select("conv_id", "turn", "call_id", "content").distinct()
    named = "conv_id is not null and call_id is not null"
    events = scratch.keep(attached(every.filter(named), answers.filter(named)))
    best = events.filter("not is_call and owner is not null").groupBy(F.col("owner").alias("call")).agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")
    )
    numbers = events.filter("is_call").select("call", "occurrence")
    none = F.array().cast("array<string>")
    no_id = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.lit("no id"))
    whole = (
        every.join(best, "call", "left").join(argument_errors(every, schemas), "call").join(call_levels(every, scratch), "call").join(numbers, "call", "left")
        .withColumn("linked", F.col("r").isNotNull())
        .withColumn("errors", F.array_sort(F.array_compact(F.concat("errors", F.array("order_error", no_id)))))
        .select(*columns[:5], "depends_on", "level", "linked", "n_results", "errors", "canonical", F.col("r.content").alias("content"), F.lit("call").alias("kind"), "occurrence")
    )
    orphans = events.filter("not is_call and owner is null").select("conv_id", "call_id", "turn", "content", F.array(F.lit("result without call")).alias("errors")).unionByName(
        answers.filter(f"not ({named})").select("conv_id", "call_id", "turn", "content", F.array(F.lit("no id"), F.lit("result without call")).alias("errors"))
    )
    stray = orphans.select(
        "*", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("tool"), none.alias("depends_on"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"),
        F.lit(0).cast("long").alias("n_results"), F.lit(None).cast("string").alias("canonical"), F.lit("result").alias("kind"), F.lit(None).cast("long").alias("occurrence"),
    )
    rows = whole.unionByName(stray)
    message = F.to_json(
        F.struct(
            F.when(F.col("kind") == "call", F.col("depends_on")).alias("after"), F.col("canonical").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"),
            F.when(F.col("linked") | (F.col("kind") == "result"), F.col("content")).alias("result"),
        )
    )
    done = keep_table(
        rows.select(
            "conv_id", "call_id", "turn", "level", "position", "tool", "linked", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
            (F.size("errors") == 0).alias("valid"), F.array_join("errors", ";").alias("errors"), F.to_json(F.parse_json(message)).alias("json"), "kind", "occurrence",
        )
    )
    scratch.drop()
    return done
