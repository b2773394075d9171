"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. Calls are ordered by levels: a call's level
is one more than the highest of those it depends on, found by joins: chains by doubling, the rest round by round. Arguments are parsed as
VARIANT and held against schemas, and the whole is written as JSON with sorted keys and no white space. Everything
is DataFrame operations.

Defined results: of calls, or results, with one identifier the earliest counts and the error `repeated id` or
`repeated result` is noted. A call without an identifier gets one from its turn. A call without a result has the
status `no result`, a result without a call `no call`. Dependencies on unknown calls are noted as errors and
otherwise passed over; calls on a cycle, and those that wait for one, have the status `cycle` and no level.
Arguments that aren't a JSON object are an error. A null conversation is a conversation; fields that are null are
left out of the JSON.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.llm.common import written

#: What schema_of_variant() says of values of each kind.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
SCHEMA = "name string, param string, kind string, required boolean"


def schemas(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    """A table of tools' parameters: name, param, kind (a key of KINDS), required."""
    return spark.createDataFrame(rows, SCHEMA)


def parsed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of messages (conv_id, turn, role, text) whose text is JSON.

    An assistant's message holds `tool_calls`, a list of {id, name, arguments, depends_on}; a message of the role
    `tool` holds tool_call_id and content. Other messages are neither.
    """
    call = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>>"
    said = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    calls = said.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.from_json("text", call)["tool_calls"]).alias("k", "x"))
    calls = calls.filter("x is not null").select("conv_id", "turn", F.coalesce("x.id", F.concat_ws("/", F.lit("turn"), "turn", "k")).alias("call_id"), F.col("x.name").alias("name"), F.col("x.arguments").alias("arguments"), F.col("x.depends_on").alias("depends_on"))
    result = F.from_json("text", "struct<tool_call_id: string, content: string>")
    results = said.filter("role = 'tool'").select("conv_id", "turn", result.alias("x")).filter("x.tool_call_id is not null")
    return calls, results.select("conv_id", "turn", F.col("x.tool_call_id").alias("call_id"), F.col("x.content").alias("content"))


def turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations in the same form: each turn that isn't the assistant's calls for an answer.

    The call's name is the role, its argument the text, it depends on the call before it, and the assistant's
    turns after it are its results.
    """
    said = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    calls = F.when(F.col("role") != "assistant", F.col("turn"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = said.withColumn("last", F.last(calls, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))

    def named(turn: str) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.coalesce(F.col(turn).cast("string"), F.lit("null")))

    asked = placed.filter("role <> 'assistant'").select("conv_id", "turn", named("turn").alias("call_id"), F.col("role").alias("name"), F.to_json(F.struct("text")).alias("arguments"), F.when(F.col("last").isNotNull() & (F.col("last") < F.col("turn")), F.array(named("last"))).alias("depends_on"))
    answered = placed.filter("role = 'assistant'").select("conv_id", "turn", named("last").alias("call_id"), F.col("text").alias("content"))
    return asked, answered


def _at(x: DataFrame, call: str, y: DataFrame) -> Column:
    """Whether a row of x points, in its own conversation, to the call of a row of y (c, d)."""
    return x["conv_id"].eqNullSafe(y["c"]) & (x[call] == y["d"])


def ends_of_chains(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Where the chains of single dependencies lead: tables of conv_id, call_id, up, dist, and what never ends (cycles).

    nodes: conv_id, call_id, up (the call depended on; itself for an end), dist (1; 0 for an end), done (whether it is
    an end). Each round every open call takes over where the call it points to has got, so a chain of n calls takes
    log2(n) rounds; what is open after as many rounds as calls allow is on a cycle or leads to one.
    """
    done, open_ = [nodes.filter("done")], nodes.filter("not done")
    for _ in range(nodes.count().bit_length() + 1):
        if open_.isEmpty():
            break
        ahead = functools.reduce(DataFrame.unionByName, [*done, open_]).select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("done").alias("there"))
        moved = written(open_.join(ahead, _at(open_, "up", ahead)).select("conv_id", "call_id", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("there").alias("done")))
        done, open_ = [*done, moved.filter("done")], moved.filter("not done")
    return done, open_


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level and unknown (whether a dependency isn't a call) of distinct calls with depends_on.

    Chains of single dependencies are shortened first; what is left are calls with several dependencies, which are
    settled round by round, once all they wait for are: rounds are as many as such calls follow each other.
    """
    stuck = F.coalesce(F.array_contains("depends_on", F.col("call_id")), F.lit(False))
    own = calls.select("conv_id", "call_id", stuck.alias("stuck"))
    asked = calls.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).filter("dep is not null and dep <> call_id").distinct()
    there = own.select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), F.lit(True).alias("known"))
    edges = written(asked.join(there, _at(asked, "dep", there), "left").select("conv_id", "call_id", "dep", "known"))
    needs = edges.filter("known").groupBy("conv_id", "call_id").agg(F.count("*").alias("deps"), F.min("dep").alias("one")).withColumnsRenamed({"conv_id": "c", "call_id": "d"})
    end = F.col("stuck") | (F.coalesce("deps", F.lit(0)) != 1)
    nodes = written(own.join(needs, _at(own, "call_id", needs), "left").select("conv_id", "call_id", F.when(end, F.col("call_id")).otherwise(F.col("one")).alias("up"), F.when(end, 0).otherwise(1).cast("long").alias("dist"), end.alias("done"), "stuck", F.coalesce("deps", F.lit(0)).alias("deps")))

    done, _ = ends_of_chains(nodes.select("conv_id", "call_id", "up", "dist", "done"))
    placed = functools.reduce(DataFrame.unionByName, done)
    settled = nodes.filter("not stuck and deps = 0").select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), F.lit(0).cast("long").alias("base"))
    several = nodes.filter("not stuck and deps > 1").select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"))
    if not several.isEmpty():
        links = edges.filter("known").join(several, _at(edges, "call_id", several), "left_semi").select("conv_id", "call_id", "dep")
        to = placed.select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), "up", (F.col("dist") + 1).alias("more"))
        links = written(links.join(to, _at(links, "dep", to), "left").select("conv_id", "call_id", "up", "more"))
        while True:
            met = links.join(settled, _at(links, "up", settled), "left").groupBy("conv_id", "call_id").agg(F.count("*").alias("all"), F.count("base").alias("met"), F.max(F.col("more") + F.col("base")).alias("base"))
            new = written(met.filter(F.col("all") == F.col("met")).select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), "base"))
            if new.isEmpty():
                break
            settled = written(settled.unionByName(new))
            links = written(links.join(new, _at(links, "call_id", new), "left_anti"))
    ranked = placed.join(settled, _at(placed, "up", settled)).select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), (F.col("dist") + F.col("base")).alias("level"))
    lost = edges.filter("known is null").select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), F.lit(True).alias("unknown")).distinct()
    out = own.join(ranked, own["conv_id"].eqNullSafe(ranked["p_conv"]) & (own["call_id"] == ranked["p_call"]), "left").select("conv_id", "call_id", "level")
    return out.join(lost, _at(out, "call_id", lost), "left").select("conv_id", "call_id", "level", F.coalesce("unknown", F.lit(False)).alias("unknown"))


def argument_errors(arguments: Column, params: Column) -> Column:
    """What is wrong with JSON arguments under a schema, an array of (param, kind, required); null: no schema."""
    values = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(values).startswith("OBJECT")
    given = F.when(is_object, values).cast("map<string, variant>")
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))

    def of(p: Column) -> Column:
        value = F.try_element_at(given, p["param"])
        fits = F.rlike(F.schema_of_variant(value), F.concat(F.lit("^("), F.coalesce(F.try_element_at(kinds, p["kind"]), F.lit("")), F.lit(")$")))
        return F.when(value.isNull() & p["required"], F.concat(F.lit("missing "), p["param"])).when(value.isNotNull() & ~fits, F.concat(F.lit("not "), p["kind"], F.lit(": "), p["param"]))

    asked = F.array_compact(F.transform(params, of))
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(given), F.transform(params, lambda p: p["param"]))), lambda k: F.concat(F.lit("unknown "), k))
    return F.when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("arguments aren't an object"))).when(params.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.concat(asked, extra))


def linked(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, result_turn, level, status, errors and json of every call and every result without one."""
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("m"), F.count("*").alias("calls"))
    first = written(first.select("conv_id", "call_id", "m.*", "calls"))
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("answers"))
    answers = answers.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("r.turn").alias("result_turn"), "r.content", "answers")
    order = levels(first).select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_call"), "level", "unknown")
    params = tools.groupBy(F.col("name").alias("tool")).agg(F.sort_array(F.collect_set(F.struct("param", "kind", "required"))).alias("params"))

    x = first.join(order, first["conv_id"].eqNullSafe(order["o_conv"]) & (first["call_id"] == order["o_call"]), "left")
    x = x.join(answers, x["conv_id"].eqNullSafe(answers["r_conv"]) & (x["call_id"] == answers["r_call"]), "full_outer")
    x = x.join(params, x["name"] == params["tool"], "left")
    is_call = F.col("calls").isNotNull()
    errors = F.when(is_call, F.concat(argument_errors(F.col("arguments"), F.col("params")), F.array_compact(F.array(
        F.when(F.col("calls") > 1, F.lit("repeated id")), F.when(F.col("unknown"), F.lit("unknown dependency")),
    )))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(errors, F.array_compact(F.array(F.when(F.col("answers") > 1, F.lit("repeated result")))))
    status = F.when(~is_call, "no call").when(F.col("level").isNull(), "cycle").when(F.col("answers").isNull(), "no result").otherwise("linked")
    out = x.select(F.when(is_call, F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"), "turn", "result_turn", "level", status.alias("status"), errors.alias("errors"), "name", "arguments", "content")
    canonical = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "content", "errors", F.col("call_id").alias("id"), "level", "name", "status"))
    return out.withColumn("json", canonical).select("conv_id", "call_id", "turn", "result_turn", "level", "status", "errors", "json")


def turn_schemas(spark: SparkSession, roles: tuple[str, ...] = ("user", "system", "tool")) -> DataFrame:
    """The schema that turns() needs: one text for each role."""
    return schemas(spark, [(r, "text", "string", True) for r in roles])


