"""Tool calls and their results: linked by identifier, ordered, validated, and written as canonical JSON. Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Schemas of the two tools that the conversations query derives its calls from.
SCHEMAS = {
    "reply": {"properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"]},
    "configure": {"properties": {"instructions": {"type": "string", "minLength": 1}}, "required": ["instructions"]},
}
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def calls_from_conversations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation seen as tool use: (calls, results).

    A user turn calls `reply` with {prompt, turn}, a system turn calls `configure` with {instructions}; the assistant
    turn right after calls is the result of each. A call waits for the calls right before it: those of the turn before, or,
    if only an assistant spoke there, of the one before that. Neighbours are found by joins on (conversation, turn), so a
    conversation of any length is no single group. Rows of one conversation, turn and role are one, that of the least
    text; roles that share a turn count each (a call is named conversation:turn, and conversation:turn:system beside a
    user's). A null text is empty. Rows without conv_id, turn or a known role are left out; other columns are ignored.
    """
    rows = df.where("conv_id is not null and turn is not null and role in ('user', 'system', 'assistant')").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    says = {r: F.min(F.when(F.col("role") == r, F.col("text"))).alias(r) for r in ("user", "system", "assistant")}
    turns = rows.groupBy("conv_id", "turn").agg(*says.values())

    def names(turn: Column, user: Column, system: Column) -> Column:
        name = F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
        return F.array_compact(F.array(F.when(user, name), F.when(system & user, F.concat(name, F.lit(":system"))).when(system, name)))

    there = {r: F.coalesce(F.col(r).isNotNull(), F.lit(False)) for r in says}
    marks = turns.select("conv_id", "turn", *[there[r].alias(r) for r in says])
    back = lambda k: marks.select("conv_id", (F.col("turn") + k).alias("turn"), *[F.col(r).alias(f"{r}{k}") for r in says])
    was = lambda r, k: F.coalesce(F.col(f"{r}{k}"), F.lit(False))
    near = turns.join(back(1), ["conv_id", "turn"], "left").withColumn("calls1", names(F.col("turn") - 1, was("user", 1), was("system", 1)))
    results = near.where((F.size("calls1") > 0) & there["assistant"]).select("conv_id", F.explode("calls1").alias("call_id"), F.col("assistant").alias("content"), F.col("turn").alias("position"))
    asked = near.where(there["user"] | there["system"]).join(back(2), ["conv_id", "turn"], "left")
    waits = F.when(F.size("calls1") > 0, F.col("calls1")).when(was("assistant", 1), names(F.col("turn") - 2, was("user", 2), was("system", 2))).otherwise(F.array().cast("array<string>"))
    own = names(F.col("turn"), there["user"], there["system"])
    reply = F.when(there["user"], F.struct(F.lit("reply").alias("name"), F.to_json(F.struct(F.col("turn"), F.col("user").alias("prompt"))).alias("arguments")))
    configure = F.when(there["system"], F.struct(F.lit("configure").alias("name"), F.to_json(F.struct(F.col("system").alias("instructions"))).alias("arguments")))
    calls = asked.select("conv_id", waits.alias("waits_for"), F.col("turn").alias("position"), F.explode(F.arrays_zip(own.alias("call_id"), F.array_compact(F.array(reply, configure)).alias("c"))).alias("x"))
    return calls.select("conv_id", F.col("x.call_id").alias("call_id"), "x.c.name", "x.c.arguments", "waits_for", "position"), results


def _shaped(kinds: list[str]):
    """Whether a variant has one of the shapes, as a function of one column."""

    def fits(x: Column) -> Column:
        good = F.lit(False)
        for kind in kinds:
            good = good | F.schema_of_variant(x).startswith(kind)
        return F.coalesce(good, F.lit(False))

    return fits


def _object_errors(value: Column, schema: dict, within: str) -> Column:
    """Array of what is wrong with the fields of a variant object, deeper objects included; errors name fields by their path.

    Fields are looked up by their name in a map, not by a path, so a name may hold dots, brackets and quotes.
    """
    fields = F.try_variant_get(value, "$", "map<string, variant>")
    keys = F.map_keys(fields)
    checks, deeper = [], []
    for field in schema.get("required", []):
        checks.append(F.when(~F.coalesce(F.array_contains(keys, field), F.lit(False)), F.lit(f"missing {within}{field}")))
    for field, rule in schema.get("properties", {}).items():
        child = F.try_element_at(fields, F.lit(field))
        have, shape = F.coalesce(F.array_contains(keys, field), F.lit(False)), F.schema_of_variant(child)
        good = F.lit(False)
        for prefix in _TYPES[rule["type"]]:
            good = good | shape.startswith(prefix)
        good = F.coalesce(good, F.lit(False))
        checks.append(F.when(have & ~good, F.lit(f"{within}{field} is not {rule['type']}")))
        text, number = F.try_variant_get(child, "$", "string"), F.try_variant_get(child, "$", "double")
        for limit, wrong in (("minLength", lambda n, t=text: F.length(t) < n), ("maxLength", lambda n, t=text: F.length(t) > n), ("minimum", lambda n, x=number: x < n), ("maximum", lambda n, x=number: x > n), ("enum", lambda n, t=text: ~t.isin(*map(str, n)))):
            if limit in rule:
                checks.append(F.when(have & good & wrong(rule[limit]), F.lit(f"{within}{field} breaks {limit}")))
        if "items" in rule:
            items = F.try_variant_get(child, "$", "array<variant>")
            checks.append(F.when(have & good & ~F.coalesce(F.forall(items, _shaped(_TYPES[rule["items"]["type"]])), F.lit(True)), F.lit(f"{within}{field} holds what is not {rule['items']['type']}")))
        if rule["type"] == "object" and ("properties" in rule or "required" in rule):
            deeper.append(F.when(have & good, _object_errors(child, rule, f"{within}{field}.")).otherwise(F.array().cast("array<string>")))
    found = [F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")]
    if not schema.get("additionalProperties"):
        extra = F.array_except(keys, F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>"))
        found.append(F.transform(extra, lambda k: F.concat(F.lit(f"unknown field {within}"), k)))
    return F.concat(*found, *deeper)


def argument_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Array of what is wrong with the arguments of a call; empty if nothing.

    Schemas name types, required fields, bounds, enums, item types of arrays and deeper objects. What Spark's variant
    cannot hold (no JSON, a repeated key, over 128 MB) is "not an object".
    """
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, schema in schemas.items():
        out = F.when(name == tool, F.when(value.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(_object_errors(value, schema, ""))).otherwise(out)
    return out


def topological_levels(calls: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more than the highest level waited for.

    Runs of calls that wait for one call each are shortened first: every call points at what it waits for and pointers
    are doubled until they reach an end, a call that waits for none or for several. A chain of n calls takes log2(n)
    rounds. Then Kahn's rounds by joins settle the ends that wait for several, as many as the longest chain of such
    ends. Identifiers that name no call of the conversation are ignored. Calls on or behind a cycle get no row.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key, F.array_distinct("waits_for").alias("w"))
    edges = nodes.select(*key, F.explode("w").alias("on"))
    edges = stored(edges.join(nodes.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi"), "waits")
    need = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("need"), F.min("on").alias("on"))
    start = nodes.select(*key).join(need, key, "left").select(*key, F.coalesce("need", F.lit(0)).alias("need"), "on")
    one = F.col("need") == 1
    state = stored(start.select(*key, "need", F.when(one, F.col("on")).otherwise(F.col("call_id")).alias("to"), one.cast("long").alias("dist"), (~one).alias("ended")), "pointers")
    number = state.count()
    for k in range(number.bit_length() + 1):
        if state.where("not ended").isEmpty():
            break
        there = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("ended").alias("end"))
        moved = state.where("not ended").join(there, ["conv_id", "to"]).select(*key, "need", F.col("next").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("end").alias("ended"))
        state, before = stored(state.where("ended").union(moved), "pointers"), state
        drop_stored(before)
    ends = state.where("ended and need <> 1")
    if ends.where("need > 1").isEmpty():
        return state.where("ended").select(*key, F.col("dist").alias("level"))
    reach = state.where("ended").select("conv_id", F.col("call_id").alias("on"), F.col("to").alias("end"), (F.col("dist") + 1).alias("weight"))
    several = edges.join(ends.where("need > 1").select(*key), key, "left_semi")
    links = stored(several.join(reach, ["conv_id", "on"]).select(*key, "end", "weight"), "links")
    layer = stored(ends.where("need = 0").select(*key, F.lit(0).cast("long").alias("level")), "level")
    waiting, previous, layers = ends.where("need > 1").select(*key, "need", F.lit(0).cast("long").alias("level")), None, [layer]
    for _ in range(max_rounds):
        if layer.isEmpty():
            break
        met = links.join(layer.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("base")), ["conv_id", "end"])
        met = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.max(F.col("base") + F.col("weight")).alias("high"))
        left = waiting.join(met, key, "left").select(*key, (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), F.greatest("level", F.coalesce("high", F.lit(0))).alias("level"))
        left = stored(left, "calls")
        layer = stored(left.where("need = 0").select(*key, "level"), "level")
        layers.append(layer)
        waiting = left.where("need > 0")
        if previous is not None:
            drop_stored(previous)
        previous = left
    else:
        raise RuntimeError("the chain of calls that wait for several is longer than max_rounds")
    settled = layers[0]
    for more in layers[1:]:
        settled = settled.union(more)
    settled = settled.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base"))
    return state.where("ended").join(settled, ["conv_id", "to"]).select(*key, (F.col("base") + F.col("dist")).alias("level"))


def in_order(linked: DataFrame) -> DataFrame:
    """linked + place, from 0 in each conversation by level (null last), position and call_id.

    Rows are dealt to ranges of that order and numbered within their part, so a conversation with a third of all calls is
    sorted by many tasks; a part's start in a conversation is a running count over a row for each part that holds some of it.
    """
    order = [F.col("conv_id"), F.col("level").isNull(), F.col("level"), F.col("position"), F.col("call_id")]
    parts = stored(linked.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    starts = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    return parts.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["conv_id", "part"]).withColumn("place", (F.col("start") + F.col("nth")).cast("long")).drop("part", "nth", "start")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row a call: (conv_id, call_id, name, level, place, n_results, valid, errors, canonical, result_position).

    calls: conv_id, call_id, name, arguments (JSON), waits_for (identifiers), position; results: conv_id, call_id,
    content, position. Results are hash-joined to calls by identifier; of several the first counts, and so does the
    first of calls that repeat an identifier. level is null on and behind cycles. place
    numbers a conversation's calls from 0 in topological order: by level, then position, then identifier, cycles last.
    Arguments that are no JSON object are invalid
    and canonically null. canonical has keys in order and no white space; rows with a null identifier are left out.
    Results that name no call are left out.
    """
    calls = stored(calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "name", "arguments", "waits_for")).alias("c")).select("conv_id", "call_id", "c.*"), "calls")
    first = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("position", "content")).alias("r"))
    levels = topological_levels(calls)
    linked = in_order(calls.hint("shuffle_hash").join(first, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left"))
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    ordered = F.to_json(F.try_parse_json(F.coalesce("arguments", F.lit("null"))))  # variant objects keep their keys in order
    canonical = F.concat(F.lit('{"arguments":'), F.coalesce(ordered, F.lit("null")), F.lit(',"id":'), _string(F.col("call_id")), F.lit(',"name":'), F.coalesce(_string(F.col("name")), F.lit("null")), F.lit(',"result":'), F.coalesce(_string(F.col("r.content")), F.lit("null")), F.lit("}"))
    return linked.select("conv_id", "call_id", "name", "level", "place", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), canonical.alias("canonical"), F.col("r.position").alias("result_position"))


def _string(c: Column) -> Column:
    """A JSON string literal."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
