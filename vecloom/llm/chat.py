"""Chat formatting: tool calls linked to their results, ordered by dependency, checked, and written as canonical JSON.

Calls stand in assistant texts as ``<tool_call>{"id", "name", "arguments", "after"?}</tool_call>``; results are rows of role
"tool" whose text is ``{"tool_call_id", "content"}``. Both are parsed and joined by (conv_id, id) with built-in
functions only. A call depends on the ids in ``after`` and on argument values of the form "$id". Levels come from
repeated joins that settle every call whose dependencies are settled; what never settles is part of, or behind, a cycle.
JSON is canonical by way of the variant type, which keeps object keys sorted at every depth.

Each row of the conversations becomes one message; no conversation is gathered into one task.

Defined results: a null text is written without content; a null role as "user"; blocks that aren't JSON objects with an id and a name count as
broken and stay out of ``tool_calls``; of calls with one id in a conversation the earliest (turn, place) is linked, the
others have no result; ids are compared as texts, so 1 and "1" are one; arguments that aren't JSON stay as a JSON string and
are invalid, missing ones are {}; of results with one id the earliest turn counts; ids that are depended on but don't exist are
ignored; rows with a null conv_id have no links; repeated rows give repeated messages; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import fitting_join, staged

BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
#: Columns of a table of argument schemas: a row per tool and argument. Types are string, number, integer, boolean, array, object
#: and null; ``allowed`` holds canonical JSON texts, or is null where any value will do.
SCHEMAS = "tool string, argument string, type string, required boolean, allowed array<string>"
TOOLS = [
    ("search", "query", "string", True, None),
    ("search", "limit", "number", False, None),
    ("calculator", "expression", "string", True, None),
    ("weather", "city", "string", True, None),
    ("weather", "unit", "string", False, None),
]


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spare white space; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _kind(value: Column) -> Column:
    """Type of a canonical JSON value by its first character."""
    c = F.substring(value, 1, 1)
    return F.when(c == '"', "string").when(c == "{", "object").when(c == "[", "array").when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number")


def calls(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, text, place, raw, id, name, arguments, after) for every block of the rows' texts."""
    out = rows.select("conv_id", "turn", "text", F.posexplode(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(1))).alias("place", "raw"))
    field = lambda name: F.get_json_object("raw", f"$.{name}")
    after = F.coalesce(F.from_json(field("after"), "array<string>"), F.array().cast("array<string>"))
    refs = F.regexp_extract_all(F.coalesce(field("arguments"), F.lit("")), F.lit(r'"\$([^"\\]+)"'), F.lit(1))
    return out.select(
        "*", field("id").alias("id"), field("name").alias("name"),
        F.coalesce(canonical(field("arguments")), F.when(field("arguments").isNull(), F.lit("{}")), quoted(field("arguments"))).alias("arguments"), F.array_distinct(F.concat(after, refs)).alias("after"),
    )


def check_arguments(linked: DataFrame, tools: DataFrame | list[tuple]) -> DataFrame:
    """Add ``valid``: the tool is known, required arguments are there, no others are, and all have a declared type and an allowed value.

    ``tools`` is a table with the columns of ``SCHEMAS``, or such rows. Each tool's arguments become one array; a tool that takes
    none has a row with a null argument.
    """
    if not isinstance(tools, DataFrame):
        tools = linked.sparkSession.createDataFrame(tools, SCHEMAS)
    argument = F.struct("argument", "type", F.coalesce("required", F.lit(False)).alias("required"), "allowed")
    per_tool = staged(tools.where("tool is not null").groupBy(F.col("tool").alias("_tool")).agg(F.collect_set(F.when(F.col("argument").isNotNull(), argument)).alias("_schema")), "tools")
    joined = fitting_join(linked, per_tool, F.col("name") == F.col("_tool"))
    present = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    entries = F.from_json("arguments", "map<string,variant>")

    def holds(s: Column) -> Column:
        value = F.to_json(F.get(F.array(entries[s["argument"]]), 0))
        kind = _kind(value)
        typed = (kind == s["type"]) | ((s["type"] == "integer") & (kind == "number") & value.rlike("^-?[0-9]+$"))
        fits = F.coalesce(typed & (s["allowed"].isNull() | F.array_contains(s["allowed"], value)), F.lit(False))
        return F.when(F.array_contains(present, s["argument"]), fits).otherwise(~s["required"])

    known = F.col("_schema").isNotNull() & F.col("arguments").startswith("{")
    spare = F.size(F.array_except(present, F.transform("_schema", lambda s: s["argument"]))) == 0
    return joined.withColumn("valid", F.coalesce(known & spare & F.forall("_schema", holds), F.lit(False))).drop("_tool", "_schema")


def levels(found: DataFrame) -> DataFrame:
    """(conv_id, id, level): length of the longest chain of dependencies below a call; null behind a cycle."""
    nodes = staged(found.where("conv_id is not null and id is not null and name is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "after")).alias("c")).select("conv_id", "id", "c.after"), "calls")
    known = nodes.select("conv_id", F.col("id").alias("on"))
    needs = staged(nodes.select("conv_id", "id", F.explode("after").alias("on")).join(known, ["conv_id", "on"], "left_semi").select("conv_id", "id", "on"), "needs")
    settled = nodes.select("conv_id", "id").join(needs, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0))
    open_ = needs
    while not open_.isEmpty():
        settled = staged(settled, "settled")
        state = open_.join(settled.withColumnRenamed("id", "on"), ["conv_id", "on"], "left")
        ready = state.groupBy("conv_id", "id").agg(F.max("level").alias("top"), F.count(F.when(F.col("level").isNull(), 1)).alias("waits")).where("waits = 0")
        fresh = staged(ready.select("conv_id", "id", (F.col("top") + 1).alias("level")), "fresh")
        if fresh.isEmpty():
            break
        settled = settled.union(fresh)
        open_ = staged(open_.join(fresh, ["conv_id", "id"], "left_anti"), "open")
    return nodes.select("conv_id", "id").join(settled, ["conv_id", "id"], "left")


def _message(role: Column, content: Column, turn: Column, tool_calls: Column | None = None, tool_call_id: Column | None = None) -> Column:
    fields = [content.alias("content"), F.coalesce(role, F.lit("user")).alias("role")]
    if tool_call_id is not None:
        fields.append(tool_call_id.alias("tool_call_id"))
    if tool_calls is not None:
        fields.append(tool_calls.alias("tool_calls"))
    return F.to_json(F.struct(*fields, turn.alias("turn")))


def messages(conversations: DataFrame, tools: DataFrame | list[tuple] | None = None) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_invalid, n_cyclic, n_broken and the canonical message of every row."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    calling = F.coalesce((F.col("role") == "assistant") & F.col("text").rlike(BLOCK), F.lit(False))
    zero = F.lit(0).cast("long")
    is_result = F.coalesce((F.col("role") == "tool") & F.get_json_object("text", "$.tool_call_id").isNotNull(), F.lit(False))
    content = F.when(is_result, F.get_json_object("text", "$.content")).otherwise(F.col("text"))
    plain = rows.where(~calling).select(
        "conv_id", "turn", "role", *[zero.alias(c) for c in ("n_calls", "n_linked", "n_invalid", "n_cyclic", "n_broken")],
        _message(F.col("role"), content, F.col("turn"), tool_call_id=F.when(is_result, F.get_json_object("text", "$.tool_call_id"))).alias("message"),
    )
    with_calls = rows.where(calling)
    found = staged(calls(with_calls.select("conv_id", "turn", "text").distinct()), "found")
    if found.isEmpty():
        return plain
    results = (
        rows.where(is_result).select("conv_id", F.get_json_object("text", "$.tool_call_id").alias("id"), "turn", F.get_json_object("text", "$.content").alias("result"))
        .groupBy("conv_id", "id").agg(F.min(F.struct("turn", "result")).alias("r")).select("conv_id", "id", F.col("r.result").alias("result"), F.lit(True).alias("linked"))
    )
    first = found.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place")).alias("f")).select("conv_id", "id", "f.turn", "f.place", F.lit(True).alias("first"))
    joined = check_arguments(found, TOOLS if tools is None else tools)
    joined = joined.join(first, ["conv_id", "id", "turn", "place"], "left").join(levels(found), ["conv_id", "id"], "left").join(results, ["conv_id", "id"], "left")
    linked = F.coalesce(F.col("linked") & F.col("first"), F.lit(False))
    whole = F.col("id").isNotNull() & F.col("name").isNotNull()
    entry = F.struct(
        F.coalesce("level", F.lit(2147483647)).alias("level"), "place",
        F.to_json(F.struct(F.parse_json("arguments").alias("arguments"), "id", F.col("level").alias("level"), "name", F.when(linked, F.col("result")).alias("result"), "valid")).alias("json"),
    )
    per_row = joined.groupBy("conv_id", "turn", "text").agg(
        F.count("*").alias("n_calls"), F.count(F.when(linked & whole, 1)).alias("n_linked"), F.count(F.when(whole & ~F.col("valid"), 1)).alias("n_invalid"),
        F.count(F.when(whole & F.col("level").isNull() & F.col("conv_id").isNotNull(), 1)).alias("n_cyclic"), F.count(F.when(~whole, 1)).alias("n_broken"),
        F.sort_array(F.collect_list(F.when(whole, entry))).alias("entries"),
    ).select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("text").alias("_x"), "n_calls", "n_linked", "n_invalid", "n_cyclic", "n_broken",
        F.parse_json(F.concat(F.lit("["), F.array_join(F.transform("entries", lambda e: e["json"]), ","), F.lit("]"))).alias("entries"),
    )
    back = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("text") == F.col("_x"))
    text = F.trim(F.regexp_replace("text", BLOCK, ""))
    done = with_calls.join(per_row, back).select(
        "conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "n_cyclic", "n_broken", _message(F.col("role"), text, F.col("turn"), tool_calls=F.col("entries")).alias("message")
    )
    return plain.union(done)
