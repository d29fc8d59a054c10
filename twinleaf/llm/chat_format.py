"""Chat formatting with linked tool calls, in DataFrame expressions alone.

Input: one row per turn (conv_id, turn, role, text). A turn of role assistant or tool whose
text is a JSON object with an array tool_calls of {id, name, arguments} makes
calls; a turn of role tool whose text is a JSON object with tool_call_id and content
is a result, and may make calls itself. Calls and results are hash-joined by (conv_id, identifier).

Order: a turn stands at its own number, and a result after the turn of its call, even where it was recorded
before it; results of one turn stand in the order of its calls, each followed by the results of calls that it
makes. So the graph turn -> call -> result -> call -> ... is in topological order: the key (position, path)
has the turn at which a chain begins and the places of the calls along it. It is found level by level, one
join for each link of the longest chain, and needs no window over a conversation.

Arguments are validated against a schema per tool: a table (tool, parameter,
type, required). An argument that the schema lacks, a required one that is
missing, a value of another JSON type, or a tool without a schema is reported.

Every message becomes canonical JSON: keys in code point order (in UTF-16 order inside a value), no
spaces. Values keep their JSON types, and a turn with calls its content.
One row per message, never one per conversation: a conversation of any length
stays spread over tasks. Turns without calls and results are formatted where they are read; only the others are numbered, written and joined.

Edge cases: a null text is an empty content, a null role is "user"; text that
isn't such JSON, or such a turn that repeats a key in an object, is plain content. A result without a call, or a call without a
result, is kept and marked. Repeated identifiers in a conversation link to the
first call by (turn, place). Repeated rows give repeated messages, and turns of one number stay apart. Results that wait for each other
in a circle stand at their own numbers. Null conv_id or turn stay null and link
with nothing. Other columns, whatever their names, play no part. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .tables import table

#: Tools known without a table of schemas: (tool, parameter, type, required).
STANDARD_TOOLS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("fetch", "url", "string", True),
)
CALLS = "$.tool_calls"


def is_of_type(value: Column, kind: Column) -> Column:
    """Whether value, a variant, is of a JSON schema type; a type of another name takes any value but a missing one."""
    real = F.schema_of_variant(value)
    whole = (real == "BIGINT") | real.rlike(r"^DECIMAL\([0-9]+,0\)$")
    return (
        F.when(kind == "integer", whole)
        .when(kind == "number", whole | real.startswith("DECIMAL") | real.isin("DOUBLE", "FLOAT"))
        .when(kind == "boolean", real == "BOOLEAN")
        .when(kind == "string", real == "STRING")
        .when(kind == "array", real.startswith("ARRAY<"))
        .when(kind == "object", real.startswith("OBJECT<"))
        .when(kind == "null", real == "VOID")
        .otherwise(value.isNotNull())
    )


def tool_schemas(spark: SparkSession, tools=STANDARD_TOOLS) -> DataFrame:
    return spark.createDataFrame(list(tools), "tool string, parameter string, type string, required boolean")


def parsed(role: Column, text: Column) -> Column:
    """The JSON object of a turn that may make calls or be a result, as a variant; null for others."""
    return F.when(role.isin("assistant", "tool") & text.rlike(r"^\s*\{") & text.contains("tool_call"), F.try_parse_json(text))


def made_calls(o: Column) -> Column:
    """The calls of a parsed turn, null if none."""
    calls = F.try_variant_get(o, CALLS, "array<variant>")
    return F.when(F.size(calls) > 0, calls)


def answered_call(role: Column, o: Column) -> Column:
    """The identifier of the call whose result a parsed turn is."""
    return F.when(role == "tool", F.try_variant_get(o, "$.tool_call_id", "string"))


def tool_calls(turns: DataFrame) -> DataFrame:
    """(conv_id, call_id, call_turn, place, tool, arguments, given[, row]), one row per call; given is what stands for arguments, if no object."""
    calls = made_calls(parsed(F.col("role"), F.col("text")))
    row = [c for c in ("row",) if c in turns.columns]
    each = turns.where(calls.isNotNull()).select("conv_id", F.col("turn").alias("call_turn"), *row, F.posexplode(calls).alias("place", "c"))
    args = F.try_variant_get("c", "$.arguments", "map<string,variant>")
    given = F.try_variant_get("c", "$.arguments", "variant")
    return each.select(
        "conv_id",
        F.try_variant_get("c", "$.id", "string").alias("call_id"),
        "call_turn",
        "place",
        F.try_variant_get("c", "$.name", "string").alias("tool"),
        args.alias("arguments"),
        F.when(args.isNull() & (F.schema_of_variant(given) != "VOID"), F.to_json(given)).alias("given"),
        *row,
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with problems: an array of strings, empty for valid arguments of a known tool."""
    known = schemas.groupBy("tool").agg(
        F.map_from_entries(F.collect_list(F.struct("parameter", "type"))).alias("types"),
        F.collect_list(F.when(F.col("required"), F.col("parameter"))).alias("needs"),
    )
    joined = calls.join(known, "tool", "left")
    args = F.coalesce("arguments", F.from_json(F.lit("{}"), "map<string,variant>"))
    unknown = F.transform(F.filter(F.map_keys(args), lambda k: ~F.map_contains_key("types", k)), lambda k: F.concat(F.lit("unknown:"), k))
    missing = F.transform(F.filter("needs", lambda k: ~F.map_contains_key(args, k)), lambda k: F.concat(F.lit("missing:"), k))
    wrong = F.transform(
        F.filter(F.map_entries(args), lambda e: F.map_contains_key("types", e["key"]) & ~F.coalesce(is_of_type(e["value"], F.element_at("types", e["key"])), F.lit(False))),
        lambda e: F.concat(F.lit("type:"), e["key"]),
    )
    no_object = F.when(F.col("given").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("type:arguments")))
    no_tool = F.array(F.concat(F.lit("tool:"), F.coalesce("tool", F.lit(""))))
    return joined.withColumn("problems", F.when(F.col("types").isNull(), no_tool).otherwise(F.sort_array(F.concat(unknown, missing, wrong, no_object)))).drop("types", "needs")


def quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def canonical_arguments(args: Column, given: Column) -> Column:
    """JSON of the arguments with their types and with keys in order at every depth: objects in a variant hold theirs sorted."""
    pairs = F.transform(F.sort_array(F.map_keys(args)), lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(F.to_json(F.element_at(args, k)), F.lit("null"))))
    return F.coalesce(given, F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}")))


def step(place: Column) -> Column:
    """A place of a call as a part of a path, such that paths sort as strings."""
    return F.lpad((place + 1).cast("string"), 10, "0")


def placed(marked: DataFrame, linked: DataFrame) -> DataFrame:
    """(row, position, path) of marked (row, turn): linked (row, parent, place) says of which turn's call a row is the result."""
    done = front = materialize(marked.join(linked, "row", "left_anti").select("row", F.col("turn").alias("position"), F.lit("").alias("path")), "chat-placed")
    while True:
        above = front.select(F.col("row").alias("parent"), "position", F.col("path").alias("before"))
        front = materialize(linked.join(above, "parent").select("row", "position", F.concat_ws(".", F.when(F.col("before") != "", F.col("before")), step(F.col("place"))).alias("path")), "chat-placed")
        if front.isEmpty():
            return done
        done = done.unionByName(front)


def format_chat(turns: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, position, path, role, linked, valid, message): one row per turn.

    linked: for a result whether its call exists, for a turn with calls whether
    each has a result, for one that is both whether both hold, null for others. valid: whether all arguments of
    a turn's calls fit the schemas of known tools, null without calls.
    """
    spark = turns.sparkSession
    schemas = tool_schemas(spark) if schemas is None else schemas
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, o = F.col("role"), parsed(F.col("role"), F.col("text"))
    special = F.coalesce(made_calls(o).isNotNull() | answered_call(role, o).isNotNull(), F.lit(False))
    plain = rows.where(~special).select(
        "conv_id", "turn", F.col("turn").alias("position"), F.lit("").alias("path"), "role", F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("message"),
    )
    # a number for each row keeps equal turns apart; it is written, so that every join reads the same
    marked = materialize(rows.where(special).withColumn("row", F.monotonically_increasing_id()), "chat-turns")
    calls = materialize(validated(tool_calls(marked), schemas).withColumn("arguments", canonical_arguments(F.col("arguments"), F.col("given"))).drop("given"), "chat-calls")
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("call_turn", "place", "row")).alias("at"))
    results = marked.select("row", "conv_id", answered_call(role, o).alias("call_id")).where("call_id is not null")
    linked = materialize(results.join(first, ["conv_id", "call_id"]).select("row", F.col("at.row").alias("parent"), F.col("at.place").alias("place")), "chat-links")
    answered = results.select("conv_id", "call_id").distinct().withColumn("has_result", F.lit(True))
    by_row = (
        calls.join(answered, ["conv_id", "call_id"], "left")
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "call_id", "tool", "arguments"))).alias("calls"),
            F.min(F.coalesce("has_result", F.lit(False))).alias("all_answered"),
            F.min(F.size("problems") == 0).alias("valid"),
        )
    )
    told = (
        marked.join(by_row, "row", "left").join(placed(marked, linked), "row", "left").join(linked.select("row", F.lit(True).alias("has_call")), "row", "left")
        .withColumns({"o": o, "answers": answered_call(role, o)})
    )
    said = F.try_variant_get("o", "$.content", "variant")
    text_call = F.concat_ws(
        ",",
        F.transform(
            "calls",
            lambda c: F.concat(F.lit('{"arguments":'), c["arguments"], F.lit(',"id":'), quoted(F.coalesce(c["call_id"], F.lit(""))), F.lit(',"name":'), quoted(F.coalesce(c["tool"], F.lit(""))), F.lit("}")),
        ),
    )
    message = F.concat(
        F.lit('{"content":'), F.when(F.schema_of_variant(said) != "VOID", F.to_json(said)).otherwise(F.lit('""')), F.lit(',"role":'), quoted(role),
        F.when(F.col("answers").isNotNull(), F.concat(F.lit(',"tool_call_id":'), quoted(F.col("answers")))).otherwise(F.lit("")),
        F.when(F.col("calls").isNotNull(), F.concat(F.lit(',"tool_calls":['), text_call, F.lit("]"))).otherwise(F.lit("")),
        F.lit("}"),
    )
    has_call = F.col("answers").isNull() | F.coalesce("has_call", F.lit(False))
    return plain.unionByName(
        told.select(
            "conv_id", "turn", F.coalesce("position", "turn").alias("position"), F.coalesce("path", F.lit("")).alias("path"), "role",
            (has_call & F.coalesce("all_answered", F.lit(True))).alias("linked"), "valid", message.alias("message"),
        )
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def derived_calls(turns: DataFrame) -> DataFrame:
    """turns in which each assistant's makes a call of its text, and each user's after an even number of turns is the result of the turn before."""
    call = F.concat(
        F.lit('{"tool_calls":[{"name":"search","arguments":{"query":'), quoted(F.coalesce("text", F.lit(""))), F.lit(',"limit":'),
        F.when(F.col("turn") % 3 == 0, F.lit('"many"')).otherwise(F.col("turn").cast("string")), F.lit('},"id":"c'), F.col("turn").cast("string"), F.lit('"}],"content":"look"}'),
    )
    result = F.concat(F.lit('{"tool_call_id":"c'), (F.col("turn") - 1).cast("string"), F.lit('","content":'), quoted(F.coalesce("text", F.lit(""))), F.lit("}"))
    answers = (F.col("role") == "user") & (F.col("turn") % 2 == 0)
    return turns.select("conv_id", "turn", F.when(answers, F.lit("tool")).otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "assistant", call).when(answers, result).otherwise(F.col("text")).alias("text"))


def linked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over conversations with calls and results made from their turns: the tables hold none."""
    return format_chat(derived_calls(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The tables hold no tool calls: every turn is plain content there.
OP6_SQL = r"""
SELECT conv_id, turn, turn AS position, '' AS path, coalesce(role, 'user') AS role,
       CAST(NULL AS BOOLEAN) AS linked, CAST(NULL AS BOOLEAN) AS valid,
       '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'user')) AS VARCHAR) || '}' AS message
FROM conversations
"""
LINKED_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS said,
         coalesce(role = 'assistant', false) AS calls, coalesce(role = 'user' AND turn % 2 = 0, false) AS answers
  FROM conversations
), c AS (SELECT DISTINCT conv_id, turn FROM t WHERE calls), a AS (SELECT DISTINCT conv_id, turn FROM t WHERE answers)
SELECT t.conv_id, t.turn, coalesce(c.turn, t.turn) AS position, CASE WHEN c.turn IS NULL THEN '' ELSE '0000000001' END AS path,
       CASE WHEN answers THEN 'tool' ELSE role END AS role,
       CASE WHEN calls THEN a.turn IS NOT NULL WHEN answers THEN c.turn IS NOT NULL END AS linked,
       CASE WHEN calls THEN t.turn % 3 <> 0 END AS valid,
       CASE WHEN calls THEN '{"content":"look","role":"assistant","tool_calls":[{"arguments":{"limit":' || CASE WHEN t.turn % 3 = 0 THEN '"many"' ELSE t.turn::VARCHAR END
              || ',"query":' || said || '},"id":"c' || t.turn || '","name":"search"}]}'
            WHEN answers THEN '{"content":' || said || ',"role":"tool","tool_call_id":"c' || (t.turn - 1) || '"}'
            ELSE '{"content":' || said || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS message
FROM t LEFT JOIN c ON answers AND c.conv_id = t.conv_id AND c.turn = t.turn - 1
       LEFT JOIN a ON calls AND a.conv_id = t.conv_id AND a.turn = t.turn + 1
"""
