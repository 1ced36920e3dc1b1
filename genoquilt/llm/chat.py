"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Messages are rows (conversation, turn, role, text). Calls stand in an assistant message as
``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>``; a message of role ``tool`` is a
result and holds ``{"tool_call_id": ..., "content": ...}``. Calls and results are hash-joined by (conversation,
identifier). The order is topological: a result never stands before the message that calls for it.
Everything is DataFrame expressions and equi-joins; messages stay rows, so no conversation has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The JSON types that an argument's schema can name, and the first characters that such a value has.
_STARTS = {"string": '^"', "integer": r"^-?\d+$", "number": r"^-?\d", "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{"}
_CALL = r"(?s)<tool_call>(.*?)</tool_call>"


def _checked(arguments: Column, schema: Column) -> Column:
    """Whether a map of raw JSON arguments has all that the schema requires, nothing it does not name, and its types."""
    required = F.forall(F.coalesce(schema["required"], F.array().cast("array<string>")), lambda k: F.array_contains(F.map_keys(arguments), k))
    typed = F.forall(F.map_entries(arguments), lambda e: F.coalesce(_is_a(e["value"], schema["types"][e["key"]]), F.lit(False)))
    return F.coalesce(required & typed, F.lit(False))


def _is_a(value: Column, kind: Column) -> Column:
    out = F.lit(False)
    for name, pattern in _STARTS.items():
        out = F.when(kind == name, value.rlike(pattern)).otherwise(out)
    return out


def _raw_map(json: Column) -> Column:
    """A JSON object as map<string, string> with each value as JSON text: strings keep their quotes. Null if it is none."""
    plain = F.from_json(json, "map<string,string>")
    kinds = F.from_json(json, "map<string,variant>")
    return F.when(plain.isNotNull(), F.transform_values(kinds, lambda k, v: F.to_json(v)))


def parse_calls(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, t1, t2, at, call_id, name, arguments map<string,string>) for each call of a distinct assistant message,
    which its conversation, turn and two hashes of its text name. ``arguments`` has raw JSON values. Text that is not a
    JSON object gives a call with null id and name."""
    # within the generator each text is parsed once, not once a column; "outer", as Spark puts a filter with the same transforms before others
    one = lambda b: F.struct(b["id"].alias("call_id"), b["name"].alias("name"), _raw_map(b["arguments"]).alias("arguments"))
    calls = _calling(messages, conv, turn, role, text)
    calls = calls.select("conv", "turn", "t1", "t2", F.posexplode_outer(F.transform(F.transform("raw", _body), one)).alias("at", "call")).where("at is not null")
    return calls.select("conv", "turn", "t1", "t2", "at", "call.call_id", "call.name", "call.arguments")


def _calling(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, t1, t2, raw array<string>) for each distinct assistant message with calls."""
    found = messages.where((F.col(role) == "assistant") & F.col(text).contains("<tool_call>"))
    found = found.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *_marks(F.col(text)), F.regexp_extract_all(text, F.lit(_CALL), 1).alias("raw"))
    return found.dropDuplicates(["conv", "turn", "t1", "t2"])


def _body(raw: Column) -> Column:
    return F.from_json(raw, "id string, name string, arguments string")


def _marks(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _call_json() -> Column:
    entry = lambda e: F.concat(_quote(e["key"]), F.lit(":"), e["value"])
    arguments = F.array_join(F.transform(F.array_sort(F.map_entries("arguments")), entry), ",")
    or_null = lambda c: F.coalesce(_quote(F.col(c)), F.lit("null"))
    return F.concat(F.lit('{"arguments":{'), F.coalesce(arguments, F.lit("")), F.lit('},"id":'), or_null("call_id"), F.lit(',"name":'), or_null("name"), F.lit("}"))


def _judged(calls: DataFrame, tools: DataFrame | None) -> DataFrame:
    if tools is None:
        return calls.withColumn("valid", F.lit(None).cast("boolean"))
    # a registry of tools: Spark broadcasts it if it is small
    known = tools.select(F.col("name").alias("tool"), F.struct("required", "types").alias("schema")).dropDuplicates(["tool"])
    fits = F.col("tool").isNotNull() & F.col("arguments").isNotNull() & _checked(F.col("arguments"), F.col("schema"))
    return calls.join(known, F.col("name") == F.col("tool"), "left").withColumn("valid", F.coalesce(fits, F.lit(False)))


def format_chats(messages: DataFrame, tools: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message: (conv, turn, role, place long, n_calls int, call_id, linked boolean, valid boolean, message string).

    ``place``: messages ordered by it, then by whether they are results, then by turn, are topologically
    ordered: a result's place is the later of its own turn and its call's. ``message``: canonical JSON, keys in
    order, no white space. ``linked``: every call of the message has a result, or the result has a call; null
    for other messages. ``valid``: each call's arguments fit ``tools`` (name, required array<string>, types
    map<string,string>); null without calls, false for unknown tools.

    Calls and results are hash-joined by (conversation, identifier), where a null conversation equals itself and a null
    identifier nothing. Null role or text count as empty; null turns come first, as place -1. If several calls share an
    identifier, a result belongs to the earliest. Repeated rows are kept, each with the same answer; messages of one turn with
    different texts have calls of their own. Other columns are ignored. An empty table gives no rows. Messages without
    calls that are no results are never shuffled.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    msgs = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"))
    own = F.coalesce("turn", F.lit(-1).cast("long"))
    calls = parse_calls(msgs, "conv", "turn", "role", "text")
    result_id = F.when(F.col("role") == "tool", F.get_json_object("text", "$.tool_call_id"))
    answers = msgs.where(F.col("role") == "tool").withColumn("call_id", result_id)

    has = answers.where("call_id is not null").select(F.col("conv").alias("r_conv"), F.col("call_id").alias("r_id")).distinct()
    judged = _judged(calls, tools).join(has, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left")
    per_message = judged.groupBy(F.col("conv").alias("c_conv"), F.col("turn").alias("c_turn"), F.col("t1").alias("c1"), F.col("t2").alias("c2")).agg(
        F.count(F.lit(1)).cast("int").alias("n_calls"), F.bool_and(F.col("r_id").isNotNull()).alias("linked"), F.bool_and("valid").alias("valid"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", _call_json().alias("json")))), lambda c: c["json"]).alias("calls"),
    )
    ids = F.explode_outer(F.transform("raw", lambda r: _body(r)["id"])).alias("call_id")
    callers = _calling(msgs, "conv", "turn", "role", "text").select("conv", "turn", ids).where("call_id is not null").groupBy(F.col("conv").alias("r_conv"), F.col("call_id").alias("r_id")).agg(F.min(own).alias("called"))

    calling = (F.col("role") == "assistant") & F.col("text").contains("<tool_call>")
    same = F.col("conv").eqNullSafe(F.col("c_conv")) & F.col("turn").eqNullSafe(F.col("c_turn")) & (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2"))
    with_calls = msgs.where(calling).select("*", *_marks(F.col("text"))).join(per_message, same, "left")
    linked = answers.join(callers, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left")
    nothing = {"n_calls": "int", "linked": "boolean", "valid": "boolean", "calls": "array<string>", "call_id": "string", "called": "long"}

    def whole(df: DataFrame) -> DataFrame:
        return df.select("conv", "turn", "role", "text", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()))

    plain = msgs.where(~calling & (F.col("role") != "tool"))
    out = whole(plain).unionByName(whole(with_calls)).unionByName(whole(linked.withColumn("linked", F.col("called").isNotNull())))

    without_calls = F.trim(F.regexp_replace("text", _CALL, ""))
    content = F.when(F.col("n_calls") > 0, without_calls).when(F.col("call_id").isNotNull(), F.coalesce(F.get_json_object("text", "$.content"), F.lit(""))).otherwise(F.col("text"))
    message = F.concat(
        F.lit('{"content":'), _quote(content), F.lit(',"role":'), _quote(F.col("role")),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), _quote(F.col("call_id")))).otherwise(F.lit("")),
        F.when(F.col("n_calls") > 0, F.concat(F.lit(',"tool_calls":['), F.array_join("calls", ","), F.lit("]"))).otherwise(F.lit("")), F.lit("}"),
    )
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.greatest(own, F.col("called")).alias("place"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "call_id", "linked", "valid", message.alias("message"),
    )


def _quote(c: Column) -> Column:
    """A string as a JSON string: to_json of a one-element array without its brackets; null stays null."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")
