"""Chat formatting with linked tool calls.

Calls and results meet by conversation and identifier in a hash join. Each call
and result gets a place that respects what it needs: the turn it can come at,
and its depth among what became possible at that turn. Arguments are checked
against the parameters of their tool, and every message is written as
canonical JSON: keys in order, no white space, equal numbers in one form.

All tables are keyed by conversation *and* identifier, and places are sort keys
instead of row numbers, so a conversation of any length spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import Scratch, union_all
from logweir.session import configure

KEY = ["conv_id", "node_id"]


def link_results(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``calls`` with ``status`` answered or unanswered, ``results`` with result or orphan.

    Both have ``conv_id, call_id``. Rows without an identifier stay unlinked;
    several results of one call are all linked to it.
    """
    key = ["conv_id", "call_id"]
    answered = results.select(*key).distinct().withColumn("found", F.lit(True))
    called = calls.select(*key).distinct().withColumn("found", F.lit(True))
    status = lambda yes, no: F.when(F.col("found"), yes).otherwise(no)
    linked = calls.join(answered, key, "left").withColumn("status", status("answered", "unanswered")).drop("found")
    return linked, results.join(called, key, "left").withColumn("status", status("result", "orphan")).drop("found")


def place_nodes(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """``conv_id, node_id, at, depth, cyclic``: where each node can come.

    ``nodes`` has ``conv_id, node_id, turn``, ``needs`` has ``conv_id, node_id, needed_id``.
    A node comes at its own turn, or at the turn of a needed node that comes
    later, one deeper. Ordering by ``(at, depth)`` puts every node behind what it
    needs. Each round raises the nodes that are not yet behind theirs; what is
    in order by its turns takes no round, so the rounds are as many as the
    longest chain of late nodes. A depth above the number of nodes raised in
    a conversation shows a cycle; its nodes, and those behind them, keep their
    own turn and are marked. Needed nodes that don't exist are ignored.
    """
    scratch = Scratch(nodes.sparkSession)
    first = nodes.groupBy(*KEY).agg(F.min("turn").alias("turn"))
    now = scratch.keep(first.withColumns({"at": F.col("turn"), "depth": F.lit(0), "cyclic": F.lit(False)}), "places-0")
    needs = scratch.keep(needs.select("conv_id", "node_id", "needed_id").distinct(), "needs")
    turn = 0
    while True:
        turn += 1
        raised = scratch.keep(_raised(now, needs), f"raised-{turn}")
        if raised.isEmpty():
            break
        joined = now.join(raised, KEY, "left")
        place, cyclic = F.greatest(F.struct("at", "depth"), F.col("place")), F.col("cyclic") | F.coalesce("behind_cycle", F.lit(False))
        moved = joined.select(*KEY, "turn", place.alias("place"), cyclic.alias("cyclic"))
        moved = moved.select(*KEY, "turn", F.col("place.at").alias("at"), F.col("place.depth").alias("depth"), "cyclic")
        limits = moved.where("depth > 0").groupBy("conv_id").agg(F.count("*").alias("late"))
        circling = moved.where("depth > 0").join(limits, "conv_id").where("depth > late").select(*KEY, F.lit(True).alias("found"))
        marked = moved.join(circling, KEY, "left").withColumn("cyclic", F.col("cyclic") | F.coalesce("found", F.lit(False)))
        at, depth = F.when(F.col("cyclic"), F.col("turn")).otherwise(F.col("at")), F.when(F.col("cyclic"), 0).otherwise(F.col("depth"))
        now = scratch.keep(marked.select(*KEY, "turn", at.alias("at"), depth.alias("depth"), "cyclic"), f"places-{turn}")
        scratch.drop(f"places-{turn - 1}", f"raised-{turn}")
    return now.drop("turn")


def _raised(now: DataFrame, needs: DataFrame) -> DataFrame:
    """The nodes that don't come behind all they need, with the place where they do, and those that need a cyclic one."""
    place = F.when(~F.col("cyclic"), F.struct(F.col("at"), (F.col("depth") + 1).alias("depth")))
    needed = now.select("conv_id", F.col("node_id").alias("needed_id"), place.alias("place"), F.col("cyclic").alias("behind_cycle"))
    least = needs.join(needed, ["conv_id", "needed_id"]).groupBy(*KEY).agg(F.max("place").alias("place"), F.max("behind_cycle").alias("behind_cycle"))
    own = now.where("not cyclic").select(*KEY, F.struct("at", "depth").alias("own"))
    behind = (F.col("own.at") > F.col("place.at")) | (F.col("own.at") == F.col("place.at")) & (F.col("own.depth") >= F.col("place.depth"))
    return least.join(own, KEY).where(F.col("behind_cycle") | ~behind).select(*KEY, "place", "behind_cycle")


def kind_of(value: Column) -> Column:
    """The JSON type of a variant value: string, integer, number, boolean, null, array or object."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), "null")
        .when(name == "STRING", "string").when(name == "BIGINT", "integer").when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    )


def validate_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """``conv_id, call_id, errors`` of the calls with faulty arguments; ``errors`` is sorted.

    ``calls`` has ``conv_id, call_id, tool, arguments`` (JSON text), ``parameters`` has ``tool,
    parameter, kind, required``. A fault is ``no object`` (a number beyond doubles included), ``unknown tool``, or
    ``missing``, ``unknown`` or ``type`` with the parameter's name. An integer is a number as well.
    """
    configure(calls.sparkSession)
    whole = F.when(is_finite(F.col("arguments")), F.try_parse_json("arguments"))
    own = calls.select("conv_id", "call_id", "tool", whole.alias("whole"))
    own = own.withColumn("given", F.from_json(F.to_json("whole"), "map<string,variant>"))
    is_object = F.coalesce(F.schema_of_variant("whole").startswith("OBJECT"), F.lit(False))
    known = own.where(is_object)
    given = known.select("conv_id", "call_id", "tool", F.explode("given").alias("parameter", "value"))
    given = given.select("conv_id", "call_id", "tool", "parameter", kind_of(F.col("value")).alias("found"))
    tools = parameters.select("tool").distinct().withColumn("is_tool", F.lit(True))
    in_tool = given.join(tools, "tool").join(parameters, ["tool", "parameter"], "left")
    fits = (F.col("kind") == F.col("found")) | (F.col("kind") == "number") & (F.col("found") == "integer")
    wrong = in_tool.where(F.col("kind").isNull() | ~fits)
    wrong = wrong.select("conv_id", "call_id", F.concat(F.when(F.col("kind").isNull(), "unknown ").otherwise("type "), "parameter").alias("error"))
    wanted = known.select("conv_id", "call_id", "tool").join(parameters.where("required").select("tool", "parameter"), "tool")
    missing = wanted.join(given.select("conv_id", "call_id", "tool", "parameter"), ["conv_id", "call_id", "tool", "parameter"], "left_anti")
    missing = missing.select("conv_id", "call_id", F.concat(F.lit("missing "), "parameter").alias("error"))
    no_object = own.where(~is_object).select("conv_id", "call_id", F.lit("no object").alias("error"))
    no_tool = own.join(tools, "tool", "left").where("is_tool is null").select("conv_id", "call_id", F.lit("unknown tool").alias("error"))
    faults = union_all([wrong, missing, no_object, no_tool]).distinct()
    return faults.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?[0-9][-+0-9.eE]*+"


def _number(token: Column) -> Column:
    """A JSON number as the text of its double: plain from 1e-6 to 1e21, otherwise with an exponent; no zeros at the ends."""
    value = token.cast("double")
    # Java's text of the absolute value: digits, a point, digits, perhaps an exponent.
    text = F.abs(value).cast("string")
    mantissa, exponent = F.substring_index(text, "E", 1), F.coalesce(F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1)), F.lit("0")).cast("int")
    whole, rest = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    every = F.concat(whole, rest)
    digits = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
    # The point stands behind so many of the digits.
    point = F.length(whole) + exponent - (F.length(every) - F.length(F.ltrim(every, F.lit("0"))))
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k)
    scientific = F.concat(
        F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
        F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"),
    )
    plain = (
        F.when((point >= n) & (point <= 21), F.concat(digits, zeros(point - n)))
        .when((point > 0) & (point <= 21), F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
        .otherwise(scientific)
    )
    return F.when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), plain))


def _tokens(json: Column) -> Column:
    return F.regexp_extract_all(json, F.lit(rf'{_STRING}|{_NUMBER}|[^"0-9-]++'), F.lit(0))


def is_finite(json: Column) -> Column:
    """Whether all numbers of a JSON text are doubles."""
    return ~F.exists(_tokens(json), lambda token: token.rlike("^-?[0-9]") & (F.abs(token.try_cast("double")) == float("inf")))


def canonical(json: Column) -> Column:
    """JSON text in canonical form: keys in order, no white space, one text for numbers that are the same double.

    Null if it is no JSON or has a number that no finite double stands for. Of
    repeated keys the last counts (:func:`logweir.session.configure`).
    """
    text = F.to_json(F.try_parse_json(json))
    written = F.transform(_tokens(text), lambda token: F.when(token.rlike("^-?[0-9]"), _number(token)).otherwise(token))
    return F.when(is_finite(json), F.array_join(written, ""))


def format_chat(messages: DataFrame, parameters: DataFrame) -> DataFrame:
    """``conv_id, turn, role, call_id, status, order_turn, order_depth, errors, message`` for every row of ``messages``.

    ``messages`` has ``conv_id, turn, role, text, call_id, tool, arguments, needs``: a row with
    ``tool`` is a call, another one with ``call_id`` is a result, the rest is plain.
    ``needs`` (array) names calls of the same conversation that must come first; a
    result needs its call. Messages are sorted by ``order_turn, order_depth, turn``; a
    plain one stays at its turn. ``status`` is answered, unanswered, result, orphan or plain,
    with ``cyclic`` for what needs itself. Null text becomes JSON null. Rows alike
    in conversation and identifier share links and place. An empty table gives
    no rows; other columns are ignored.
    """
    is_call, is_result = F.col("tool").isNotNull(), F.col("tool").isNull() & F.col("call_id").isNotNull()
    columns = ["conv_id", "turn", "role", "text", "call_id", "tool", "arguments"]
    rows = messages.select(*columns, "needs")
    calls, results = link_results(rows.where(is_call), rows.where(is_result))
    node = F.concat(F.when(is_call, "call ").otherwise("result "), "call_id")
    called = F.concat(F.lit("call "), F.col("call_id"))
    nodes = union_all([calls, results]).select("conv_id", node.alias("node_id"), "turn")
    by_need = calls.select("conv_id", called.alias("node_id"), F.explode("needs").alias("needed")).select("conv_id", "node_id", F.concat(F.lit("call "), "needed").alias("needed_id"))
    by_call = results.select("conv_id", node.alias("node_id"), called.alias("needed_id"))
    places = place_nodes(nodes.where("conv_id is not null and node_id is not null"), union_all([by_need, by_call]).where("needed_id is not null"))
    faults = validate_arguments(calls, parameters)

    calls = calls.join(faults, ["conv_id", "call_id"], "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    none = F.lit(None).cast("array<string>")
    plain = rows.where(~is_call & ~is_result).withColumn("status", F.lit("plain"))
    every = union_all([f.select(*columns, "status", "errors") for f in (calls, results.withColumn("errors", none), plain.withColumn("errors", none))])
    every = every.withColumn("node_id", node).join(places, KEY, "left")
    status = F.when(F.coalesce("cyclic", F.lit(False)), "cyclic").otherwise(F.col("status"))
    quoted = lambda value: F.coalesce(F.to_json(F.to_variant_object(F.array(value))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(value)))) - 2), F.lit("null"))
    call = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), quoted(F.col("tool")), F.lit(',"valid":'), (F.size("errors") == 0).cast("string"), F.lit("}"),
    )
    message = F.concat(
        F.when(is_call, F.concat(F.lit('{"call":'), call, F.lit(","))).otherwise("{"), F.lit('"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")),
        F.when(is_result, F.concat(F.lit(',"tool_call_id":'), quoted(F.col("call_id")))).otherwise(""), F.lit("}"),
    )
    return every.select(
        "conv_id", "turn", "role", "call_id", status.alias("status"), F.coalesce("at", "turn").alias("order_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("order_depth"), F.array_join("errors", "; ").alias("errors"), message.alias("message"),
    )
