"""The test table ``conversations`` as chat messages with tool calls.

Every message of a user is a call whose arguments hold its whole text, and the
next message of the assistant is its result. Some arguments are faulty, and some
calls need a later one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``tool, parameter, kind, required``
PARAMETERS = [
    ("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "exact", "boolean", False),
    ("count", "text", "string", True), ("count", "unit", "string", True),
    ("lookup", "key", "string", True), ("lookup", "depth", "number", False),
]


def parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMETERS, "tool string, parameter string, kind string, required boolean")


def messages(conversations: DataFrame) -> DataFrame:
    """``conversations`` (``conv_id, turn, role, text``) in the shape that ``format_chat`` takes."""
    number, size = lambda turn: F.concat_ws("-", "conv_id", turn), F.length("text")
    user, kind = F.col("role") == "user", F.pmod("turn", F.lit(3))
    tool = F.when(kind == 0, "search").when(kind == 1, "count").otherwise("lookup")
    arguments = (
        F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit"), (F.col("turn") % 2 == 0).alias("exact"))))
        .when((kind == 1) & (size % 5 == 0), F.to_json(F.struct(F.lit("words").alias("units"), F.col("text").alias("text"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("words").alias("unit"), F.col("text").alias("text"))))
        .when(size % 7 == 0, F.to_json(F.struct(size.alias("key"), F.lit(2).alias("depth"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("key"), F.lit(2).alias("depth"))))
    )
    # A call needs the one two turns before; one in eight turns needs the one two turns after instead.
    needs = F.array(number(F.when(F.col("turn") % 8 == 2, F.col("turn") + 2).when(F.col("turn") % 8 != 4, F.col("turn") - 2)))
    call_id = F.when(user, number(F.col("turn"))).when(F.col("role") == "assistant", number(F.col("turn") - 1))
    return conversations.select(
        "conv_id", "turn", "role", "text", call_id.alias("call_id"), F.when(user, tool).alias("tool"), F.when(user, arguments).alias("arguments"),
        F.when(user, needs).alias("needs"),
    )
