"""Log views over the ``events`` test table, and request payloads made from it.

Everything here is a per-row function of ``events``, apart from packing entries
into request bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.timestamps import iso_timestamp, to_millis

ENTRIES_PER_REQUEST = 50
PAYLOAD_NOW = "2024-06-01T00:00:00Z"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of the log table."""
    kind, user = F.col("event_type"), F.col("user_id") % 5
    level = F.when(kind == "error", "error").when(kind == "signup", "warn").when(kind == "view", "debug").otherwise("info")
    service = (
        F.when(user == 0, "auth").when(user == 1, "checkout").when(user == 2, "orders")
        .when(user == 3, "notifications").otherwise("users")
    )
    text = (
        F.when(kind == "error", "Payment DECLINED").when(kind == "signup", "search 100% literal")
        .when(kind == "view", "request_completed").otherwise("order queued")
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        to_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        level.alias("level"),
        service.alias("service"),
        F.concat(text, F.lit(" pattern-"), F.col("event_id") % 100).alias("message"),
        F.try_parse_json("props").alias("attributes"),
        F.from_json("props", "map<string,string>").alias("attributes_search"),
    )


def hourly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log view with timestamps cut to the hour: many equal timestamps, so ids decide the order."""
    return log_view(spark, sf_dir).withColumn("timestamp", F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / 3600) * 3600))


def _quoted(text: Column) -> Column:
    """JSON string literal."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def damaged_entry(fault: Column) -> Column:
    """JSON text of a log entry, damaged in the way that ``fault`` (0-31) selects; 20 and up are valid."""
    members = {
        "timestamp": F.when(fault == 3, F.lit('"2023-04-31T00:00:00Z"'))
        .when(fault == 6, F.lit('"2024-06-01T00:05:00.001Z"'))
        .when(fault == 20, F.lit('"2024-06-01T00:05:00.000Z"'))
        .when(fault == 8, F.lit("1717200000000"))
        .when(fault == 9, F.lit(None))
        .when(fault == 21, F.concat(F.lit('"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('+00:00"')))
        .otherwise(_quoted(iso_timestamp(F.col("timestamp")))),
        "level": F.when(fault == 0, F.lit('"fatal"'))
        .when(fault == 10, F.lit("5"))
        .when(fault == 11, F.lit('"Warn"'))
        .otherwise(_quoted(F.col("level"))),
        "service": F.when(fault == 1, F.lit('" \\t\\u00a0\\ufeff"'))
        .when(fault == 12, F.lit("7.5"))
        .otherwise(_quoted(F.col("service"))),
        "message": F.when(fault == 2, F.lit(None))
        .when(fault == 13, F.lit('""'))
        .when(fault == 14, F.lit("false"))
        .otherwise(_quoted(F.col("message"))),
        "attributes": F.when(fault == 4, F.lit('{"place":{"row":1}}'))
        .when(fault == 5, F.lit("null"))
        .when(fault == 15, F.lit("[]"))
        .when(fault == 16, F.lit('{"ok":1,"tags":["x","y"]}'))
        .when(fault == 17, F.lit('{"note":null}'))
        .when(fault == 18, F.lit('"text"'))
        .when(fault == 22, F.lit(None))
        .when(fault == 23, F.lit("{}"))
        .otherwise(
            F.concat(
                F.lit('{"crate":"'), F.col("id") % 50, F.lit('","kilos":'), F.col("id") % 4,
                F.lit(',"sealed":'), F.when(F.col("id") % 7 != 0, "true").otherwise("false"), F.lit("}"),
            )
        ),
        "extra": F.lit("[1,{}]"),
    }
    fields = [F.concat(F.lit(f'"{name}":'), value) for name, value in members.items()]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return F.when(fault == 7, F.lit("[1]")).when(fault == 19, F.lit("null")).otherwise(whole)


def _spread(logs: DataFrame, per_request: int) -> DataFrame:
    """``logs`` with ``request_seq``, spread by it: small in bytes, but slow to write and to parse. A grouping reuses the shuffle."""
    partitions = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return logs.withColumn("request_seq", F.floor(F.col("id") / per_request)).repartition(partitions, "request_seq")


def payload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_seq, body)``: the log view as request bodies, with faulty entries and faulty bodies."""
    logs = _spread(log_view(spark, sf_dir), ENTRIES_PER_REQUEST)
    entry = F.struct("id", damaged_entry(F.col("id") % 32).alias("entry"))
    packed = logs.groupBy("request_seq").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    texts = F.array_join(F.transform("entries", lambda e: e["entry"]), ",")
    form = F.col("request_seq") % 19
    body = (
        F.when(form == 3, F.concat(F.lit('{"logs":['), texts))
        .when(form == 7, F.lit('{"logs":"x"}'))
        .when(form == 11, F.lit('{"logs":[]}'))
        .otherwise(F.concat(F.lit('{"logs":['), texts, F.lit("]}")))
    )
    return packed.select("request_seq", body.alias("body"))


def _packed(logs: DataFrame, entry: Column, per_request: int) -> DataFrame:
    """``(request_seq, body)`` of logs written as ``entry``, in the order of ids."""
    packed = _spread(logs, per_request).groupBy("request_seq").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("entry")))).alias("entries"))
    texts = F.array_join(F.transform("entries", lambda e: e["entry"]), ",")
    return packed.select("request_seq", F.concat(F.lit('{"logs":['), texts, F.lit("]}")).alias("body"))


def good_requests(spark: SparkSession, sf_dir: str, per_request: int) -> DataFrame:
    """``(request_seq, body)``: the log view in requests of ``per_request`` entries."""
    return _packed(log_view(spark, sf_dir), damaged_entry(F.lit(24)), per_request)


def requests_beyond_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_seq, body)``: the log view with values that the JSON parser refuses in some entries."""
    number, nested = F.repeat(F.lit("7"), 1_200), F.concat(F.repeat(F.lit("["), 1_100), F.repeat(F.lit("]"), 1_100))
    # Written at last, so that the grouping does not carry them.
    value = F.when(F.col("id") % 10 == 3, "<number>").when(F.col("id") % 10 == 7, "<nested>").otherwise("1")
    entry = F.replace(damaged_entry(F.lit(23)), F.lit('"attributes":{}'), F.concat(F.lit('"attributes":{"n":'), value, F.lit("}")))
    packed = _packed(log_view(spark, sf_dir), entry, ENTRIES_PER_REQUEST)
    return packed.withColumn("body", F.replace(F.replace("body", F.lit("<number>"), number), F.lit("<nested>"), nested))


def twice_faulty_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_seq, body)``: the log view with two bad attributes per entry, ``zeta`` first in even ids."""
    zeta, alpha = F.lit('"zeta":[1]'), F.lit('"alpha":null')
    pair = F.when(F.col("id") % 2 == 0, F.concat_ws(",", zeta, alpha)).otherwise(F.concat_ws(",", alpha, zeta))
    entry = F.replace(damaged_entry(F.lit(23)), F.lit('"attributes":{}'), F.concat(F.lit('"attributes":{'), pair, F.lit("}")))
    return _packed(log_view(spark, sf_dir), entry, ENTRIES_PER_REQUEST)
