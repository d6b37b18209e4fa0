"""Every operator as a query over the test tables, with the SQL for its expected result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.attributes import add_search_map, keep_scalars
from logweir.functions.text import contains_ignore_case, escape_like
from logweir.functions.timestamps import iso_timestamp, strict_timestamp
from logweir.operators import buckets, listing, ranking, reports, retention, rollup, validation
from logweir.operators.filters import apply_filters
from logweir.params import AggregateQuery, LogQuery, QueryCursor
from logweir.plans import logview, oracles
from logweir.plans.oracles import ENTRIES, FIELDS, HOURLY, LOGS, ROLLUP, iso
from logweir.session import configure, shared_dir
from logweir.sources import requests as raw
from logweir.sources.columns import rows_from_columns
from logweir.sources.synthetic import synthetic_logs
from logweir.store import LogStore
from logweir.streaming.ingest import start_ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SINCE, UNTIL = "2024-01-05T06:07:00Z", "2024-01-25T18:30:00Z"
IN_RANGE = "ts >= TIMESTAMP '2024-01-05 06:07:00' AND ts < TIMESTAMP '2024-01-25 18:30:00'"
MINUTE_RANGE = IN_RANGE.replace("ts", "minute")
WHOLE = {"since": "2024-01-01T00:00:00Z", "until": "2024-02-01T00:00:00Z"}
RETENTION = {"now": datetime(2024, 2, 5, tzinfo=UTC), "days": 15, "batch_size": 100, "max_batches": 5}


def register(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def shown(logs: DataFrame, *more: str) -> DataFrame:
    return logs.select(
        "id", iso_timestamp(F.col("timestamp")).alias("timestamp"), "level", "service", "message", *more
    )


def shown_buckets(found: DataFrame) -> DataFrame:
    return found.select(iso_timestamp(F.col("start")).alias("start"), "group", "count")


def shown_rollup(found: DataFrame) -> DataFrame:
    return found.select(iso_timestamp(F.col("minute")).alias("minute"), "service", "level", "count")


# -- sources ----------------------------------------------------------------


def parsed_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.parse_requests(logview.payload_requests(spark, sf_dir))


def validated_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate_entries(raw.explode_entries(parsed_payload(spark, sf_dir)), logview.PAYLOAD_NOW)


@register(
    "ingest_requests",
    f"""WITH {LOGS}
SELECT id // 50 AS request_seq,
  CASE id // 50 % 19 WHEN 3 THEN NULL WHEN 7 THEN NULL WHEN 11 THEN 0 ELSE CAST(COUNT(*) AS INTEGER) END AS n_entries,
  CASE WHEN id // 50 % 19 IN (3, 7) THEN 'request body must be an object with a logs array' END AS error
FROM logs GROUP BY id // 50""",
)
def ingest_requests(spark, sf_dir):
    return raw.request_states(parsed_payload(spark, sf_dir))


@register(
    "ingest_entries",
    f"""WITH {ENTRIES}
SELECT request_seq, entry_index,
  CASE id % 32 WHEN 7 THEN 'ARRAY' WHEN 19 THEN 'VOID' ELSE 'OBJECT' END AS kind,
  CASE WHEN id % 32 IN (2, 7, 14, 19) THEN CASE id % 32 WHEN 14 THEN 'false' END
       WHEN id % 32 = 13 THEN '' ELSE message END AS message
FROM entries""",
)
def ingest_entries(spark, sf_dir):
    entries = raw.explode_entries(parsed_payload(spark, sf_dir))
    return entries.select(
        "request_seq",
        "entry_index",
        F.regexp_extract(F.schema_of_variant("entry"), "^[A-Z]+", 0).alias("kind"),
        F.try_variant_get("entry", "$.message", "string").alias("message"),
    )


#: Of ten entries, the fourth holds a number of 1,200 digits, the eighth 1,100 levels of arrays.
BEYOND = f"""{LOGS}, sent AS (SELECT id, id // 50 AS request_seq, id % 10 AS form,
  CAST(row_number() OVER (PARTITION BY id // 50 ORDER BY id) - 1 AS INTEGER) AS entry_index FROM logs)"""


@register(
    "entries_beyond_limits",
    f"""WITH {BEYOND} SELECT request_seq, entry_index,
  CASE WHEN form IN (3, 7) THEN 'log entry exceeds the limits of the JSON parser' END AS reason,
  CASE form WHEN 3 THEN 1200 WHEN 7 THEN 2200 END AS n_raw
FROM sent""",
)
def entries_beyond_limits(spark, sf_dir):
    """Entries that the parser refuses among good ones; ``n_raw`` counts the digits or brackets of the value kept as raw text."""
    entries = raw.explode_entries(raw.parse_requests(logview.requests_beyond_limits(spark, sf_dir)))
    checked = validation.validate_entries(entries, logview.PAYLOAD_NOW)
    long_value = F.regexp_extract("raw", r'"n":([0-9]+|[\[\]]+)', 1)
    return checked.select("request_seq", "entry_index", "reason", F.length(F.when(F.col("raw").isNotNull(), long_value)).alias("n_raw"))


@register(
    "oversized_requests",
    f"""WITH {LOGS}, sizes AS (SELECT id // 6000 AS request_seq, COUNT(*) AS n FROM logs GROUP BY 1)
SELECT request_seq, CASE WHEN n > 5000 THEN 'refused' ELSE 'ok' END AS status,
  CASE WHEN n > 5000 THEN 0 ELSE n END AS accepted,
  CASE WHEN n > 5000 THEN 'logs batch exceeds maximum of 5000' END AS error FROM sizes""",
)
def oversized_requests(spark, sf_dir):
    """Requests of 6,000 entries, and the shorter one at the end."""
    parsed = raw.explode_requests(raw.parse_requests(logview.good_requests(spark, sf_dir, 6_000)))
    report = validation.entry_report(validation.validate_entries(parsed, logview.PAYLOAD_NOW))
    return report.select("request_seq", "status", F.col("accepted").cast("long").alias("accepted"), "error")


@register("unnest_columns", f"WITH {LOGS} SELECT {FIELDS} FROM logs")
def unnest_columns(spark, sf_dir):
    names = ["id", "timestamp", "level", "service", "message"]
    packed = (
        logview.log_view(spark, sf_dir)
        .groupBy(F.floor(F.col("id") / 50).alias("request_seq"))
        .agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))
        .select(*(F.col("rows")[name].alias(name) for name in names))
    )
    return shown(rows_from_columns(packed, names))


@register(
    "scan_logs",
    f"""WITH {LOGS} SELECT CAST(id AS VARCHAR) AS id, {iso("ts")} AS timestamp, level, service, message,
  concat('{{"k":', json_extract_string(props, '$.k'), '}}') AS attributes FROM logs""",
)
def scan_logs(spark, sf_dir):
    return shown(listing.scan_logs(logview.log_view(spark, sf_dir)), F.to_json("attributes").alias("attributes"))


SYNTHETIC_NOW = "2026-08-08T00:00:00Z"


def generated(profile: str) -> Query:
    def build(spark, sf_dir):
        indexes = logview.events(spark, sf_dir).select(F.col("event_id").alias("index"))
        logs = synthetic_logs(indexes, profile, SYNTHETIC_NOW)
        return logs.select(
            "index", iso_timestamp(F.col("timestamp")).alias("timestamp"), "level", "service", "message", "attributes.*"
        )

    return build


register("gen_load", oracles.synthetic(3, "req-", f"concat({oracles.LOAD_MESSAGES}, ' pattern-', i % 100)"))(generated("load"))
register(
    "gen_seed",
    oracles.synthetic(
        3, "seed-req-", f"concat({oracles.TWO_MESSAGES}, ' seed-', i % 100)", "- 60000 - (i % 2592000) * 1000"
    ),
)(generated("seed"))
register("gen_bench", oracles.synthetic(2, "req-", f"concat({oracles.BENCH_MESSAGES}, ' benchmark-', i % 100)"))(generated("bench"))
register("gen_mixed", oracles.synthetic(2, "mixed-", oracles.TWO_MESSAGES))(generated("mixed"))
register("gen_rate", oracles.synthetic(2, "rate-", oracles.TWO_MESSAGES))(generated("rate"))


# -- validation ---------------------------------------------------------------


@register(
    "validate_reasons",
    f"WITH {ENTRIES} SELECT request_seq, entry_index, reason FROM entries",
)
def validate_reasons(spark, sf_dir):
    return validated_payload(spark, sf_dir).select("request_seq", "entry_index", "reason")


@register(
    "ingest_rejects",
    f"WITH {ENTRIES} SELECT request_seq, entry_index, reason FROM entries WHERE reason IS NOT NULL",
)
def ingest_rejects(spark, sf_dir):
    rejects = validated_payload(spark, sf_dir).where(F.col("reason").isNotNull())
    settled = validation.settle_attribute_order(rejects, logview.payload_requests(spark, sf_dir))
    return settled.select("request_seq", "entry_index", "reason")


@register(
    "ingest_accepted",
    f"""WITH {ENTRIES} SELECT request_seq, entry_index, {iso("ts")} AS timestamp, level, service, message,
  CASE WHEN has_attributes = 1 THEN CAST(id % 50 AS VARCHAR) END AS crate,
  CASE WHEN has_attributes = 1 THEN CAST(id % 4 AS VARCHAR) END AS kilos,
  CASE WHEN has_attributes = 1 THEN CASE WHEN id % 7 <> 0 THEN 'true' ELSE 'false' END END AS sealed
FROM accepted""",
)
def ingest_accepted(spark, sf_dir):
    search = F.col("attributes_search")
    accepted = validation.accepted_rows(validated_payload(spark, sf_dir))
    return accepted.select(
        "request_seq",
        "entry_index",
        iso_timestamp(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        *(search[key].alias(key) for key in ("crate", "kilos", "sealed")),
    )


@register(
    "ingest_report",
    f"""WITH {ENTRIES},
per_request AS (
  SELECT request_seq, 'ok' AS kind, COUNT(*) FILTER (reason IS NULL) AS accepted,
    coalesce(string_agg(CASE WHEN reason IS NOT NULL THEN concat(entry_index, ' ', reason) END, '|' ORDER BY entry_index), '') AS rejected,
    CAST(NULL AS VARCHAR) AS error
  FROM entries GROUP BY request_seq
  UNION ALL
  SELECT DISTINCT id // 50, 'refused', 0, '', 'request body must be an object with a logs array' FROM logs WHERE id // 50 % 19 IN (3, 7)
  UNION ALL
  SELECT DISTINCT id // 50, 'ok', 0, '-1 logs must contain at least one entry', NULL FROM logs WHERE id // 50 % 19 = 11
)
SELECT request_seq, CASE WHEN kind = 'ok' AND accepted = 0 THEN 'all_rejected' ELSE kind END AS status,
  accepted, rejected, error FROM per_request""",
)
def ingest_report(spark, sf_dir):
    parsed = raw.explode_requests(parsed_payload(spark, sf_dir))
    validated = validation.validate_entries(parsed, logview.PAYLOAD_NOW)
    report = validation.entry_report(validated)
    lines = F.transform("rejected", lambda r: F.concat_ws(" ", r["index"], r["reason"]))
    return report.select("request_seq", "status", "accepted", F.array_join(lines, "|").alias("rejected"), "error")


@register(
    "validate_future",
    f"""WITH {LOGS} SELECT id, CASE WHEN epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-15 12:00:00') > 300000
  THEN 'timestamp is more than 5 minutes in the future' END AS reason FROM logs""",
)
def validate_future(spark, sf_dir):
    text = iso_timestamp(F.col("timestamp"))
    now = F.lit("2024-01-15T12:00:00Z").cast("timestamp")
    reason = validation.timestamp_reason(text, strict_timestamp(text), now)
    return logview.log_view(spark, sf_dir).select("id", reason.alias("reason"))


def timestamp_texts(timestamp, form):
    """The timestamp written in one of 20 forms, good and bad."""
    def written(pattern: str):
        return F.date_format(timestamp, pattern)

    seconds, millis = written("yyyy-MM-dd'T'HH:mm:ss"), iso_timestamp(timestamp)
    day = written("yyyy-MM-dd")
    forms = [
        millis,
        F.concat(seconds, F.lit("Z")),
        F.concat(F.substring(millis, 1, 21), F.lit("Z")),
        F.concat(seconds, F.lit("+02:00")),
        F.concat(F.substring(millis, 1, 23), F.lit("-23:59")),
        F.concat(seconds, F.lit("+23:59")),
        F.concat(seconds, F.lit("+24:00")),
        F.replace(millis, F.lit("T"), F.lit(" ")),
        F.concat(seconds, F.lit("z")),
        F.concat(F.substring(millis, 1, 23), F.lit("0Z")),
        F.concat(written("yyyy-MM-dd'T'HH:mm:"), F.lit("60Z")),
        F.concat(day, F.lit("T24:00:00Z")),
        F.concat(written("yyyy"), F.lit("-02-30T"), written("HH:mm:ss"), F.lit("Z")),
        F.concat(millis, F.lit("\n")),
        F.concat(written("yyyy"), F.lit("-13-01T"), written("HH:mm:ss"), F.lit("Z")),
        F.concat(F.substring(millis, 1, 22), F.lit("Z")),
        F.concat(F.lit("2024-02-29T"), written("HH:mm:ss"), F.lit("Z")),
        F.concat(F.lit("2023-02-29T"), written("HH:mm:ss"), F.lit("Z")),
        F.concat(seconds, F.lit("+05:60")),
        seconds,
    ]
    return F.element_at(F.array(*forms), (form + 1).cast("int"))


@register(
    "parse_timestamp",
    f"""WITH {LOGS} SELECT id, {iso('''CASE id % 20
  WHEN 0 THEN ts
  WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN make_timestamp(epoch_ms(ts) // 100 * 100000)
  WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
  WHEN 4 THEN ts + INTERVAL 1439 MINUTE
  WHEN 5 THEN date_trunc('second', ts) - INTERVAL 1439 MINUTE
  WHEN 15 THEN make_timestamp(epoch_ms(ts) // 10 * 10000)
  WHEN 16 THEN TIMESTAMP '2024-02-29' + (date_trunc('second', ts) - date_trunc('day', ts))
END''')} AS parsed FROM logs""",
)
def parse_timestamp(spark, sf_dir):
    texts = logview.log_view(spark, sf_dir).select(
        "id", timestamp_texts(F.col("timestamp"), F.col("id") % 20).alias("text")
    )
    return texts.select("id", iso_timestamp(strict_timestamp(F.col("text"))).alias("parsed"))


def entries_with_attributes(spark, sf_dir, attributes) -> DataFrame:
    """One valid entry per event with the given JSON text as attributes, as VARIANT."""
    fields = '"timestamp":"2024-01-01T00:00:00Z","level":"info","service":"s","message":"m"'
    body = F.concat(F.lit(f'{{{fields},"attributes":'), attributes, F.lit("}"))
    return logview.events(spark, sf_dir).select(
        F.col("event_id").alias("request_seq"), F.lit(0).alias("entry_index"), F.try_parse_json(body).alias("entry")
    )


@register(
    "validate_attributes",
    """SELECT event_id AS id, CASE event_id % 12
  WHEN 0 THEN 'invalid attributes.place: must be string, number, or boolean'
  WHEN 1 THEN 'invalid attributes.tags: must be string, number, or boolean'
  WHEN 2 THEN 'invalid attributes.note: must be string, number, or boolean'
  WHEN 3 THEN 'attributes must be a flat object'
  WHEN 4 THEN 'attributes must be a flat object'
  WHEN 5 THEN 'attributes must be a flat object'
  WHEN 6 THEN 'invalid attributes.i: number must be finite'
  WHEN 7 THEN concat('invalid attributes.key', event_id, ': must be string, number, or boolean')
END AS reason FROM events""",
)
def validate_attributes(spark, sf_dir):
    number = F.col("event_id")
    bad = [
        '{"place":{"row":1}}', '{"ok":"x","tags":["y"]}', '{"note":null}', "[]", "null", '"text"',
        '{"i":1e400}',
    ]
    forms = [*map(F.lit, bad), F.concat(F.lit('{"key'), number, F.lit('":{}}'))]
    attributes = F.coalesce(
        F.get(F.array(*forms), (number % 12).cast("int")), F.concat(F.lit('{"k":'), number, F.lit(',"b":true,"s":"x"}'))
    )
    validated = validation.validate_entries(entries_with_attributes(spark, sf_dir, attributes), SYNTHETIC_NOW)
    return validated.select(F.col("request_seq").alias("id"), "reason")


@register(
    "normalize_attributes",
    """SELECT event_id AS id, CAST(event_id AS VARCHAR) AS number,
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, event_type AS text,
  regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS fraction,
  concat(event_id + 1, '000') AS scientific, CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def normalize_attributes(spark, sf_dir):
    flag = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    attributes = F.concat(
        F.lit('{"number":'), F.col("event_id"), F.lit(',"flag":'), flag, F.lit(',"text":"'), F.col("event_type"),
        F.lit('","fraction":'), F.col("value"), F.lit(',"scientific":'), F.col("event_id") + 1, F.lit("e3}"),
    )
    validated = validation.validate_entries(entries_with_attributes(spark, sf_dir, attributes), SYNTHETIC_NOW)
    search = F.col("attributes_search")
    return add_search_map(validated).select(
        F.col("request_seq").alias("id"),
        *(search[key].alias(key) for key in ("number", "flag", "text", "fraction", "scientific", "missing")),
    )


@register(
    "attributes_scalar_only",
    """SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '{}'
  ELSE concat('{"a":', event_id, ',"t":"', event_type, '"}') END AS attributes FROM events""",
)
def attributes_scalar_only(spark, sf_dir):
    stored = F.when(F.col("event_id") % 10 == 0, F.lit("[1]")).otherwise(
        F.concat(
            F.lit('{"t":"'), F.col("event_type"), F.lit('","nested":{"x":1},"list":[1],"none":null,"a":'),
            F.col("event_id"), F.lit("}"),
        )
    )
    return logview.events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.to_json(keep_scalars(F.try_parse_json(stored))).alias("attributes")
    )


@register("iso_timestamp", f"WITH {LOGS} SELECT id, {iso('ts')} AS iso FROM logs")
def iso_text(spark, sf_dir):
    return logview.log_view(spark, sf_dir).select("id", iso_timestamp(F.col("timestamp")).alias("iso"))


@register(
    "escape_like",
    """SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM documents""",
)
def escape_like_text(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", escape_like(F.col("text")).alias("escaped"))


# -- filters --------------------------------------------------------------------


def filtered(name: str, where: str, **params) -> None:
    def build(spark, sf_dir):
        return shown(apply_filters(logview.log_view(spark, sf_dir), LogQuery(**params)))

    register(name, oracles.select_logs(where))(build)


filtered("filter_service", "service = 'checkout'", service="checkout")
filtered("filter_level", "level = 'error'", level="error")
filtered("filter_time", IN_RANGE, since=SINCE, until=UNTIL)
filtered("filter_attr", "json_extract_string(props, '$.k') = '7'", attributes={"k": "7"})
filtered("search_message", "contains(lower(message), 'declined')", q="dEcLiNeD")
filtered("search_percent", "contains(message, '100%')", q="100%")
filtered("search_underscore", "contains(message, '_')", q="_")
filtered(
    "filter_combined",
    f"service = 'checkout' AND level = 'error' AND {IN_RANGE} AND json_extract_string(props, '$.k') = '7' "
    "AND contains(lower(message), 'declined')",
    service="checkout", level="error", since=SINCE, until=UNTIL, attributes={"k": "7"}, q="declined",
)


@register("search_documents", "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), lower('License'))")
def search_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.where(contains_ignore_case(F.col("text"), "License")).select("doc_id", "lang", "n_chars")


# -- aggregations -----------------------------------------------------------------


def counted(name: str, sql: str, source: str = "base", **params) -> None:
    query = AggregateQuery(**params)

    def build(spark, sf_dir):
        logs = logview.log_view(spark, sf_dir)
        return shown_buckets(buckets.bucket_counts(logs, rollup.minute_counts(logs), query, source))

    register(name, sql)(build)


for width, seconds in {"1m": 60, "5m": 300, "1h": 3_600, "1d": 86_400}.items():
    counted(f"bucket_count_{width}", oracles.counts(seconds), bucket=width, **WHOLE)
    counted(f"rollup_bucket_{width}", oracles.rollup_counts(seconds), "rollup", bucket=width, **WHOLE)
RANGE = {"since": SINCE, "until": UNTIL}
counted("bucket_by_service", oracles.counts(300, IN_RANGE, "service"), bucket="5m", group_by="service", **RANGE)
counted("bucket_by_level", oracles.counts(300, IN_RANGE, "level"), bucket="5m", group_by="level", **RANGE)
counted("rollup_bucket_by_service", oracles.rollup_counts(3_600, MINUTE_RANGE, "service"), "rollup", bucket="1h", group_by="service", **RANGE)
counted("rollup_bucket_by_level", oracles.rollup_counts(3_600, MINUTE_RANGE, "level"), "rollup", bucket="1h", group_by="level", **RANGE)
counted("bucket_auto", oracles.rollup_counts(300, MINUTE_RANGE + " AND level = 'error'", "service"), "auto", bucket="5m", group_by="service", level="error", **RANGE)
counted("bucket_auto_q", oracles.counts(300, IN_RANGE + " AND contains(lower(message), 'declined')"), "auto", bucket="5m", q="declined", **RANGE)
counted("bucket_attr", oracles.counts(3_600, "json_extract_string(props, '$.k') = '7'"), bucket="1h", attributes={"k": "7"}, **WHOLE)
counted("bucket_q", oracles.counts(3_600, "contains(lower(message), 'declined')", "service"), bucket="1h", group_by="service", q="declined", **WHOLE)
counted("bucket_service_level", oracles.counts(3_600, "service = 'checkout' AND level = 'error'"), bucket="1h", service="checkout", level="error", **WHOLE)
# Edges inside a minute: the rollup sees minute starts only, the exact form every row.
EDGES = {"since": "2024-01-01T00:00:05Z", "until": "2024-01-20T10:20:30.500Z"}
counted(
    "rollup_bucket_edges",
    oracles.rollup_counts(60, "minute >= TIMESTAMP '2024-01-01 00:00:05' AND minute < TIMESTAMP '2024-01-20 10:20:30.5'"),
    "rollup", bucket="1m", **EDGES,
)
counted(
    "bucket_exact",
    oracles.counts(60, "ts >= TIMESTAMP '2024-01-01 00:00:05' AND ts < TIMESTAMP '2024-01-20 10:20:30.5'", "level"),
    "exact", bucket="1m", group_by="level", **EDGES,
)


@register("minute_counts", f"WITH {ROLLUP} SELECT {iso('minute')} AS minute, service, level, count FROM rollup")
def minute_counts(spark, sf_dir):
    return shown_rollup(rollup.minute_counts(logview.log_view(spark, sf_dir)))


@register("count_by_service", f"WITH {LOGS} SELECT service, COUNT(*) AS count FROM logs GROUP BY service")
def count_by_service(spark, sf_dir):
    return reports.count_by_service(logview.log_view(spark, sf_dir))


@register(
    "latency_summary",
    """SELECT event_type, COUNT(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90,
  quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""",
)
def latency_summary(spark, sf_dir):
    return reports.latency_summary(logview.events(spark, sf_dir), "value", "event_type")


@register(
    "throughput_summary",
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_ms(date_trunc('millisecond', ts)) AS sent FROM events),
t AS (SELECT event_type AS kind, COUNT(*) AS requests, COUNT(*) FILTER (user_id % 10 = 0) AS failed_requests,
  CAST(SUM(100 + user_id) AS BIGINT) AS attempted, CAST(SUM(100 + user_id - event_id % 5) AS BIGINT) AS accepted,
  CAST(SUM(event_id % 5) AS BIGINT) AS rejected,
  CAST(MAX(sent + event_id % 1000) - MIN(sent) AS DOUBLE) / 1000 AS elapsed_s FROM e GROUP BY event_type)
SELECT *, round(attempted / elapsed_s, 2) AS attempted_per_s, round(accepted / elapsed_s, 2) AS accepted_per_s FROM t""",
)
def throughput_summary(spark, sf_dir):
    sent = F.unix_millis(F.col("ts").cast("timestamp"))
    log = logview.events(spark, sf_dir).select(
        F.col("event_type").alias("kind"),
        F.timestamp_millis(sent).alias("sent_at"),
        F.timestamp_millis(sent + F.col("event_id") % 1000).alias("done_at"),
        (F.col("user_id") + 100).alias("attempted"),
        (F.col("user_id") + 100 - F.col("event_id") % 5).alias("accepted"),
        (F.col("event_id") % 5).alias("rejected"),
        (F.col("user_id") % 10 == 0).alias("failed"),
    )
    return reports.throughput_summary(log, "kind")


# -- rollup -------------------------------------------------------------------


def deltas(spark, sf_dir) -> DataFrame:
    """Rollup deltas of three batches."""
    logs = logview.log_view(spark, sf_dir).withColumn("batch", F.col("id") % 3)
    parts = [rollup.minute_counts(logs.where(F.col("batch") == batch)) for batch in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("rollup_scan", f"WITH {ROLLUP} SELECT {iso('minute')} AS minute, service, level, count FROM rollup")
def rollup_scan(spark, sf_dir):
    return shown_rollup(rollup.rollup_scan(deltas(spark, sf_dir)))


BOTH_ROLLUPS = f"""{HOURLY},
fine AS (SELECT date_trunc('minute', ts) AS minute, service, level, COUNT(*) AS count FROM logs GROUP BY ALL),
coarse AS (SELECT ts AS minute, service, level, COUNT(*) AS count FROM hourly GROUP BY ALL)"""


@register(
    "rollup_merge",
    f"""WITH {BOTH_ROLLUPS} SELECT {iso("minute")} AS minute, service, level, CAST(SUM(count) AS BIGINT) AS count
FROM (SELECT * FROM fine UNION ALL SELECT * FROM coarse) GROUP BY 1, 2, 3""",
)
def rollup_merge(spark, sf_dir):
    fine = rollup.minute_counts(logview.log_view(spark, sf_dir))
    return shown_rollup(rollup.merge_rollup(fine, rollup.minute_counts(logview.hourly_view(spark, sf_dir))))


@register(
    "rollup_backfill",
    f"""WITH {BOTH_ROLLUPS} SELECT {iso("minute")} AS minute, service, level, count FROM fine
UNION ALL SELECT {iso("minute")}, service, level, count FROM coarse
WHERE (minute, service, level) NOT IN (SELECT (minute, service, level) FROM fine)""",
)
def rollup_backfill(spark, sf_dir):
    drifted = rollup.minute_counts(logview.hourly_view(spark, sf_dir))
    return shown_rollup(rollup.rebuild_rollup(drifted, logview.log_view(spark, sf_dir)))


@register(
    "rollup_purge",
    f"""WITH {ROLLUP} SELECT {iso("minute")} AS minute, service, level, count FROM rollup
WHERE minute >= TIMESTAMP '2024-01-10 12:00:30'""",
)
def rollup_purge(spark, sf_dir):
    logs = logview.log_view(spark, sf_dir)
    return shown_rollup(rollup.rollup_purge(rollup.minute_counts(logs), datetime(2024, 1, 10, 12, 0, 30, tzinfo=UTC)))


@register(
    "rollup_subtract",
    f"""WITH {ROLLUP} SELECT {iso("minute")} AS minute, service, level, count FROM (
  SELECT date_trunc('minute', ts) AS minute, service, level, COUNT(*) AS count FROM logs
  WHERE ts >= TIMESTAMP '2024-01-10 12:00:30' GROUP BY ALL)""",
)
def rollup_subtract(spark, sf_dir):
    logs = logview.log_view(spark, sf_dir)
    deleted = apply_filters(logs, LogQuery(until="2024-01-10T12:00:30Z"))
    return shown_rollup(rollup.rollup_subtract(rollup.minute_counts(logs), deleted))


# -- order, paging, ids -----------------------------------------------------------


def newest_sql(where: str, limit: int, source: str = "logs") -> str:
    return f"WITH {HOURLY} SELECT {FIELDS} FROM {source} WHERE {where} ORDER BY ts DESC, id DESC LIMIT {limit}"


@register("list_recent", newest_sql("TRUE", 101))
def list_recent(spark, sf_dir):
    return shown(listing.list_logs(logview.log_view(spark, sf_dir), LogQuery()))


def page_sql(where: str, limit: int) -> str:
    return f"""WITH {HOURLY},
fetched AS (SELECT * FROM hourly WHERE {where} ORDER BY ts DESC, id DESC LIMIT {limit + 1}),
placed AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS position FROM fetched),
next AS (SELECT ts, id FROM placed WHERE position = {limit} AND (SELECT COUNT(*) FROM placed) > {limit})
SELECT {FIELDS}, CAST(position AS INTEGER) AS position, {iso("(SELECT ts FROM next)")} AS next_timestamp, (SELECT id FROM next) AS next_id
FROM placed WHERE position <= {limit}"""


CURSOR = QueryCursor(datetime(2024, 1, 20, 10, tzinfo=UTC), 500)
AFTER_CURSOR = "(ts, id) < (TIMESTAMP '2024-01-20 10:00:00', 500)"


def page(query: LogQuery) -> Query:
    def build(spark, sf_dir):
        found = listing.list_page(logview.hourly_view(spark, sf_dir), query)
        return shown(found, "position", iso_timestamp(F.col("next_timestamp")).alias("next_timestamp"), "next_id")

    return build


register("list_page1", page_sql("service = 'checkout'", 50))(page(LogQuery(service="checkout", limit=50)))
register("list_page2", page_sql(f"service = 'checkout' AND {AFTER_CURSOR}", 50))(
    page(LogQuery(service="checkout", limit=50, cursor=CURSOR))
)


@register("page_after", newest_sql(AFTER_CURSOR, 100, "hourly"))
def page_after(spark, sf_dir):
    return shown(listing.page_after(logview.hourly_view(spark, sf_dir), CURSOR, 100))


@register(
    "paged_export",
    f"""WITH {HOURLY}, ranked AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) - 1 AS place FROM hourly)
SELECT {FIELDS}, place // 1000 AS page, place % 1000 + 1 AS position FROM ranked""",
)
def paged_export(spark, sf_dir):
    return shown(listing.paged_export(logview.hourly_view(spark, sf_dir), 1_000), "page", "position")


@register("assign_ids", f"WITH {ENTRIES} SELECT new_id AS id, request_seq, entry_index FROM accepted")
def assign_ids(spark, sf_dir):
    accepted = validation.accepted_rows(validated_payload(spark, sf_dir)).select("request_seq", "entry_index")
    return ranking.assign_ids(accepted).select("id", "request_seq", "entry_index")


# -- retention ------------------------------------------------------------------------

OLDEST = f"""{HOURLY},
expired AS (SELECT id FROM hourly WHERE ts < TIMESTAMP '2024-01-21' ORDER BY ts, id LIMIT 500)"""


def planned(spark, sf_dir) -> tuple[DataFrame, retention.RetentionPlan]:
    logs = logview.hourly_view(spark, sf_dir)
    return logs, retention.retention_plan(logs, **RETENTION)


@register("retention_candidates", f"WITH {OLDEST} SELECT {FIELDS} FROM hourly WHERE id IN (SELECT id FROM expired)")
def retention_candidates(spark, sf_dir):
    return shown(retention.retention_candidates(*planned(spark, sf_dir)))


KEPT = f"WITH {OLDEST} SELECT {FIELDS} FROM hourly WHERE id NOT IN (SELECT id FROM expired)"


@register("retention_keep", KEPT)
def retention_keep(spark, sf_dir):
    return shown(retention.retention_keep(*planned(spark, sf_dir)))


@register("delete_by_id", KEPT)
def delete_by_id(spark, sf_dir):
    logs, plan = planned(spark, sf_dir)
    return shown(retention.delete_by_id(logs, retention.retention_candidates(logs, plan)))


@register(
    "retention_report",
    f"""WITH {HOURLY}, found AS (SELECT least(COUNT(*), 500) AS deleted FROM hourly WHERE ts < TIMESTAMP '2024-01-21')
SELECT '2024-01-21T00:00:00.000Z' AS cutoff, deleted, CAST(ceil(deleted / 100) AS BIGINT) AS batches, deleted = 500 AS has_more
FROM found""",
)
def retention_report(spark, sf_dir):
    return retention.retention_report(logview.hourly_view(spark, sf_dir), **RETENTION)


# -- tables --------------------------------------------------------------------------


def new_folder(spark: SparkSession) -> str:
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return f"{shared}/logweir-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str) -> LogStore:
    """The payload ingested as two batches, one of them sent twice."""
    store = LogStore(spark, new_folder(spark))
    requests = logview.payload_requests(spark, sf_dir)
    even = F.col("request_seq") % 2 == 0
    store.ingest(requests.where(even), "even", logview.PAYLOAD_NOW)
    store.ingest(requests.where(~even), "odd", logview.PAYLOAD_NOW)
    store.ingest(requests.where(even), "even", logview.PAYLOAD_NOW)
    return store


STORED = f"""{ENTRIES},
stored AS (SELECT row_number() OVER (ORDER BY request_seq % 2, request_seq, entry_index) AS number, * FROM accepted)"""


@register(
    "store_logs",
    f"WITH {STORED} SELECT number AS id, {iso('ts')} AS timestamp, level, service, message FROM stored",
)
def store_logs(spark, sf_dir):
    return shown(stored(spark, sf_dir).logs())


@register(
    "store_rollup",
    f"""WITH {STORED} SELECT {iso("date_trunc('minute', ts)")} AS minute, service, level, COUNT(*) AS count
FROM stored GROUP BY ALL""",
)
def store_rollup(spark, sf_dir):
    return shown_rollup(stored(spark, sf_dir).rollup())


@register(
    "store_zones",
    f"""WITH {STORED} SELECT {oracles.bucket(3_600)} AS start, level AS "group", COUNT(*) AS count
FROM stored WHERE ts >= TIMESTAMP '2024-01-04 22:00:00' AND ts < TIMESTAMP '2024-01-26 01:00:00' GROUP BY ALL""",
)
def store_zones(spark, sf_dir):
    """Instants of other zones against the days of a stored table."""
    east, west = timezone(timedelta(hours=5)), timezone(timedelta(hours=-5))
    query = AggregateQuery(since=datetime(2024, 1, 5, 3, tzinfo=east), until=datetime(2024, 1, 25, 20, tzinfo=west), bucket="1h", group_by="level")
    return shown_buckets(stored(spark, sf_dir).bucket_counts(query, "base"))


@register(
    "store_page_zone",
    f"""WITH {STORED} SELECT number AS id, {iso('ts')} AS timestamp, level, service, message FROM stored
WHERE ts < TIMESTAMP '2024-01-21 04:30:00' ORDER BY ts DESC, number DESC LIMIT 200""",
)
def store_page_zone(spark, sf_dir):
    """The page behind a cursor of another zone."""
    cursor = QueryCursor(datetime(2024, 1, 20, 23, 30, tzinfo=timezone(timedelta(hours=-5))), 0)
    return shown(listing.page_after(stored(spark, sf_dir).logs(), cursor, 200))


REMAINING = f"""{STORED},
gone AS (SELECT number FROM stored WHERE ts < TIMESTAMP '2024-01-21' ORDER BY ts, number LIMIT 300),
remaining AS (SELECT * FROM stored WHERE number NOT IN (SELECT number FROM gone))"""


def expired(spark: SparkSession, sf_dir: str) -> LogStore:
    """The stored payload after a cycle that reached its cap."""
    store = stored(spark, sf_dir)
    store.apply_retention(datetime(2024, 2, 5, tzinfo=UTC), days=15, batch_size=100, max_batches=3)
    return store


@register("store_retention", f"WITH {REMAINING} SELECT number AS id, {iso('ts')} AS timestamp, level, service, message FROM remaining")
def store_retention(spark, sf_dir):
    return shown(expired(spark, sf_dir).logs())


@register(
    "store_exact_after_retention",
    f"""WITH {REMAINING} SELECT {oracles.bucket(60)} AS start, service AS "group", COUNT(*) AS count
FROM remaining WHERE ts >= TIMESTAMP '2024-01-01 00:00:10' AND ts < TIMESTAMP '2024-02-01' GROUP BY ALL""",
)
def store_exact_after_retention(spark, sf_dir):
    query = AggregateQuery(since="2024-01-01T00:00:10Z", until="2024-02-01T00:00:00Z", bucket="1m", group_by="service")
    return shown_buckets(expired(spark, sf_dir).bucket_counts(query, "exact"))


def exactly_expired(spark: SparkSession, sf_dir: str) -> LogStore:
    """The stored payload after a capped cycle that keeps the rollup exact."""
    store = stored(spark, sf_dir)
    store.apply_retention(datetime(2024, 2, 5, tzinfo=UTC), days=15, batch_size=100, max_batches=3, exact=True)
    return store


REMAINING_MINUTES = f"""WITH {REMAINING} SELECT {iso("date_trunc('minute', ts)")} AS minute, service, level, COUNT(*) AS count
FROM remaining GROUP BY ALL"""


@register("store_exact_retention", REMAINING_MINUTES)
def store_exact_retention(spark, sf_dir):
    return shown_rollup(exactly_expired(spark, sf_dir).rollup())


@register("store_exact_retention_compacted", REMAINING_MINUTES)
def store_exact_retention_compacted(spark, sf_dir):
    store = exactly_expired(spark, sf_dir)
    store.compact("some", ["even"])
    return shown_rollup(store.rollup())


@register(
    "store_exact_retention_buckets",
    f"""WITH {REMAINING}, hours AS (SELECT {oracles.bucket(3_600)} AS start, level AS "group", COUNT(*) AS count
FROM remaining WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY ALL)
SELECT * FROM hours CROSS JOIN (SELECT unnest(['base', 'exact', 'rollup']) AS source)""",
)
def store_exact_retention_buckets(spark, sf_dir):
    """Counts of the three sources, which agree after an exact cycle."""
    store = exactly_expired(spark, sf_dir)
    query = AggregateQuery(bucket="1h", group_by="level", **WHOLE)
    found = [shown_buckets(store.bucket_counts(query, source)).withColumn("source", F.lit(source)) for source in ("base", "exact", "rollup")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register(
    "store_fetch_page",
    f"""WITH {REMAINING} SELECT number AS id, {iso('ts')} AS timestamp, level, service, message FROM remaining
WHERE ts >= TIMESTAMP '2024-01-05 06:07:00' AND level = 'error' AND message ILIKE '%declined%' ORDER BY ts DESC, number DESC LIMIT 1000""",
)
def store_fetch_page(spark, sf_dir):
    """Five pages of 200 rows, each behind the cursor of the one before, by filters and a start."""
    store, query, found = expired(spark, sf_dir), LogQuery(since=SINCE, level="error", q="declined", limit=200), []
    for _ in range(5):
        rows, cursor = store.fetch_page(query)
        found += [(row.id, row.timestamp_millis, row.level, row.service, row.message) for row in rows]
        if cursor is None:
            break
        query = replace(query, cursor=cursor)
    pages = spark.createDataFrame(found, "id long, millis long, level string, service string, message string")
    return shown(pages.withColumn("timestamp", F.timestamp_millis("millis")))


@register("store_compacted", f"WITH {REMAINING} SELECT number AS id, {iso('ts')} AS timestamp, level, service, message FROM remaining")
def store_compacted(spark, sf_dir):
    store = expired(spark, sf_dir)
    store.compact("all")
    return shown(store.logs())


@register("stream_drained", f"WITH {ENTRIES} SELECT {iso('ts')} AS timestamp, level, service, message FROM accepted")
def stream_drained(spark, sf_dir):
    """The payload as files, taken in by a stream until there is nothing left."""
    folder = new_folder(spark)
    logview.payload_requests(spark, sf_dir).select("body").write.text(f"{folder}/in")
    store = LogStore(spark, f"{folder}/store")
    stream = start_ingest_stream(store, f"{folder}/in", f"{folder}/checkpoint", "payload", max_bytes=str(1 << 30), now=logview.PAYLOAD_NOW)
    stream.awaitTermination()
    return shown(store.logs()).drop("id")


@register(
    "reject_order",
    f"""WITH {LOGS} SELECT id // 50 AS request_seq, CAST(row_number() OVER (PARTITION BY id // 50 ORDER BY id) - 1 AS INTEGER) AS entry_index,
  'invalid attributes.' || CASE id % 2 WHEN 0 THEN 'zeta' ELSE 'alpha' END || ': must be string, number, or boolean' AS reason FROM logs""",
)
def reject_order(spark, sf_dir):
    """Two bad attributes in every entry, sent in and against the order of their names."""
    requests = logview.twice_faulty_requests(spark, sf_dir)
    checked = validation.validate_entries(raw.explode_entries(raw.parse_requests(requests)), logview.PAYLOAD_NOW)
    rejects = checked.where("reason is not null").select("request_seq", "entry_index", "reason", "raw", "order_unsure")
    return validation.settle_attribute_order(rejects, requests).select("request_seq", "entry_index", "reason")
