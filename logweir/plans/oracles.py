"""DuckDB SQL for the expected results, over the same test tables."""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def iso(expression: str) -> str:
    return f"strftime({expression}, {ISO})"


def bucket(seconds: int, column: str = "ts") -> str:
    return iso(f"time_bucket(INTERVAL '{seconds} seconds', {column}, TIMESTAMP '1970-01-01')")


LOGS = """
logs AS (
  SELECT event_id AS id, date_trunc('millisecond', ts) AS ts,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
    CASE user_id % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'checkout' WHEN 2 THEN 'orders'
         WHEN 3 THEN 'notifications' ELSE 'users' END AS service,
    concat(CASE event_type WHEN 'error' THEN 'Payment DECLINED' WHEN 'signup' THEN 'search 100% literal'
                WHEN 'view' THEN 'request_completed' ELSE 'order queued' END,
           ' pattern-', CAST(event_id % 100 AS VARCHAR)) AS message,
    props
  FROM events
)"""

HOURLY = f"""{LOGS},
hourly AS (SELECT id, date_trunc('hour', ts) AS ts, level, service, message, props FROM logs)"""

ROLLUP = f"""{LOGS},
rollup AS (
  SELECT date_trunc('minute', ts) AS minute, service, level, COUNT(*) AS count FROM logs GROUP BY ALL
)"""

FIELDS = f"id, {iso('ts')} AS timestamp, level, service, message"


def select_logs(where: str) -> str:
    return f"WITH {LOGS} SELECT {FIELDS} FROM logs WHERE {where}"


def counts(seconds: int, where: str = "TRUE", group: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f'WITH {LOGS} SELECT {bucket(seconds)} AS start, {group} AS "group", COUNT(*) AS count '
        f"FROM logs WHERE {where} GROUP BY 1, 2"
    )


def rollup_counts(seconds: int, where: str = "TRUE", group: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f'WITH {ROLLUP} SELECT {bucket(seconds, "minute")} AS start, {group} AS "group", '
        f"CAST(SUM(count) AS BIGINT) AS count FROM rollup WHERE {where} GROUP BY 1, 2"
    )


# Expected outcome of the payload entries, from the fault number alone.
REASON = """
CASE id % 32
  WHEN 0 THEN 'invalid level: ''fatal'''
  WHEN 1 THEN 'service must be non-empty'
  WHEN 2 THEN 'message is required and must be a string'
  WHEN 3 THEN 'invalid timestamp'
  WHEN 4 THEN 'invalid attributes.place: must be string, number, or boolean'
  WHEN 5 THEN 'attributes must be a flat object'
  WHEN 6 THEN 'timestamp is more than 5 minutes in the future'
  WHEN 7 THEN 'log entry must be an object'
  WHEN 8 THEN 'timestamp is required and must be a string'
  WHEN 9 THEN 'timestamp is required and must be a string'
  WHEN 10 THEN 'level is required and must be a string'
  WHEN 11 THEN 'invalid level: ''Warn'''
  WHEN 12 THEN 'service is required and must be a string'
  WHEN 13 THEN 'message must be non-empty'
  WHEN 14 THEN 'message is required and must be a string'
  WHEN 15 THEN 'attributes must be a flat object'
  WHEN 16 THEN 'invalid attributes.tags: must be string, number, or boolean'
  WHEN 17 THEN 'invalid attributes.note: must be string, number, or boolean'
  WHEN 18 THEN 'attributes must be a flat object'
  WHEN 19 THEN 'log entry must be an object'
END"""

ENTRIES = f"""{LOGS},
entries AS (
  SELECT id, id // 50 AS request_seq,
    CAST(row_number() OVER (PARTITION BY id // 50 ORDER BY id) - 1 AS INTEGER) AS entry_index,
    CASE id % 32 WHEN 20 THEN TIMESTAMP '2024-06-01 00:05:00' ELSE ts END AS ts,
    level, service, message,
    CASE WHEN id % 32 IN (22, 23) THEN NULL ELSE 1 END AS has_attributes,
    {REASON} AS reason
  FROM logs WHERE (id // 50) % 19 NOT IN (3, 7, 11)
),
accepted AS (
  SELECT row_number() OVER (ORDER BY request_seq, entry_index) AS new_id, * FROM entries WHERE reason IS NULL
)"""


def synthetic(
    regions: int, prefix: str, message: str, millis: str = "- 60000 + i % 1000", now: str = "2026-08-08 00:00:00"
) -> str:
    def pick(values: list[str]) -> str:
        return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(i % {len(values)} + 1 AS INTEGER))"

    return f"""
WITH numbers AS (SELECT event_id AS i FROM events)
SELECT i AS "index", {iso(f"make_timestamp((epoch_ms(TIMESTAMP '{now}') {millis}) * 1000)")} AS timestamp,
  {pick(["debug", "info", "warn", "error"])} AS level,
  {pick(["auth", "checkout", "orders", "notifications", "users"])} AS service,
  {message} AS message,
  CAST(10000 + i % 50000 AS VARCHAR) AS user_id,
  {pick(["eu-west", "us-east", "ap-south"][:regions])} AS region,
  concat('{prefix}', i) AS request_id, CAST(i % 4 AS INTEGER) AS attempt, i % 7 <> 0 AS success
FROM numbers"""


LOAD_MESSAGES = """list_extract(['request completed', 'payment declined', 'password reset requested',
  'notification delivered', 'order queued', 'search 100% literal'], CAST(i % 6 + 1 AS INTEGER))"""
BENCH_MESSAGES = """list_extract(['request completed', 'payment declined', 'password reset requested',
  'notification delivered', 'order queued'], CAST(i % 5 + 1 AS INTEGER))"""
TWO_MESSAGES = "CASE WHEN i % 5 = 0 THEN 'payment declined' ELSE 'request completed' END"
