from datetime import UTC, datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.functions.text import contains_ignore_case, escape_like, is_blank
from logweir.functions.timestamps import bucket_start, iso_timestamp, strict_timestamp
from logweir.params import parse_instant
from logweir.sources.columns import rows_from_columns
from logweir.sources.synthetic import generate_logs

two = st.integers(0, 99).map("{:02d}".format)
texts = st.builds(
    "{}-{}-{}{}{}:{}:{}{}{}".format,
    st.sampled_from(["1969", "2000", "1900", "2023", "2024", "9998"]),
    st.sampled_from(["01", "02", "04", "12", "00", "13"]),
    st.sampled_from(["01", "28", "29", "30", "31", "32", "00"]),
    st.sampled_from(["T", "T", "T", " "]),
    st.sampled_from(["00", "12", "23", "24"]),
    st.sampled_from(["00", "59", "60"]),
    st.sampled_from(["00", "59", "60"]),
    st.sampled_from(["", ".1", ".12", ".123", ".1234", "."]),
    st.one_of(st.sampled_from(["Z", "z", "", "+00:00", "-23:59", "+23:59", "+24:00", "-00:60"]), st.builds("+{}:{}".format, two, two)),
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=300, max_size=300))
def test_strict_timestamp_matches_scalar_parser(spark, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    found = frame.select("i", F.unix_millis(strict_timestamp(F.col("t")))).collect()
    for i, millis in found:
        expected = parse_instant(values[i])
        assert millis == (None if expected is None else round(expected.timestamp() * 1000)), values[i]


def test_blank_characters(spark):
    points = [p for p in range(1, 0x10000) if not 0xD800 <= p <= 0xDFFF]
    frame = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    blank = {row.p for row in frame.where(is_blank(F.col("c"))).collect()}
    assert blank == {9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF}


def test_text(spark):
    frame = spark.createDataFrame([("100%_done\\ok",), ("CARD Declined",)], "t string")
    assert frame.select(escape_like(F.col("t"))).first()[0] == "100\\%\\_done\\\\ok"
    found = [frame.where(contains_ignore_case(F.col("t"), q)).count() for q in ("declined", "%", "_", "\\", "a%c", "' OR 1=1 --")]
    assert found == [1, 1, 1, 1, 0, 0]


def test_bucket_start_floors_before_epoch(spark):
    frame = spark.createDataFrame([(-1,), (0,), (299_999,), (300_000,)], "ms long").select(F.timestamp_millis("ms").alias("t"))
    found = [row[0] for row in frame.select(iso_timestamp(bucket_start(F.col("t"), 300))).collect()]
    assert found == [f"{d}.000Z" for d in ("1969-12-31T23:55:00", "1970-01-01T00:00:00", "1970-01-01T00:00:00", "1970-01-01T00:05:00")]


def test_rows_from_columns_pads_with_null(spark):
    frame = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "n array<int>, s array<string>")
    assert [tuple(row) for row in rows_from_columns(frame, ["n", "s"]).collect()] == [(1, "a"), (2, "b"), (3, None)]


def test_generator(spark):
    rows = generate_logs(spark, 6, "load", "2026-08-08T00:00:00Z").orderBy("index").collect()
    first, last = rows[0], rows[5]
    assert (first.level, first.service, first.message) == ("debug", "auth", "request completed pattern-0")
    assert last.attributes.asDict() == {"user_id": "10005", "region": "ap-south", "request_id": "req-5", "attempt": 1, "success": True}
    assert last.timestamp == datetime(2026, 8, 7, 23, 59, 0, 5000, UTC).astimezone().replace(tzinfo=None)
