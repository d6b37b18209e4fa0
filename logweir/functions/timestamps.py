"""Timestamp columns: strict parsing, ISO text, bucket starts."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted text form. \z, because $ would also allow a final newline.
TIMESTAMP_PATTERN = (
    r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?(Z|[+-]\d{2}:\d{2})\z"
)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def strict_timestamp(text: Column) -> Column:
    """UTC instant at millisecond precision, or NULL when ``text`` is not a valid one.

    The pattern fixes every position up to the fraction, so one regex match and
    plain substrings are enough. Offsets go to +-23:59, which Spark's own cast
    refuses, so they are subtracted as microseconds.
    """
    zone_length = F.when(text.endswith("Z"), 1).otherwise(6)
    fraction = F.substring(text, F.lit(21), F.length(text) - 20 - zone_length)
    hour = _int(F.substring(text, 12, 2))
    minute = _int(F.substring(text, 15, 2))
    second = _int(F.substring(text, 18, 2))
    local = F.try_make_timestamp(
        _int(F.substring(text, 1, 4)),
        _int(F.substring(text, 6, 2)),
        _int(F.substring(text, 9, 2)),
        hour,
        minute,
        F.concat(F.substring(text, 18, 2), F.lit("."), F.rpad(fraction, 3, "0")).try_cast("decimal(16,6)"),
        F.lit("UTC"),
    )
    offset_hour = _int(F.substring(text, -5, 2))
    offset_minute = _int(F.substring(text, -2, 2))
    sign = F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1)
    offset = F.when(text.endswith("Z"), F.lit(0)).when(
        (offset_hour <= 23) & (offset_minute <= 59), sign * (offset_hour * 60 + offset_minute)
    )
    in_range = (hour <= 23) & (minute <= 59) & (second <= 59)
    return F.when(
        text.rlike(TIMESTAMP_PATTERN) & in_range,
        F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60_000_000),
    )


def to_millis(ts: Column) -> Column:
    """Drop everything below the millisecond."""
    return F.timestamp_millis(F.unix_millis(ts))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bucket_key(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket as microseconds: a plain LONG to group on."""
    micros = F.unix_micros(ts)
    return micros - F.pmod(micros, F.lit(seconds * 1_000_000))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket; independent of the session time zone."""
    return F.timestamp_micros(bucket_key(ts, seconds))


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: The calendar repeats every 400 years, which brings year 0 into Python's range.
_CYCLE = timedelta(days=146_097)


def as_millis(value: datetime) -> int:
    return (value - _EPOCH) // timedelta(milliseconds=1)


#: Start of year 1, the first instant of a datetime.
FIRST_MILLIS = as_millis(datetime(1, 1, 1, tzinfo=UTC))


def from_millis(millis: int) -> datetime:
    """For instants from year 1 on; data values are kept as milliseconds."""
    return _EPOCH + timedelta(milliseconds=millis)


def utc(value: datetime) -> datetime:
    """The same instant in UTC; without a zone it is UTC already."""
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


def millis_of(year: int, month: int, day: int, *time: int) -> int:
    """Milliseconds of a UTC date and time from year 0 on; ``ValueError`` if there is none."""
    # The same date and time 400 years on or back, so that any year is in Python's range.
    shift = 400 if year < 5_000 else -400
    shifted = as_millis(datetime(year + shift, month, day, *time, tzinfo=UTC))
    return shifted - shift // 400 * (_CYCLE // timedelta(milliseconds=1))


def iso_of_millis(millis: int) -> str:
    """``YYYY-MM-DDTHH:MM:SS.mmm`` in UTC, from year 0 on."""
    shift = 400 if millis < 0 else 0
    shifted = _EPOCH + shift // 400 * _CYCLE + timedelta(milliseconds=millis)
    return f"{shifted.year - shift:04d}{shifted.isoformat(timespec='milliseconds')[4:23]}"
