"""Query parameters: small checked records that the operators take.

``from_params`` accepts text parameters as they come from a caller (a list for
a parameter given more than once) and raises ``ValueError`` with the message
of the first rule that fails.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from logweir import schema
from logweir.functions.timestamps import TIMESTAMP_PATTERN, as_millis, from_millis, iso_of_millis, millis_of, utc

# Fixed value: the accepted attribute keys, 1 to 128 characters.
ATTRIBUTE_KEY = re.compile(r"[A-Za-z0-9_.:-]{1,128}")
_TIMESTAMP = re.compile(TIMESTAMP_PATTERN.replace(r"\z", r"\Z"), re.ASCII)
_LIMIT_ERROR = f"limit must be an integer between 1 and {schema.MAX_LIMIT}"


def parse_millis(text: str) -> int | None:
    """The milliseconds of a strict timestamp, or None."""
    match = _TIMESTAMP.match(text)
    if match is None:
        return None
    *numbers, fraction, zone = match.groups()
    try:
        local = millis_of(*map(int, numbers), int((fraction or "0").ljust(3, "0")) * 1_000)
    except ValueError:
        return None
    if zone == "Z":
        return local
    hours, minutes = int(zone[1:3]), int(zone[4:6])
    if hours > 23 or minutes > 59:
        return None
    offset = (hours * 60 + minutes) * 60_000
    return local + offset if zone[0] == "-" else local - offset


def parse_instant(text: str) -> datetime | None:
    """The UTC instant of a strict timestamp from year 1 on, or None."""
    millis = parse_millis(text)
    try:
        return None if millis is None else from_millis(millis)
    except OverflowError:
        return None


@dataclass(frozen=True)
class QueryCursor:
    """Position of the last row of a page: an instant, as a datetime or in milliseconds, and an id."""

    timestamp: datetime | int
    id: int

    def __post_init__(self) -> None:
        if not isinstance(self.timestamp, int):
            object.__setattr__(self, "timestamp", as_millis(utc(self.timestamp)))

    @property
    def millis(self) -> int:
        return self.timestamp

    @classmethod
    def parse(cls, text: str) -> QueryCursor:
        """From ``<timestamp>,<id>``."""
        instant, _, number = text.partition(",")
        timestamp = parse_millis(instant)
        if timestamp is None or not re.fullmatch("[0-9]+", number) or int(number) > 2**63 - 1:
            raise ValueError("malformed cursor")
        return cls(timestamp, int(number))

    def __str__(self) -> str:
        return f"{iso_of_millis(self.millis)}Z,{self.id}"


@dataclass(frozen=True)
class _Filters:
    service: str | None = None
    level: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)
    q: str | None = None

    def __post_init__(self) -> None:
        if self.level is not None and self.level not in schema.LOG_LEVELS:
            raise ValueError(f"invalid level: '{self.level}'")
        for name in ("since", "until"):
            value = getattr(self, name)
            if isinstance(value, str):
                value = parse_instant(value)
                if value is None:
                    raise ValueError(f"invalid {name}")
            object.__setattr__(self, name, value and utc(value))
        self._check_required()
        if self.since is not None and self.until is not None and self.until <= self.since:
            raise ValueError("until must be strictly later than since")
        self._check_limit()
        if not all(ATTRIBUTE_KEY.fullmatch(key) for key in self.attributes):
            raise ValueError("malformed attr key")
        object.__setattr__(self, "q", self.q or None)

    def _check_required(self) -> None: ...

    def _check_limit(self) -> None: ...


@dataclass(frozen=True)
class LogQuery(_Filters):
    """Arguments of a listing."""

    limit: int = schema.DEFAULT_LIMIT
    cursor: QueryCursor | None = None

    def _check_limit(self) -> None:
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or not 1 <= self.limit <= schema.MAX_LIMIT:
            raise ValueError(_LIMIT_ERROR)

    @classmethod
    def from_params(cls, params: Mapping[str, object]) -> LogQuery:
        read = _Reader(params)
        values = read.filters(required=False)
        limit = read.single("limit")
        if limit is not None and not re.fullmatch("[0-9]+", limit):
            raise ValueError(_LIMIT_ERROR)
        values["limit"] = schema.DEFAULT_LIMIT if limit is None else int(limit)
        cls(**values)
        values["attributes"] = read.attributes()
        values["q"] = read.single("q")
        cursor = read.single("cursor")
        values["cursor"] = None if cursor is None else QueryCursor.parse(cursor)
        return cls(**values)


@dataclass(frozen=True)
class AggregateQuery(_Filters):
    """Arguments of a bucketed count."""

    bucket: str | None = None
    group_by: str | None = None

    def _check_required(self) -> None:
        for name in ("since", "until"):
            if getattr(self, name) is None:
                raise ValueError(f"{name} is required")

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.bucket is None:
            raise ValueError("bucket is required")
        if self.bucket not in schema.BUCKET_SECONDS:
            raise ValueError("invalid bucket")
        if self.group_by is not None and self.group_by not in schema.GROUP_COLUMNS:
            raise ValueError("invalid group_by")

    @property
    def bucket_seconds(self) -> int:
        return schema.BUCKET_SECONDS[self.bucket]

    @classmethod
    def from_params(cls, params: Mapping[str, object]) -> AggregateQuery:
        read = _Reader(params)
        values = read.filters(required=True)
        values["attributes"] = read.attributes()
        values["q"] = read.single("q")
        values["bucket"] = read.single("bucket")
        if values["bucket"] in schema.BUCKET_SECONDS:
            values["group_by"] = read.single("group_by")
        return cls(**values)


class _Reader:
    """Reads text parameters one by one, in the order the rules are checked."""

    def __init__(self, params: Mapping[str, object]) -> None:
        if not isinstance(params, Mapping):
            raise ValueError("query parameters must be an object")
        self.params = params

    def single(self, name: str) -> str | None:
        return None if self.params.get(name) is None else self._text(name)

    def _text(self, name: str) -> str:
        value = self.params[name]
        if isinstance(value, (list, tuple)):
            raise ValueError(f"{name} must be provided only once")
        if not isinstance(value, str):
            raise ValueError(f"{name} must be a string")
        return value

    def filters(self, required: bool) -> dict:
        values = {"service": self.single("service"), "level": self.single("level")}
        _Filters(**values)
        for name in ("since", "until"):
            values[name] = self.single(name)
            if required and values[name] is None:
                raise ValueError(f"{name} is required")
            _Filters(**{name: values[name]})
        _Filters(**values)
        return values

    def attributes(self) -> dict[str, str]:
        found = {}
        for name in self.params:
            if name.startswith("attr."):
                key = name.removeprefix("attr.")
                if not ATTRIBUTE_KEY.fullmatch(key):
                    raise ValueError("malformed attr key")
                found[key] = self._text(name)
        return found
