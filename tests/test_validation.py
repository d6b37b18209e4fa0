import json
import time

import pytest
from cases import ABSENT, BASE, NOW, body, entry, requests
from pyspark.sql import functions as F

from logweir.functions.attributes import add_search_map, ordered_keys
from logweir.functions.timestamps import iso_timestamp
from logweir.operators.validation import BEYOND_LIMITS, NOT_AN_OBJECT, batch_report, rejected_rows, settle_attribute_order, validate_entries
from logweir.sources.requests import BLOCK, PIECES, explode_entries, explode_requests, parse_requests

FLAT = "attributes must be a flat object"


def scalar(key):
    return f"invalid attributes.{key}: must be string, number, or boolean"


def required(field):
    return f"{field} is required and must be a string"


FUTURE = "timestamp is more than 5 minutes in the future"
GOOD_AT = BASE["timestamp"]
#: One change each to a good timestamp.
BAD_TIMES = [
    GOOD_AT.replace("T", " "), GOOD_AT.replace("T", "t"), GOOD_AT.replace("Z", "z"), GOOD_AT.replace("Z", ""), GOOD_AT.replace("-03-", "-13-"),
    GOOD_AT.replace("03-09", "04-31"), GOOD_AT.replace("03-09", "02-29"), GOOD_AT.replace(":07.", ":60."), GOOD_AT.replace("06:", "24:"),
    GOOD_AT.replace("Z", "+24:00"), GOOD_AT.replace("250", "2501"), GOOD_AT.replace("250", ""), GOOD_AT + "\n", " " + GOOD_AT, "soon", "",
]
GOOD_TIMES = [GOOD_AT.replace("Z", "+00:00"), "2021-03-10T06:40:00+23:59", "2016-02-29T12:00:00.5Z", "2021-03-09T06:46:00.000Z"]
#: Values of each kind that is no text, and texts of each kind that are blank.
NO_TEXTS = [ABSENT, None, 17.5, 0, True, [], ["warn"], {}, {"text": "warn"}]
BLANKS = ["", " ", "\t \r\n", "\u2003\u3000", "\ufeff\u00a0"]
NO_SCALARS = [None, [], [0], ["x", "y"], {}, {"deep": {"er": 1}}]
NO_OBJECTS = [None, 0, 3.5, True, "text", [], [BASE], json.dumps(BASE)]

CASES = [
    (BASE, None),
    (entry(attributes=ABSENT), None),
    (entry(attributes={}), None),
    (entry(attributes={"VOID": "DOUBLE", "ARRAY": 1.5}), None),
    (entry(service="\u200b"), None),
    *[(entry(level=level), None) for level in ("debug", "info", "warn", "error")],
    *[(entry(level=level), f"invalid level: '{level}'") for level in ("fatal", "Warn", "INFO", " debug", "")],
    *[(entry(**{field: value}), required(field)) for field in ("timestamp", "level", "service", "message") for value in NO_TEXTS],
    *[(entry(**{field: text}), f"{field} must be non-empty") for field in ("service", "message") for text in BLANKS],
    *[(entry(timestamp=text), "invalid timestamp") for text in BAD_TIMES],
    *[(entry(timestamp=text), None) for text in GOOD_TIMES],
    (entry(timestamp="2021-03-09T06:46:00.001Z"), FUTURE),
    *[(entry(attributes={"ok": 1, f"key{k}": value}), scalar(f"key{k}")) for k, value in enumerate(NO_SCALARS)],
    *[(entry(attributes=value), FLAT) for value in NO_OBJECTS],
    *[(value, "log entry must be an object") for value in NO_OBJECTS],
    ({}, required("timestamp")),
    # Several faults: the first rule decides.
    ({"level": 1, "service": 2, "message": 3, "attributes": 4}, required("timestamp")),
    (entry(level="x", service="", message="", attributes=[]), "invalid level: 'x'"),
    (entry(service="", message="", attributes=[]), "service must be non-empty"),
    (entry(message="", attributes=[]), "message must be non-empty"),
]


def validate(spark, *entries, now=NOW):
    return validate_entries(explode_entries(parse_requests(requests(spark, body(*entries)))), now)


def test_reasons(spark):
    rows = validate(spark, *(case for case, _ in CASES)).orderBy("entry_index").collect()
    assert [(row.entry_index, row.reason) for row in rows] == [(i, reason) for i, (_, reason) in enumerate(CASES)]
    for row, (case, reason) in zip(rows, CASES):
        if reason is None:
            assert (row.service, row.message, row.raw) == (case["service"], case["message"], None)
        else:
            assert (row.timestamp, row.level, row.service, row.message, row.attributes) == (None,) * 5
            assert json.loads(row.raw) == case


def test_accepted_fields(spark):
    extra = entry(id=7, unknown={"a": 1}, timestamp="2021-03-09T08:41:07.1+02:00")
    validated = validate(spark, extra, entry(attributes=ABSENT))
    rows = validated.select(
        "*", iso_timestamp(F.col("timestamp")).alias("iso"), F.to_json("attributes").alias("json")
    ).orderBy("entry_index").collect()
    assert rows[0].iso == "2021-03-09T06:41:07.100Z"
    assert json.loads(rows[0].json) == BASE["attributes"]
    assert rows[0].attributes_search == {"load": "0.5", "mast": "b"}
    assert (rows[1].json, rows[1].attributes_search) == ("{}", {})
    assert "unknown" not in validated.columns


NUMBERS = {
    "3": "3", "3.0": "3", "1.50": "1.5", "1e2": "100", "1e21": "1e+21", "1e-7": "1e-7", "1e-6": "0.000001",
    "-0": "0", "-0.0": "0", "12345678901234567890": "12345678901234567000", "0.0000001": "1e-7",
    "123456789012345678": "123456789012345680", "9007199254740991": "9007199254740991", "-1.5e-9": "-1.5e-9",
    "8.41E21": "8.41e+21", "1.7976931348623157e308": "1.7976931348623157e+308", "5e-324": "5e-324",
    "123456.789": "123456.789", "0.1234567890123456789": "0.12345678901234568", "1e20": "100000000000000000000",
    "-250": "-250", "0.000001": "0.000001", "100": "100",
}


def test_number_texts(spark):
    with_number = ['{"n":%s,"s":"x","b":true,"i":7}' % number for number in NUMBERS]
    logs = ",".join('{"timestamp":"2021-01-01T00:00:00Z","level":"info","service":"s","message":"m","attributes":%s}' % a for a in with_number)
    validated = validate_entries(explode_entries(parse_requests(requests(spark, '{"logs":[%s]}' % logs))), NOW)
    rows = add_search_map(validated).orderBy("entry_index").collect()
    assert {n: row.attributes_search["n"] for n, row in zip(NUMBERS, rows)} == NUMBERS
    assert all({**row.attributes_search, "n": ""} == {"n": "", "s": "x", "b": "true", "i": "7"} for row in rows)


def test_infinite_and_duplicate(spark):
    text = '{"timestamp":"2021-01-01T00:00:00Z","level":"info","service":"s","message":"m","attributes":%s}'
    attributes = ['{"i":1e400}', '{"i":-1e400}', '{"a":null,"a":1}', '{"a":1,"a":null}']
    logs = ",".join(text % a for a in attributes)
    rows = validate_entries(explode_entries(parse_requests(requests(spark, '{"logs":[%s]}' % logs))), NOW)
    found = [row.reason for row in rows.orderBy("entry_index").collect()]
    infinite = "invalid attributes.i: number must be finite"
    assert found == [infinite, infinite, None, scalar("a")]


def test_first_bad_attribute_in_sent_order(spark):
    sent = requests(
        spark,
        body(entry(attributes={"zeta": None, "ok": 1, "alpha": []}), entry(attributes={"b": {}, "10": {}, "9": None})),
        body(entry(level="x", attributes={"z": None, "a": None}), entry(attributes={"only": None})),
    )
    rejects = validate_entries(explode_entries(parse_requests(sent)), NOW).where("reason is not null")
    settled = settle_attribute_order(rejects, sent).orderBy("request_seq", "entry_index").collect()
    assert [row.reason for row in settled] == [scalar("zeta"), scalar("9"), "invalid level: 'x'", scalar("only")]


LONG, DEEP = "7" * 1_500, "[" * 1_200 + "]" * 1_200


@pytest.mark.parametrize("value", [LONG, DEEP, '{"a":' * 1_100 + "1" + "}" * 1_100])
def test_an_entry_beyond_the_parsers_limits(spark, value):
    """Its neighbours survive, in their places and with their reasons; only syntax refuses a body."""
    good = json.dumps(entry(message='a "quoted", [x} \\ é \\"'))
    bad = '{"timestamp":"2021-01-01T00:00:00Z","attributes":{"n":%s}}' % value
    unsure = json.dumps(entry(attributes={"zeta": None, "ok": 1, "alpha": []}))
    bodies = [
        '{"x":{"logs":[1]},"logs":[9],"kind":"logs", "l\\u006fgs" : [ %s ,%s, "a,b", null,\n%s,%s]}' % (good, bad, unsure, good),
        '{"logs":[%s,%s,{"b":}]}' % (good, bad),
        '{"logs":[%s,%s]} x' % (good, bad),
        '{"logs":[%s],"logs":{"n":%s}}' % (good, value),
        '{"q":%s,"logs":[%s]}' % (value, good),
        '{"q":%s,"logs":[ ]}' % value,
        '["logs",[%s,%s]]' % (good, bad),
    ]
    sent = requests(spark, *bodies)
    parsed = parse_requests(sent)
    states = [row.n_entries for row in parsed.orderBy("request_seq").collect()]
    assert states == [6, None, None, None, 1, 0, None]
    validated = validate_entries(explode_entries(parsed), NOW)
    rows = validated.orderBy("request_seq", "entry_index").collect()
    of_first = [row.reason for row in rows[:6]]
    assert of_first[:4] == [None, BEYOND_LIMITS, NOT_AN_OBJECT, NOT_AN_OBJECT] and of_first[5] is None
    assert rows[1].raw == bad and rows[0].message == rows[5].message == 'a "quoted", [x} \\ é \\"'
    assert [row.reason for row in rows[6:]] == [None]
    settled = settle_attribute_order(validated.where("reason is not null"), sent).where("entry_index = 4").collect()
    assert [row.reason for row in settled] == [scalar("zeta")]


@pytest.mark.parametrize("place", ["first", "last", "alone"])
def test_what_is_beyond_the_limits_is_one_entry(spark, place):
    """Long numbers as entries, several faults in one entry, and values at the limits themselves."""
    good, exact = json.dumps(entry()), '{"n":%s}' % ("8" * 1_000)
    bad = [LONG, "-" + LONG + ".5e3", '{"a":[%s,{"b":%s}],"c":"] \\" }"}' % (LONG, DEEP), "[%s , %s]" % (LONG, LONG), '"%s"' % LONG]
    sent = bad + [good, exact] if place == "first" else [good, exact, *bad] if place == "last" else bad
    rows = validate_entries(explode_entries(parse_requests(requests(spark, '{"logs":[%s]}' % " ,\n".join(sent)))), NOW).orderBy("entry_index").collect()
    found = {text: (row.reason, row.raw) for text, row in zip(sent, rows, strict=True)}
    assert [found[text] for text in bad[:4]] == [(BEYOND_LIMITS, text) for text in bad[:4]]
    assert found[bad[4]][0] == NOT_AN_OBJECT
    if place != "alone":
        assert found[good][0] is None and found[exact][0] == "timestamp is required and must be a string"


@pytest.mark.parametrize("shape", ["[%s]", '{"k":"a,{[","v":[%s,{"w":{}}]}', "%s"])
def test_cutting_takes_a_time_in_proportion_to_the_length(spark, shape):
    """Sixteen times the entries take less than forty times as long; a body of over 5,000 is refused as any other."""

    def seconds(n):
        body = '{"logs":[%s,%s]}' % (",".join([shape % "1"] * n), LONG)
        sent = requests(spark, body).repartition(1)
        began = time.monotonic()
        row = parse_requests(sent).select("n_entries", "error").first()
        assert tuple(row) == (n + 1, None if n < 5_000 else "logs batch exceeds maximum of 5000")
        return time.monotonic() - began

    seconds(1_000)
    few = min(seconds(4_000) for _ in range(2))
    assert seconds(64_000) < 40 * max(few, 0.2)


def test_brackets_in_a_row_are_one_piece(spark):
    """The steps through a body follow its entries, not its brackets; cuts hold across blocks of steps."""
    bad = '{"n":{"m":%s}}' % DEEP
    sent = [bad, json.dumps(entry()), DEEP, '{"n":%s}' % LONG] * (BLOCK // 8)
    text = '{"logs":[%s]}' % ", ".join(sent)
    row = requests(spark, text).select(F.regexp_extract_all("body", F.lit(PIECES), F.lit(0)).alias("pieces")).first()
    assert "".join(row.pieces) == text and BLOCK < len(row.pieces) < 8 * len(sent)
    rows = validate_entries(explode_entries(parse_requests(requests(spark, text))), NOW).orderBy("entry_index").collect()
    refused = [(BEYOND_LIMITS, text) for text in sent[:4]]
    assert [(row.reason, row.raw) for row in rows] == [refused[0], (None, None), refused[2], refused[3]] * (BLOCK // 8)


def test_ordered_keys(spark):
    text = '{"b":1,"2":1,"a":{"x":1},"01":1,"10":1,"4294967295":1,"b":2,"0":1}'
    found = spark.createDataFrame([(text,)], "t string").select(ordered_keys(F.col("t"))).first()[0]
    assert found == ["0", "2", "10", "b", "a", "01", "4294967295"]


def report(spark, *bodies):
    parsed = explode_requests(parse_requests(requests(spark, *bodies)))
    validated = validate_entries(parsed, NOW)
    rows = batch_report(
        validated.where("entry_index is null"), validated.where("entry_index is not null")
    ).orderBy("request_seq").collect()
    return [(r.status, r.accepted, [tuple(x) for x in r.rejected], r.error) for r in rows]


def test_batch_report(spark):
    fatal = (1, "invalid level: 'fatal'")
    not_a_batch = ("refused", 0, [], "request body must be an object with a logs array")
    assert report(
        spark,
        body(BASE, BASE, BASE),
        body(BASE, entry(level="fatal"), BASE),
        body(entry(level="fatal"), entry(message="")),
        "{}",
        '{"logs":"x"}',
        '{"logs":null}',
        "[1]",
        '{"logs":[',
        '{"logs":[]}',
        body(*[BASE] * 5000),
        body(*[BASE] * 5001),
    ) == [
        ("ok", 3, [], None),
        ("ok", 2, [fatal], None),
        ("all_rejected", 0, [(0, fatal[1]), (1, "message must be non-empty")], None),
        *[not_a_batch] * 5,
        ("all_rejected", 0, [(-1, "logs must contain at least one entry")], None),
        ("ok", 5000, [], None),
        ("refused", 0, [], "logs batch exceeds maximum of 5000"),
    ]


def test_rejects_keep_the_submitted_index(spark):
    rows = rejected_rows(validate(spark, BASE, 1, BASE, entry(service=""))).orderBy("entry_index").collect()
    assert [(row.entry_index, row.reason) for row in rows] == [
        (1, "log entry must be an object"),
        (3, "service must be non-empty"),
    ]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        millis = validate(spark, BASE).select(F.unix_millis("timestamp")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert millis == 1615272067250
