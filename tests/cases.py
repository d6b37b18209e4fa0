"""Shared inputs: a plain entry, and logs drawn from a seed so that they hold the awkward cases of listing and counting."""

import json
import random
from datetime import datetime, timedelta

NOW = "2021-03-09T06:41:00.000Z"
BASE = {
    "service": "gauge",
    "level": "info",
    "timestamp": "2021-03-09T06:41:07.250Z",
    "attributes": {"load": 0.5, "mast": "b"},
    "message": "wind from the north",
}
GOLDEN_NOW = "2026-08-08T00:00:00Z"
ABSENT = object()


def entry(**changes) -> dict:
    changed = {**BASE, **changes}
    return {key: value for key, value in changed.items() if value is not ABSENT}


FIRST_AT = datetime(2011, 3, 5, 9, 10)
#: With LIKE signs, a backslash, and words in either case.
PHRASES = ("crane {} is idle", "CRANE {} Idle again", "at 50% of {} tons", "slot_{} open", "belt\\{} slow", "{} empty")


def _places(rng: random.Random) -> list[int]:
    """Milliseconds after the first log: some at random, two at one instant, both sides of a bucket's edge, the next midnight."""
    drawn = rng.sample(range(1, 3 * 3_600_000), 5)
    edge = 300_000 * rng.randint(3, 30)
    midnight = (FIRST_AT.replace(hour=0, minute=0) + timedelta(days=1) - FIRST_AT) // timedelta(milliseconds=1)
    return sorted([0, *drawn, rng.choice(drawn), edge - 1, edge, midnight])


def golden() -> list[dict]:
    """Ten logs in the order of time, with text, number and boolean attributes, and one that is often missing."""
    rng = random.Random(2011)
    found = []
    for k, place in enumerate(_places(rng)):
        at = FIRST_AT + timedelta(milliseconds=place)
        attributes = {"crate": rng.choice("KLM") + str(rng.randint(1, 2)), "kilos": rng.choice([0, 4, 2.5, -7]), "sealed": rng.random() < 0.4}
        attributes |= {"dock": rng.choice(["east", "west"])} if rng.random() < 0.5 else {}
        found.append({
            "timestamp": at.isoformat(timespec="milliseconds") + "Z", "level": rng.choice(["debug", "info", "warn", "warn", "error"]),
            "service": rng.choice(["yard", "yard", "scale", "ferry"]), "message": f"{rng.choice(PHRASES).format(rng.randint(1, 3))} ({k})", "attributes": attributes,
        })
    return found


def body(*entries) -> str:
    return json.dumps({"logs": list(entries)})


def requests(spark, *bodies, first: int = 0):
    rows = [(first + i, text) for i, text in enumerate(bodies)]
    return spark.createDataFrame(rows, "request_seq long, body string")
