import math
import random

import pytest

from logweir.operators.reports import latency_summary, latency_summary_approximate, throughput_summary


def nearest_rank(values, p):
    ordered = sorted(values)
    return ordered[min(len(ordered), math.ceil(p / 100 * len(ordered))) - 1] if ordered else 0


@pytest.mark.parametrize("splits", [2, 5, 256])
def test_latency(spark, splits):
    rng = random.Random(splits)
    groups = {
        "hot": [round(rng.expovariate(0.01), 3) for _ in range(3_000)],
        "same": [7.5] * 500,
        "one": [3.25],
        "twenty": [float(n) for n in range(1, 21)],
        None: [float(n) for n in range(100)],
        "empty": [],
    }
    rows = [(name, value) for name, values in groups.items() for value in values] + [("empty", None), ("one", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "endpoint string, ms double")
    found = {row.endpoint: tuple(row)[1:] for row in latency_summary(frame, "ms", "endpoint", splits).collect()}
    assert found == {
        name: (len(values), *(nearest_rank(values, p) for p in (50, 90, 95, 99))) for name, values in groups.items()
    }


def test_latency_approximate(spark):
    frame = spark.createDataFrame([("a", float(n)) for n in range(1, 21)] + [("b", None)], "endpoint string, ms double")
    found = {row.endpoint: tuple(row)[1:] for row in latency_summary_approximate(frame, "ms", "endpoint").collect()}
    assert found == {"a": (20, 10.0, 18.0, 19.0, 20.0), "b": (0, 0.0, 0.0, 0.0, 0.0)}


def test_throughput(spark):
    rows = [(0, 1_000, 100, 90, 10, False), (500, 4_000, 100, 0, 0, True)]
    frame = spark.createDataFrame(rows, "s long, d long, attempted long, accepted long, rejected long, failed boolean")
    log = frame.selectExpr("timestamp_millis(s) sent_at", "timestamp_millis(d) done_at", "attempted", "accepted", "rejected", "failed")
    assert tuple(throughput_summary(log).first()) == (2, 1, 200, 90, 10, 4.0, 50.0, 22.5)
