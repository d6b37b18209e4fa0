import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweir.operators.filters import instant
from logweir.operators import ranking
from logweir.operators.ranking import assign_ids, exclusive_prefix_sum, kth_oldest, newest_first_rank, time_ranges

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def logs(spark, rows):
    return spark.createDataFrame(rows, "ms long, id long").select(F.timestamp_millis("ms").alias("timestamp"), "id")


def skewed_rows(seed=1):
    """A third of the rows share one instant, another third one minute; ids are sparse."""
    rng = random.Random(seed)
    ids = rng.sample(range(-5_000, 2_000_000), 900)
    return [
        (60_000 * 7 + 5 if i % 3 == 0 else 60_000 * 9 + rng.randrange(60_000) if i % 3 == 1 else rng.randrange(-10**7, 10**7), n)
        for i, n in enumerate(ids)
    ]


@pytest.mark.parametrize(("levels", "block"), [(0, 10), (1, 10), (3, 7)])
def test_prefix_sum(spark, levels, block):
    keys = [-(2**62), -50, -3, 0, 1, 2, 9, 10, 11, 500, 10**12, 2**62]
    frame = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "k long, n long")
    found = dict(exclusive_prefix_sum(frame, "k", "n", levels=levels, block=block).select("k", "before").collect())
    assert found == {k: sum(range(1, i + 1)) for i, k in enumerate(keys)}


@pytest.mark.parametrize("partitions", [1, 5])
def test_ids_do_not_depend_on_partitioning(spark, partitions):
    rng = random.Random(3)
    rows = [(seq, i) for seq in rng.sample(range(10**9), 60) for i in range(1, 30) if rng.random() < 0.7]
    expected = {row: 100 + n for n, row in enumerate(sorted(rows))}
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "request_seq long, entry_index int").repartition(partitions)
    found = assign_ids(frame, 100).collect()
    assert {(row.request_seq, row.entry_index): row.id for row in found} == expected


@pytest.mark.parametrize("hot_rows", [1, 100, 1_000_000])
def test_newest_first_rank(spark, hot_rows):
    rows = skewed_rows()
    ranked = newest_first_rank(logs(spark, rows), hot_rows=hot_rows, block=50)
    found = {row.id: row["rank"] for row in ranked.collect()}
    assert found == {n: i + 1 for i, (_, n) in enumerate(sorted(rows, reverse=True))}


@pytest.mark.parametrize("finish", [1, 20, 10_000])
def test_kth_oldest(spark, finish):
    rows = skewed_rows(2)
    frame = logs(spark, rows).cache()
    ordered = sorted(rows)
    for k in (1, 2, 299, 450, 640, 899, 900):
        ms, number = ordered[k - 1]
        assert kth_oldest(frame, k, slots=8, finish=finish) == (ms, number)
    assert kth_oldest(frame, 901) is None
    frame.unpersist()


def test_instant_literal(spark):
    at = datetime(1969, 12, 31, 23, 59, 59, 999_000, UTC)
    assert spark.range(1).select(F.unix_millis(instant(at))).first()[0] == -1


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_ids_with_and_without_a_broadcast(spark, monkeypatch, bytes_):
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", bytes_)
    rng = random.Random(9)
    rows = [(seq, i) for seq in rng.sample(range(10**6), 40) for i in range(rng.randint(1, 60)) if seq % 3 == 0 or rng.random() < 0.5]
    expected = {row: 1 + n for n, row in enumerate(sorted(rows))}
    rng.shuffle(rows)
    found = assign_ids(spark.createDataFrame(rows, "request_seq long, entry_index int").repartition(4))
    assert {(row.request_seq, row.entry_index): row.id for row in found.collect()} == expected


@pytest.mark.parametrize(("n", "slots"), [(1, 16), (4, 16), (7, 5), (40, 4_096), (9, 1)])
def test_time_ranges(spark, monkeypatch, n, slots):
    """Partitions are ranges of time of bounded size; only a hot millisecond is in several."""
    rows = skewed_rows()
    monkeypatch.setattr(ranking, "FEW_ROWS", -(-len(rows) // n))
    frame = logs(spark, rows).repartition(3)
    ranged = time_ranges(frame, frame, n, max(2, slots))
    found = ranged.select(F.spark_partition_id().alias("p"), F.unix_millis("timestamp").alias("ms"), "id").collect()
    assert sorted((row.ms, row.id) for row in found) == sorted(rows)
    spans = {}
    for row in found:
        spans.setdefault(row.p, []).append(row.ms)
    most = -(-len(rows) // n)
    # The hot millisecond is dealt out by id, about evenly.
    assert all(len(own) <= most or len({*own}) == 1 and len(own) < 2 * most for own in spans.values())
    ordered = [(min(own), max(own)) for _, own in sorted(spans.items())]
    assert all(a[1] < b[0] or a[0] == a[1] == b[0] == b[1] for a, b in zip(ordered, ordered[1:], strict=False))
    assert n == 1 or len(spans) >= n - 1


@pytest.mark.parametrize(("rows", "at_least", "expected"), [(0, 8, 1), (1, 8, 1), (120_000, 8, 3), (10**6, 8, 8), (10**9, 8, 500), (10**9, 2_000, 2_000)])
def test_partitions_for(rows, at_least, expected):
    assert ranking.partitions_for(rows, at_least) == expected


def test_time_ranges_of_nothing(spark):
    frame = logs(spark, [])
    assert time_ranges(frame, frame, 4).count() == 0
    one = logs(spark, [(5, 1)])
    assert time_ranges(one, one, 4).count() == 1


def test_time_ranges_from_few_literals(spark, monkeypatch):
    """A literal for each slot kept the driver busy for half a minute a batch; hot slots are cut in few literals, too."""
    made, lit = [], F.lit
    monkeypatch.setattr(F, "lit", lambda value: made.append(value) or lit(value))
    hot = F.when(F.col("id") % 3 == 0, 86_400_000 + F.col("id") % 7).otherwise(F.col("id") * 997)
    frame = spark.range(400_000).select("id", F.timestamp_millis(hot).alias("timestamp"))
    ranged = time_ranges(frame, frame, 16).groupBy(F.spark_partition_id().alias("part"))
    sizes = ranged.agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).orderBy("first", "last", "part").collect()
    assert len(made) < 200 and sum(size.n for size in sizes) == 400_000 and max(size.n for size in sizes) <= 50_000
    assert all(one.last <= other.first for one, other in zip(sizes, sizes[1:]))
