"""Positions in a total order, without a global sort or an unbounded window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.filters import instant
from logweir.session import cut_lineage

BLOCK = 65_536
HOT_ROWS = 1_000_000
SLOTS = 4_096
#: Rows of a file, at least where fewer files do, and at most.
FEW_ROWS, MOST_ROWS = 50_000, 2_000_000
#: Offsets of requests up to this size are sent to all tasks.
BROADCAST_BYTES = 8 << 20
MINUTE_MS = 60_000


def _floor_div(value: Column, size: int) -> Column:
    """Exact floor division of LONGs (a double would misplace large keys)."""
    return F.call_function("div", value - F.pmod(value, F.lit(size)), F.lit(size))


def _running_before(value: str, order: str, within: list[str]) -> Column:
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def exclusive_prefix_sum(
    counts: DataFrame, key: str, value: str, within: list[str] | None = None, levels: int = 3, block: int = BLOCK
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all smaller keys (of the same ``within`` group).

    Keys are unique LONGs. They are cut into blocks of ``block`` consecutive
    keys; the block totals are summed up the same way, ``levels`` times. Each
    window partition below the top holds at most ``block`` rows, and the top one
    at most ``key range / block**levels`` (32,769 for three levels over any LONG).
    """
    within = within or []
    if levels == 0:
        return counts.withColumn("before", _running_before(value, key, within))
    block_key = f"{key}_block"
    blocked = counts.withColumn(block_key, _floor_div(F.col(key), block))
    totals = blocked.groupBy(*within, block_key).agg(F.sum(value).alias(value))
    starts = exclusive_prefix_sum(totals, block_key, value, within, levels - 1, block).select(
        *within, block_key, F.col("before").alias("block_before")
    )
    inner = blocked.withColumn("inner_before", _running_before(value, key, [*within, block_key]))
    return (
        inner.join(starts, [*within, block_key])
        .withColumn("before", F.col("block_before") + F.col("inner_before"))
        .drop(block_key, "block_before", "inner_before")
    )


def _levels(counts: DataFrame, key: str, block: int = BLOCK) -> int:
    """Levels needed for the key range at hand, so that no window partition exceeds ``block`` rows."""
    return _levels_between(*counts.agg(F.min(key), F.max(key)).first(), block)


def _levels_between(low: int | None, high: int | None, block: int = BLOCK) -> int:
    levels, keys = 0, 1 if low is None else high - low + 1
    while keys > block:
        keys = keys // block + 2
        levels += 1
    return levels


def assign_ids(accepted: DataFrame, first_id: int = 1) -> DataFrame:
    """Consecutive ids in the order ``(request_seq, entry_index)``.

    The same input always gets the same ids, whatever its partitioning. A row's
    id is the number of rows in requests before its own, plus its place there.
    Places come from a mask of the request's accepted indexes, at most 5,000 signs, and null
    where all are. So only indexes are grouped; the rows themselves stay where they are if
    the offsets and masks are at most ``BROADCAST_BYTES``, and move once otherwise.
    """
    indexes = F.sort_array(F.collect_list("entry_index")).alias("indexes")
    grouped = accepted.groupBy("request_seq").agg(indexes).withColumn("n", F.size("indexes").cast("long"))

    def sign(index: Column, k: Column) -> Column:
        return F.concat(F.repeat(F.lit("0"), index - F.coalesce(F.get("indexes", k - 1), F.lit(-1)) - 1), F.lit("1"))

    mask = F.when(F.col("n") <= F.element_at("indexes", -1), F.array_join(F.transform("indexes", sign), ""))
    counts = cut_lineage(grouped.select("request_seq", "n", mask.alias("mask")))
    low, high, size = counts.agg(F.min("request_seq"), F.max("request_seq"), F.sum(24 + F.coalesce(F.length("mask"), F.lit(0)))).first()
    sums = exclusive_prefix_sum(counts, "request_seq", "n", levels=_levels_between(low, high))
    offsets = sums.select("request_seq", "before", "mask")
    if (size or 0) <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    inside = F.when(F.col("mask").isNull(), F.col("entry_index") + 1).otherwise(
        F.length(F.replace(F.substring(F.col("mask"), F.lit(1), F.col("entry_index") + 1), F.lit("0"), F.lit("")))
    )
    return (
        accepted.join(offsets, "request_seq")
        .withColumn("id", F.lit(first_id - 1) + F.col("before") + inside)
        .drop("before", "mask")
    )


def newest_first_rank(logs: DataFrame, hot_rows: int = HOT_ROWS, block: int = BLOCK) -> DataFrame:
    """Add ``rank``: 1 for the newest row by ``(timestamp, id)``; ``id`` is unique.

    Rows are counted per minute, and a row's rank is the count of all newer
    minutes plus its place in its own minute. A minute with more than
    ``hot_rows`` rows is cut further, by millisecond and by blocks of ``block``
    ids, so that no window partition outgrows ``max(hot_rows, block)`` rows even
    when one instant holds most of the table.
    """
    millis = F.unix_millis("timestamp")
    # Negated keys: the sums run over newer rows.
    keyed = logs.withColumn("minute_key", -_floor_div(millis, MINUTE_MS))
    counts = cut_lineage(keyed.groupBy("minute_key").agg(F.count("*").alias("n")))
    minutes = exclusive_prefix_sum(counts, "minute_key", "n", levels=_levels(counts, "minute_key"))
    calm = keyed.join(minutes.where(F.col("n") <= hot_rows), "minute_key")
    in_minute = Window.partitionBy("minute_key").orderBy(F.desc("timestamp"), F.desc("id"))
    calm = calm.select(*logs.columns, (F.col("before") + F.row_number().over(in_minute)).alias("rank"))
    if counts.where(F.col("n") > hot_rows).isEmpty():
        return calm

    hot_minutes = minutes.where(F.col("n") > hot_rows).select(
        "minute_key", F.col("before").alias("minute_before")
    )
    hot = (
        keyed.join(hot_minutes, "minute_key")
        .withColumn("ms_key", -millis)
        .withColumn("id_key", -_floor_div(F.col("id"), block))
    )
    cells = cut_lineage(hot.groupBy("minute_key", "ms_key", "id_key").agg(F.count("*").alias("n")))
    instants = cells.groupBy("minute_key", "ms_key").agg(F.sum("n").alias("n"))
    instants = exclusive_prefix_sum(instants, "ms_key", "n", ["minute_key"], levels=0).select(
        "ms_key", F.col("before").alias("ms_before")
    )
    cells = (
        exclusive_prefix_sum(cells, "id_key", "n", ["ms_key"], levels=2)
        .select("ms_key", "id_key", F.col("before").alias("cell_before"))
        .join(instants, "ms_key")
    )
    in_cell = Window.partitionBy("ms_key", "id_key").orderBy(F.desc("id"))
    hot = hot.join(cells, ["ms_key", "id_key"]).select(
        *logs.columns,
        (
            F.col("minute_before")
            + F.col("ms_before")
            + F.col("cell_before")
            + F.row_number().over(in_cell)
        ).alias("rank"),
    )
    return calm.unionByName(hot)


def kth_oldest(logs: DataFrame, k: int, slots: int = SLOTS, finish: int = 10_000) -> tuple[int, int] | None:
    """``(milliseconds, id)`` of the k-th oldest row, or None when there are fewer rows.

    Counts rows in ``slots`` equal ranges, keeps the one the k-th row falls
    into and repeats inside it, first by timestamp, then by id. The driver sees
    ``slots`` counts at a time; later passes read the narrowed range only.
    """
    times = logs.select("timestamp", "id")
    low, high, rows = times.agg(
        F.min(F.unix_millis("timestamp")), F.max(F.unix_millis("timestamp")), F.count("*")
    ).first()
    if rows < k:
        return None

    def in_millis(lo: int, hi: int) -> DataFrame:
        return times.where(
            (F.col("timestamp") >= F.timestamp_millis(F.lit(lo)))
            & (F.col("timestamp") < F.timestamp_millis(F.lit(hi + 1)))
        )

    def narrow(select, key: Column, lo: int, hi: int, k: int, rows: int):
        while lo < hi and rows > finish:
            width = -(-(hi - lo + 1) // slots)
            slot = _floor_div(key - F.lit(lo), width).alias("slot")
            for number, rows in sorted(map(tuple, select(lo, hi).groupBy(slot).count().collect())):
                if k <= rows:
                    break
                k -= rows
            lo = lo + number * width
            hi = min(hi, lo + width - 1)
        return lo, hi, k, rows

    low, high, k, rows = narrow(in_millis, F.unix_millis("timestamp"), low, high, k, rows)
    same = in_millis(low, high)
    if rows > finish:  # one instant holds more than `finish` rows
        def in_ids(lo: int, hi: int) -> DataFrame:
            return same.where(F.col("id").between(lo, hi))

        first, last = same.agg(F.min("id"), F.max("id")).first()
        first, last, k, rows = narrow(in_ids, F.col("id"), first, last, k, rows)
        same = in_ids(first, last)
    millis = F.unix_millis("timestamp").alias("millis")
    row = same.orderBy("timestamp", "id").limit(k).orderBy(F.desc("timestamp"), F.desc("id")).select(millis, "id").first()
    return row["millis"], row["id"]


def up_to(position: tuple[int, int]) -> Column:
    """``(timestamp, id) <= position`` (milliseconds and id), in a form that is pushed down."""
    at, number = instant(position[0]), F.lit(position[1])
    return (F.col("timestamp") <= at) & ((F.col("timestamp") < at) | (F.col("id") <= number))


def partitions_for(rows: int, at_least: int) -> int:
    """Partitions of at most ``MOST_ROWS`` rows, and up to ``at_least`` of ``FEW_ROWS``."""
    return max(1, min(at_least, -(-rows // FEW_ROWS)), -(-rows // MOST_ROWS))


def _constants(values: Sequence[int]) -> Column:
    """Array of LONGs from one literal, which the optimizer turns into a constant; a literal for each value takes the driver milliseconds."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def time_ranges(logs: DataFrame, spans: DataFrame, at_least: int, slots: int = SLOTS) -> DataFrame:
    """``logs`` (with ``timestamp, id``) in partitions of about equal size, each a range of time.

    ``spans`` has the same timestamps. They are counted in ``slots`` equal parts of
    their range (the driver sees as many counts); slots that follow each other
    share a partition, and one with more rows than a partition should have is counted again
    in parts. What no time can divide, a single hot millisecond, is dealt out by id.
    A row finds its partition by the number of its slot; only in slots that are cut
    it is compared with the parts.
    """
    millis = F.unix_millis("timestamp")
    low, high, rows = spans.agg(F.min(millis), F.max(millis), F.count("*")).first()
    n = partitions_for(rows, at_least)
    if n == 1:
        return logs.repartitionById(1, F.lit(0))
    most = -(-rows // n)

    def counted(lo: int, hi: int) -> list[tuple[int, int, int]]:
        """``(first, last, rows)`` of the slots of ``[lo, hi]`` in order."""
        width = -(-(hi - lo + 1) // slots)
        slot = _floor_div(millis - F.lit(lo), width).alias("slot")
        inside = spans.where((F.col("timestamp") >= F.timestamp_millis(F.lit(lo))) & (F.col("timestamp") < F.timestamp_millis(F.lit(hi + 1))))
        found = sorted(map(tuple, inside.groupBy(slot).count().collect()))
        return [(lo + number * width, min(hi, lo + (number + 1) * width - 1), count) for number, count in found]

    def cells(first: int, last: int, count: int) -> list[tuple[int, int]]:
        """``(first, rows)`` of a slot's parts, none of several milliseconds with over ``most`` rows."""
        if count <= most or first == last:
            return [(first, count)]
        return [cell for part in counted(first, last) for cell in cells(*part)]

    width = -(-(high - low + 1) // slots)
    # By slot: its partition and the number of them, or where to find those of its parts.
    places, parts, cut = [0] * slots, [1] * slots, []
    place, filled = 0, 0
    for first, last, count in counted(low, high):
        starts = []
        for begin, size in cells(first, last, count):
            if filled and filled + size > most:
                place, filled = place + 1, 0
            starts.append((begin, place, max(1, -(-size // most))))
            filled += size
            if size > most:
                place, filled = place + starts[-1][2], 0
        number = (first - low) // width
        if len(starts) > 1:
            cut.append(starts)
            places[number] = -len(cut)
        else:
            _, places[number], parts[number] = starts[0]
    total = place + (1 if filled else 0)

    number = _floor_div(millis - F.lit(low), width).cast("int") + 1
    of_slot = F.struct(F.element_at(_constants(places), number).alias("place"), F.element_at(_constants(parts), number).alias("parts"))
    if cut:
        # The parts of all cut slots, one slot after the other, and where those of a slot begin and end.
        ends = list(accumulate(map(len, cut)))
        bounds, firsts, many = (_constants(values) for values in zip(*(start for starts in cut for start in starts)))
        which = (-F.element_at(_constants(places), number)).cast("int")
        before, after = (column.cast("int") for column in (F.element_at(_constants([0, *ends]), which), F.element_at(_constants(ends), which)))
        at = before + F.size(F.filter(F.slice(bounds, before + 1, after - before), lambda bound: bound <= millis))
        of_part = F.struct(F.element_at(firsts, at).alias("place"), F.element_at(many, at).alias("parts"))
        of_slot = F.when(F.element_at(_constants(places), number) < 0, of_part).otherwise(of_slot)
    partition = of_slot["place"] + F.pmod(F.col("id"), of_slot["parts"])
    return logs.repartitionById(total, partition.cast("int"))
