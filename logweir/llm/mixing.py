"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents are dealt out to shards by a hash of their id and put in
a seeded order inside each shard. The words of a shard, read twice in a row,
form a stream that is cut into blocks of equal size. Blocks are apportioned to
the sources by highest quotients ``target / (2 k + 1)``, then to the shards of
each source in the same way, and a shard gives its first blocks in the seeded
order. So a shard's second round begins only after the first is complete, and
only the document at the end of a quota is taken in part.

Blocks are counted, never stored. There are as many shards as documents per
shard, about the square root of all documents: prefix sums run inside a shard,
and the quotas of a source's shards are ranked in one window, so that neither
ever holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import WORD, Scratch, free_name, hex_bits, quoted

WEIGHTS = (5, 2, 1)
#: Size of the mix against the size of the input.
SHARE = 1.5
#: How often a source may be repeated.
REPEATS = 2
BLOCK_WORDS = 16
SEED = "mix"


def source_targets(sizes: DataFrame) -> DataFrame:
    """Add ``target`` (double) to one row per source with ``source, source_size``.

    Sources by code point, null last, weigh ``WEIGHTS`` in turn and share
    ``SHARE`` of all words; a target stops at ``REPEATS`` times its source's
    size and the excess is shared again by weight. Sources reach their cap in
    the order of cap per weight, so the fixed point is found from prefix sums:
    the level is that of the first prefix of capped sources beyond which no
    source is above its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    weighed = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(REPEATS)))
    ratio = F.col("cap") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = weighed.withColumn("ratio", ratio).withColumn("level", level)
    stop = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    target = F.when(stop.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * stop))
    return leveled.select(*sizes.columns, target.alias("target"))


def apportion(parties: DataFrame, group: list[str], share: str, seats: str, cap: str, order: list[Column]) -> DataFrame:
    """Add ``quota``: the ``seats`` of each group, given out by highest quotients ``share / (2 k + 1)``.

    ``seats`` is the same in all rows of a group; ``cap`` bounds a party's quota.
    A party's quota is within ``n * share / (2 * total) + 1`` of its exact
    part, ``n`` being the number of parties, so only the quotients in that range
    are ranked: about five per party whatever the number of seats. Ties go by
    ``order``.
    """
    of_group = Window.partitionBy(*group)
    weight = F.col(share).cast("double")
    total = F.sum(weight).over(of_group)
    exact = F.when(total > 0, weight * F.col(seats) / total).otherwise(0.0)
    slack = F.when(total > 0, weight / total * F.count("*").over(of_group) / 2).otherwise(0.0) + 1
    lowest = F.least(F.greatest(F.floor(exact - slack), F.lit(0)), F.col(cap))
    ranged = parties.withColumn("lowest", lowest).withColumn("highest", F.least(F.ceil(exact + slack), F.col(cap)))
    ranged = ranged.withColumn("left_over", F.col(seats) - F.sum("lowest").over(of_group))
    # Candidate k is the seat after k others; the last one in the range stands for none and is never given.
    steps = F.explode(F.sequence("lowest", F.greatest("lowest", "highest")))
    quotients = ranged.withColumn("k", steps).withColumn("quotient", weight / (2 * F.col("k") + 1))
    by_quotient = Window.partitionBy(*group).orderBy(F.desc("quotient"), *order, "k")
    real = (F.col("k") < F.col("highest")) & (weight > 0)
    ranked = quotients.withColumn("quotient", F.when(real, F.col("quotient")).otherwise(-1.0)).withColumn("rank", F.row_number().over(by_quotient))
    won = F.sum((real & (F.col("rank") <= F.col("left_over"))).cast("long"))
    keys = parties.columns
    return ranked.groupBy(*keys, "lowest").agg(won.alias("won")).select(*keys, (F.col("lowest") + F.col("won")).alias("quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``size`` counts words, 0 for null or blank text. ``taken`` is the number of words
    the mix takes of the row, repeats counted: at most twice its size, first
    words first. Null is a source of its own, the last one. The order inside a
    shard is by a seeded hash of the id, then id, source text digest; rows alike
    in all of these share one place, which of them comes first changes nothing.
    A sum of ``taken`` differs from the target by less than one block per shard.
    An empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized, quotas = _quotas(narrow, block_words)
    return _taken(sized, quotas, block_words).select("doc_id", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("size", size).withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))


def _quotas(docs: DataFrame, block_words: int, by_source: bool = False) -> tuple[DataFrame, DataFrame]:
    """The narrow rows with their shards, and one row per source and shard with its quota of blocks.

    The number of shards is the root of the number of all documents, or with
    ``by_source`` of those of the source.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(_sized(docs).select("doc_id", "source", "size", "text_md5"), "sized")
    place = hex_bits(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    if by_source:
        counts = sized.groupBy(F.col("source").alias("of_source")).agg(F.floor(F.sqrt(F.count("*"))).alias("n_shards"))
        sized = sized.join(counts, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    else:
        sized = sized.withColumn("n_shards", F.lit(max(1, math.isqrt(sized.count()))))
    sized = sized.withColumn("place", place).withColumn("shard", F.pmod("place", "n_shards")).drop("n_shards")

    shards = scratch.keep(sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    sources = source_targets(shards.groupBy("source").agg(F.sum("shard_size").alias("source_size")))
    sources = sources.withColumn("all", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    sources = sources.withColumn("most", F.ceil(F.col("source_size") * REPEATS / block_words))
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    sources = apportion(sources, [], "target", "all", "most", by_name).withColumnRenamed("quota", "blocks").drop("all", "most")
    sources = sources.withColumnRenamed("source", "its_source")

    shards = shards.join(sources, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    shards = shards.withColumn("most", F.ceil(F.col("shard_size") * REPEATS / block_words))
    quotas = apportion(shards, ["source"], "shard_size", "blocks", "most", [F.col("shard")])
    return sized, scratch.keep(quotas, "quotas")


def _taken(sized: DataFrame, quotas: DataFrame, block_words: int) -> DataFrame:
    in_shard = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "text_md5")
    ends = sized.withColumn("end", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    quota = quotas.select(F.col("source").alias("its_source"), F.col("shard").alias("its_shard"), "shard_size", "source_size", "target", "quota")
    same = F.col("source").eqNullSafe(F.col("its_source")) & (F.col("shard") == F.col("its_shard"))
    words = F.col("quota") * block_words
    taken = F.lit(0).cast("long")
    for turn in range(REPEATS):
        begin = F.col("end") - F.col("size") + F.col("shard_size") * turn
        taken = taken + F.least(F.greatest(words - begin, F.lit(0)), F.col("size"))
    return ends.join(quota, same).withColumn("taken", taken)


def _whole(taken: DataFrame) -> DataFrame:
    """``taken`` with the partial document of each quota rounded to a whole copy or none.

    A source's partial documents, one per shard, stand in a seeded order. Those
    whose middle lies before the sum of all partial words are taken whole: a prefix
    sum, by which the source's words differ from the mix's by half its largest
    such document at most. The window of a source has a row for each shard.
    """
    rows = Scratch(taken.sparkSession).keep(taken.select("doc_id", "source", "shard", "size", "text_md5", "taken").where("taken > 0"), "taken")
    rest = F.col("taken") % F.col("size")
    of_source = Window.partitionBy("source")
    place = F.md5(F.concat(F.lit(SEED), F.col("shard").cast("string")))
    ends = rows.where(rest > 0).select("source", "shard", "size", rest.alias("rest"))
    reach = F.sum("size").over(of_source.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumns({"reach": reach, "wanted": F.sum("rest").over(of_source)})
    ups = ends.where(2 * F.col("reach") - F.col("size") < 2 * F.col("wanted"))
    ups = ups.select(F.col("source").alias("its_source"), F.col("shard").alias("its_shard"))
    same = F.col("source").eqNullSafe(F.col("its_source")) & (F.col("shard") == F.col("its_shard"))
    more = F.when((rest > 0) & F.col("its_shard").isNotNull(), F.col("size")).otherwise(F.lit(0).cast("long"))
    return rows.join(ups, same, "left").withColumn("taken", F.col("taken") - rest + more)


def _row_key(doc_id: Column, text_md5: Column, source: Column) -> Column:
    """What the mix knows a row by."""
    return F.concat(text_md5, F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("|"), source), F.lit("")))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, whole: bool = False) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them, all columns as they are.

    A document taken in part comes with its first words, white space as it was,
    and ``n_chars`` to match if there is such a column. With ``whole`` no text is
    cut: such a document comes as a whole copy more or not, see :func:`_whole`,
    and a source has as many shards as the root of its own documents. Documents
    that the mix takes no word of are left out. Texts move once, to their counts.
    Only if rows repeat id, source and text are these numbered, in a window over
    the rows alike, which are alike to the mix.
    """
    key, row, taken, size, part = (free_name(name, docs.columns) for name in ("key", "row", "taken", "size", "part"))
    counts = _taken(*_quotas(docs.select("doc_id", "source", "text"), block_words, by_source=whole), block_words)
    counts = _whole(counts) if whole else counts
    counts = counts.where("taken > 0").select(
        _row_key(F.col("doc_id"), F.col("text_md5"), F.col("source")).alias(key), F.col("taken").alias(taken), F.col("size").alias(size)
    )
    counts = Scratch(docs.sparkSession).keep(counts, "counts")
    rows = docs.withColumn(key, _row_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))), F.col("source")))
    on = [key]
    if not counts.groupBy(key).count().where("count > 1").isEmpty():
        alike, on = Window.partitionBy(key), [key, row]
        counts = counts.withColumn(row, F.row_number().over(alike.orderBy(F.desc(taken))))
        rows = rows.withColumn(row, F.row_number().over(alike.orderBy(key)))
    found = rows.join(counts, on)
    rest = F.col(taken) % F.col(size)
    copies = F.array_repeat(F.lit(None).cast("long"), F.floor(F.col(taken) / F.col(size)).cast("int"))
    found = found.withColumn(part, F.explode(F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)))
    if not whole:
        words = F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col(part).cast("int"))
        found = found.withColumn("text", F.when(F.col(part).isNull(), F.col("text")).otherwise(F.array_join(words, "")))
        if "n_chars" in docs.columns:
            found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*map(quoted, docs.columns))
