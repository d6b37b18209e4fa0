"""Exact deduplication that survives any number of copies of one text.

Skew-safe combining in three steps, each of which compares whole texts and not
only digests:

1. every task combines the equal texts it has read (the partial aggregation);
2. groups ``(digest, salt, text)`` are merged. The salt spreads a digest with
   very many rows over all tasks and is constant for all other digests, which
   therefore are complete after this step and need no other shuffle;
3. the winners of the salts of frequent digests are combined.

A digest counts as frequent from one 1,000th of the rows on, so there are at
most 1,000 of them and they can be broadcast whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import Scratch, ascii_lower, free_name, mark_possible, quoted, union_all

#: A digest is frequent if it has one row in so many; there are at most as many frequent ones.
FREQUENT = 1_000
#: Rows of one digest that a task may hold in any case.
FEW = 1_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salts(rows: DataFrame, frequent: DataFrame, spread: Column, n_salts: int) -> DataFrame:
    """``rows`` with ``salt``: -1, or one of ``n_salts`` for frequent digests."""
    salt = F.when(F.col("is_frequent"), F.pmod(spread, F.lit(n_salts))).otherwise(-1)
    return rows.join(F.broadcast(frequent), "digest", "left").withColumn("salt", salt.cast("int")).drop("is_frequent")


def find_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """For every row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical after lower-casing A-Z; null counts as
    empty. Of equal texts the largest ``doc_id`` stays. A null ``doc_id`` stays
    only if its group has no other (then ``keep_id`` is null and ``kept`` true).
    Rows that repeat both id and text are all marked alike; each counts in
    ``group_size``. An empty table gives no rows, other columns are ignored.

    ``digest`` only speeds up the search: with a weak one the result is the
    same, since texts decide.
    """
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.col(text)).alias("content"))
    narrow = scratch.keep(
        whole.select("doc_id", digest(F.col("content")).alias("digest"), F.sha2("content", 256).alias("text_sha256")), "narrow"
    )

    rows = narrow.count()
    counts = narrow.groupBy("digest").agg(F.count("*").alias("n"))
    frequent = counts.where(F.col("n") > max(FEW, rows // FREQUENT)).select("digest", F.lit(True).alias("is_frequent"))
    frequent = scratch.keep(frequent.repartition(1), "frequent")
    n_salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("doc_id")

    salted = _salts(whole.withColumn("digest", digest(F.col("content"))), frequent, spread, n_salts)
    groups = salted.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Complete groups go on without their text.
    merged = scratch.keep(groups.withColumn("content", F.when(F.col("salt") >= 0, F.col("content"))), "merged")
    winners = scratch.keep(_combine_salts(merged).drop("content"), "winners")
    scratch.drop("merged")

    if winners.groupBy("digest").count().where("count > 1").isEmpty():
        # One text per digest, so the digest stands for the text.
        targets = _salted_targets(winners, frequent, n_salts)
        found = _salts(narrow, frequent, spread, n_salts).join(targets, ["digest", "salt"])
    else:
        targets = _salted_targets(_combine_salts(groups), frequent, n_salts)
        found = salted.withColumn("text_sha256", F.sha2("content", 256)).join(targets, ["digest", "salt", "content"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _combine_salts(groups: DataFrame) -> DataFrame:
    """One row per text: the groups without salt as they are, those with salts combined by text."""
    salts = groups.where("salt >= 0").groupBy("digest", "content")
    combined = salts.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return union_all([groups.where("salt < 0").drop("salt"), combined])


def _salted_targets(winners: DataFrame, frequent: DataFrame, n_salts: int) -> DataFrame:
    """``winners`` once per salt in use: ``n_salts`` times for the bounded number of frequent digests."""
    salts = F.when(F.col("is_frequent"), F.sequence(F.lit(0), F.lit(n_salts - 1))).otherwise(F.array(F.lit(-1)))
    marked = winners.join(F.broadcast(frequent), "digest", "left")
    return marked.withColumn("salt", F.explode(salts)).drop("is_frequent")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    The row with the largest id stays; of rows that repeat both id and text,
    one; of a group without any id, one. Whole rows move only if a bounded map
    of the ids with anything to drop marks them; the others go on as they were read.
    """
    scratch = Scratch(docs.sparkSession)
    key, stays, n, possible = (free_name(name, docs.columns) for name in ("key", "stays", "n", "possible"))

    def row_key(row_id: Column, digest: Column) -> Column:
        return F.concat(digest, F.coalesce(row_id.cast("string"), F.lit("-")))

    found = find_copies(docs, doc_id, text).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias(stays), F.count("*").alias(n))
    odd = found.where(~F.col(stays) | (F.col(n) > 1)).select("doc_id", row_key(F.col("doc_id"), F.col("text_sha256")).alias(key), stays)
    odd = scratch.keep(odd, "odd")
    own, content = F.col(quoted(doc_id)), F.col(quoted(text))
    columns = [quoted(name) for name in docs.columns]
    marked = mark_possible(docs, own, odd.select(F.col("doc_id").alias(key)), possible)
    some = marked.where(F.col(possible)).withColumn(key, row_key(own, F.sha2(ascii_lower(content), 256)))
    some = some.join(odd.drop("doc_id"), key, "left").where(F.coalesce(F.col(stays), F.lit(True)))
    if not odd.where(F.col(stays)).isEmpty():
        some = some.dropDuplicates([key])
    return marked.where(~F.col(possible)).select(*columns).unionAll(some.select(*columns))
