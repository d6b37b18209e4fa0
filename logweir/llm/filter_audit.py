"""How filters interact: what each removes, step by step, under every order of application.

Each document has a mask, one bit for each filter that it fails. Documents are
counted in cells ``(part, mask)``, at most ``2 ** filters`` per part, and all
that follows works on cells. A recursive CTE starts from the empty prefix of
each part and extends every prefix by each unused letter: it joins the part's
cells, carries the bits applied so far, and the rows of a recursion level are the
metrics of that step. There are ``5 + 20 + 60 + 120 + 120`` prefixes of five letters;
an order's five steps are its five prefixes.

Whether a text has a copy with a smaller id is the only thing that needs other
documents. The smallest id of a text is found by an aggregation that combines
before its shuffle, and a row is then compared with it under the key
``(digest, id)``, which spreads a group of any number of copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import Scratch, union_all, words_of

LETTERS = "ABCDE"
#: The filter that needs other documents; the others look at one text.
COPY = "E"
MIN_WORDS = 200
#: Distinct words in 100 words, at least.
MIN_DISTINCT = 50
#: Capital letters in 100 code points, at most.
MOST_CAPITALS = 2
SIGNS = "[#$%&*|]"
#: Prefixes grow with the factorial of the letters.
MOST_LETTERS = 7
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_failures(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with ``mask``, the bits of A to D that the text fails, and ``digest``; the text itself goes."""
    content = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("content", content).withColumn("words", words_of(F.col("content"))).drop("text")
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("content") - F.length(F.regexp_replace("content", "[A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length("content"), F.col("content").rlike(SIGNS)]
    mask = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    return rows.select("*", mask.alias("mask"), F.unhex(F.sha2("content", 256)).alias("digest")).drop("content", "words")


def mark_copies(rows: DataFrame) -> DataFrame:
    """Rows ``doc_id, part, mask, digest, n`` with the bit of ``COPY`` set where a smaller id has the same digest.

    A row without id has no smaller one, and is none.
    """
    bit = 1 << LETTERS.index(COPY)
    with_id = rows.where("doc_id is not null")
    first = with_id.groupBy(F.col("digest").alias("of_digest")).agg(F.min("doc_id").alias("first_id"))
    same = (F.col("digest") == F.col("of_digest")) & (F.col("doc_id") == F.col("first_id"))
    mask = F.col("mask").bitwiseOR(F.when(F.col("first_id").isNull(), bit).otherwise(0))
    marked = with_id.join(first, same, "left").select("doc_id", "part", mask.alias("mask"), "n")
    return union_all([marked, rows.where("doc_id is null").select(*marked.columns)])


def filter_cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask`` with the numbers ``n``, ``good`` (quality 1) and ``toxic`` (toxic 1) of documents.

    A document is good or toxic if any row of ``labels`` with its id says so.
    """
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("is_good"), F.max((F.col("toxic") == 1).cast("long")).alias("is_toxic")
    )
    without = rows.where("doc_id is null").withColumns({"is_good": F.lit(None).cast("long"), "is_toxic": F.lit(None).cast("long")})
    found = rows.where("doc_id is not null").join(flags, F.col("doc_id") == F.col("labelled"), "left").select(*without.columns)
    counted = [F.coalesce(F.sum(F.col("n") * F.col(flag)), F.lit(0)).alias(name) for flag, name in (("is_good", "good"), ("is_toxic", "toxic"))]
    return union_all([found, without]).groupBy("part", "mask").agg(F.sum("n").alias("n"), *counted)


def _recursion(letters: str) -> str:
    """The recursive CTE over a view ``{cells}`` with one row per part: ``part, cells``."""
    unused = ", ".join(f"named_struct('letter', '{letter}', 'bit', {1 << k})" for k, letter in enumerate(letters))

    def total(name: str, condition: str) -> str:
        return f"aggregate(filter(c.cells, x -> {condition}), 0L, (a, x) -> a + x.{name})"

    passed, fails = "(x.mask & p.applied) = 0", "(x.mask & l.bit) <> 0"
    return f"""
    WITH RECURSIVE prefixes(part, prefix, step, letter, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
        SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
        UNION ALL
        SELECT p.part, concat(p.prefix, l.letter), p.step + 1, l.letter, p.applied | l.bit,
            {total("n", "(x.mask & (p.applied | l.bit)) = 0")},
            {total("n", f"{passed} AND {fails}")},
            {total("n", f"NOT ({passed}) AND {fails}")},
            {total("n", "x.mask = l.bit")},
            {total("good", f"{passed} AND {fails}")},
            {total("toxic", f"{passed} AND {fails}")}
        FROM prefixes p JOIN {{cells}} c ON p.part = c.part
            LATERAL VIEW inline(filter(array({unused}), x -> (p.applied & x.bit) = 0)) l AS letter, bit
    )
    SELECT * FROM prefixes WHERE step > 0"""


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, ``filter_order`` and ``step`` of the cells ``part, mask, n, good, toxic``.

    Bit ``k`` of a mask stands for the ``k``-th of ``letters``. Columns: ``part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. A part is one of the cells'; no cells give no rows.
    """
    if not 0 < len(letters) <= MOST_LETTERS or len(set(letters)) < len(letters) or not letters.isalpha():
        raise ValueError(f"filters must be 1 to {MOST_LETTERS} different letters")
    spark = cells.sparkSession
    scratch = Scratch(spark)
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    packed = scratch.keep(packed, "cells")
    limit = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")  # rows grow with the parts, a few hundred for each
    try:
        prefixes = scratch.keep(spark.sql(_recursion(letters), cells=packed), "prefixes")
    finally:
        spark.conf.set(_ROW_LIMIT, limit)
    # A prefix of k letters begins (letters - k)! orders.
    orders_of = F.element_at(F.array(*[F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    shapley = prefixes.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = prefixes.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
    steps = steps.withColumn("prefix", F.substring(F.col("filter_order"), F.lit(1), F.col("at")))
    return steps.join(prefixes, ["part", "prefix"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The interaction of the five filters over ``docs``; columns as of :func:`interactions`.

    A part is a value of ``source``, null and empty text being one. Null text
    is empty. Repeated rows are documents of their own; those that share an id and
    a text are no copies of each other. A row without id is in no other's way:
    it fails ``E`` never and has no labels. Labels without id, or of ids that
    ``docs`` lacks, count nowhere. An empty table gives no rows, other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    part: Column = F.coalesce(F.col(source), F.lit(""))
    rows = text_failures(docs.select(F.col(doc_id).alias("doc_id"), part.alias("part"), F.col(text).alias("text")))
    rows = scratch.keep(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "masks")
    cells = scratch.keep(filter_cells(mark_copies(rows), labels), "cells")
    scratch.drop("masks")
    return interactions(cells)
