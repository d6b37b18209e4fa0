"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A section ends at a blank line, a paragraph at a line break. A piece ends at
the end of a sentence or, in a longer stretch, at a place that its content
decides (white space, punctuation or one of some frequent letters), so an inserted character
moves the ends next to it and no others.

A piece's digest is taken over its text, that of a paragraph, a section and the root
over the digests below. So every branch can be checked against the one above
it, equal roots mean equal texts, and what differs is found from the root down.

A fingerprint is text: ``root:n/section=paragraph=piece,piece;paragraph=...|section=...``
with 64 hex digits of SHA-256 for the root, 16 of MD5 for all below, and ``n``, the number
of different pieces. It grows with its text, about a third of its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import union_all

#: Characters up to which a sentence is one piece, and of a piece in a longer stretch at least.
PIECE, SHORTEST = 80, 24
_ENDS = r".!?\n\u2026\u3002\uFF01\uFF1F\uFF0E\u061F\u0964"
# Frequent letters of several scripts, and an eighth to a quarter of the large ones.
_PLACES = (
    r"\s\p{P}aeiouAEIOU0-2\u00E0-\u00EF\u0430\u0435\u0438\u043E\u03B1\u03B5\u03B9\u03BF\u05D5\u05D9\u0627\u0644\u093E\u0947\u0E19\u0E23\u0E32"
    r"\u306E\u306B\u306F\u3092\u3067\u3068\u304C\u308B\u305F\u30FC\u30F3\u30B9\u30EB"
    + "".join(rf"\u{code:04X}-\u{code + 0x3F:04X}" for code in [*range(0x3400, 0xA000, 0x100), *range(0xAC00, 0xD700, 0x100)])
)
SECTIONS = r"(?s).+?(?:\n[ \t\r]*\n\s*|\z)"
PARAGRAPHS = r"[^\n]*\n+|[^\n]+"


def _pieces_pattern(ends: str, places: str) -> str:
    return rf"[^{ends}]{{0,{PIECE}}}+[{ends}]++|[^{ends}]{{{SHORTEST},{PIECE - 1}}}?[{places}]|[^{ends}]{{1,{PIECE}}}"


PIECES = _pieces_pattern(_ENDS, _PLACES)
#: The same for text of code points below 256, where it is several times as fast.
LATIN_PIECES = _pieces_pattern(r".!?\n", r"\s\p{P}aeiouAEIOU0-2\u00E0-\u00EF")
NOT_LATIN = r"[^\x00-\xFF]"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digest(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def _above(below: Column) -> Column:
    """The digest over those of the branches ``below``."""
    return _digest(F.array_join(F.transform(below, lambda branch: F.substring_index(branch, "=", 1)), ","))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _paragraph(text: Column) -> Column:
    cut = F.when(text.rlike(NOT_LATIN), _all(text, PIECES)).otherwise(_all(text, LATIN_PIECES))
    pieces = F.array_join(F.transform(cut, _digest), ",")
    return _once(pieces, lambda joined: F.concat(_digest(joined), F.lit("="), joined))


def _section(text: Column) -> Column:
    return _once(F.transform(_all(text, PARAGRAPHS), _paragraph), lambda found: F.concat(_above(found), F.lit("="), F.array_join(found, ";")))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    sections = F.transform(_all(F.coalesce(text, F.lit("")), SECTIONS), _section)

    def whole(found: Column) -> Column:
        below = F.array_join(F.transform(found, lambda section: F.substring_index(section, "=", 1)), "|")
        body = F.array_join(found, "|")
        n = F.size(F.array_distinct(_pieces_of(found)))
        return F.concat(F.sha2(below, 256), F.lit(":"), n.cast("string"), F.lit("/"), body)

    return _once(sections, whole)


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def _count(fingerprint: Column) -> Column:
    return F.substring_index(F.substring(fingerprint, 66, 12), "/", 1).cast("int")


def _sections(fingerprint: Column) -> Column:
    body = F.substring(fingerprint, F.instr(fingerprint, "/") + 1, F.lit(2**31 - 1))
    return F.array_remove(F.split(body, r"\|"), "")


def _below(branches: Column, separator: str) -> Column:
    """The branches below all of ``branches``."""
    return F.flatten(F.transform(branches, lambda branch: F.split(F.substring(branch, 18, 2**31 - 1), separator)))


def _pieces_of(sections: Column) -> Column:
    return _below(_below(sections, ";"), ",")


def _opened(separator: str) -> Callable[[Column], Column]:
    return lambda sides: F.struct(_below(sides["a"], separator).alias("a"), _below(sides["b"], separator).alias("b"))


def likeness(one: Column, other: Column) -> Column:
    """Share of the pieces of two fingerprints that lie in no differing branch, each counted once per text.

    Descends from the root: only sections that the other text does not have are
    opened, of these only paragraphs that its differing sections do not have, and
    so on; the numbers of pieces are those at the roots. 1 for equal texts, below 1 for all others, 0 if
    no piece is found again.
    """
    def only(sides: Column) -> Column:
        """The branches of each side that the other has not."""
        a, b = sides["a"], sides["b"]
        return F.struct(F.array_except(a, b).alias("a"), F.array_except(b, a).alias("b"))

    sides = _once(F.struct(_sections(one).alias("a"), _sections(other).alias("b")), only)
    for separator in (";", ","):
        sides = _once(_once(sides, _opened(separator)), only)
    differing = _once(sides, lambda found: F.size(found["a"]) + F.size(found["b"]))
    both = _count(one) + _count(other)
    shared = F.when(both > 0, 1.0 - differing / both).otherwise(0.0)
    return F.when(root(one) == root(other), 1.0).otherwise(F.least(shared, F.lit(0.999999)))


def changed_paragraphs(one: Column, other: Column) -> Column:
    """Where ``other`` differs: positions ``section.paragraph`` (from 0) of its paragraphs that ``one`` does not have.

    Descends only into sections whose digest is new.
    """
    digest = lambda branch: F.substring_index(branch, "=", 1)
    paragraphs = lambda section: F.split(F.substring(section, 18, 2**31 - 1), ";")
    known_sections = F.transform(_sections(one), digest)
    known = F.transform(F.flatten(F.transform(_sections(one), paragraphs)), digest)

    def places(section: Column, i: Column) -> Column:
        found = F.transform(
            paragraphs(section),
            lambda p, j: F.when(~F.array_contains(known, digest(p)), F.concat_ws(".", i.cast("string"), j.cast("string"))),
        )
        return F.when(F.array_contains(known_sections, digest(section)), F.array().cast("array<string>")).otherwise(F.array_compact(found))

    return F.flatten(F.transform(_sections(other), places))


def _placed(rows: DataFrame, n_ranges: int) -> DataFrame:
    """``rows`` with ``range`` and ``tie``: by descending range, descending id and ascending tie they are in order."""
    steps = [i / n_ranges for i in range(1, n_ranges)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", steps, 100 * n_ranges).alias("bounds"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    bounds = found.bounds or []
    # How many ranges one id, or null, is cut into.
    parts = {i: bounds.count(i) for i in set(bounds) if bounds.count(i) > 1}
    parts_of_null = max(1, round(n_ranges * (found.n - found.ids) / max(1, found.n)))
    n_parts = F.when(F.col("doc_id").isNull(), parts_of_null)
    for i, k in parts.items():
        n_parts = n_parts.when(F.col("doc_id") == i, k)
    bounds = F.array(*[F.lit(b) for b in sorted(set(bounds) | {i + 1 for i in parts if i < 2**63 - 1})]).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    tie = F.xxhash64("text")
    # Ranges go down, the hash goes up.
    part = F.floor((0.5 - tie / F.lit(2.0**64)) * n_parts.otherwise(1)).cast("int")
    range_ = place * (n_ranges + 1) + F.least(F.greatest(part, F.lit(0)), F.lit(n_ranges))
    return rows.withColumn("range", range_).withColumn("tie", tie)


def with_next(rows: DataFrame, columns: list[str], add: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Add ``next_<column>`` of the row that follows by descending ``doc_id``; after the last comes the first.

    ``rows`` has ``doc_id`` and ``text``. Null ids come last; rows of one id go by a
    hash of their text. Ids are cut into ranges of about equal size, as many as
    shuffle partitions; an id that fills several ranges, or null, is cut by the hash.
    A range is sorted by one task, together with the first
    row of the range after it, so rows move once and no task sees all of them.
    Rows alike in id and text stay together. ``add`` adds columns to the rows once each knows its
    range, so that finding the first rows of ranges does not compute them.
    """
    placed = _placed(rows, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    # One row per range from here to the join: at most as many as shuffle partitions, plus one.
    first = placed.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("first"))
    down = Window.orderBy(F.desc("range"))
    before = F.coalesce(F.lag("range").over(down), F.min("range").over(Window.partitionBy()))
    first = first.select(before.alias("before"), "first", F.col("range").alias("first_range"))
    same = (F.col("range") == F.col("first_range")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    same = same & (F.col("tie") == F.bitwise_not("first.tie"))
    heads = placed.join(F.broadcast(first), same).dropDuplicates(["range"])
    heads = heads.withColumn("range", F.col("before")).drop("before", "first", "first_range").withColumn("is_head", F.lit(True))

    every = add(union_all([placed.withColumn("is_head", F.lit(False)), heads]))
    order = Window.partitionBy("range").orderBy("is_head", F.desc_nulls_last("doc_id"), "tie")
    for name in columns:
        every = every.withColumn(f"next_{name}", F.lead(name).over(order))
    return every.where(~F.col("is_head")).drop("range", "tie", "is_head")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row of ``docs``, and of its edited text.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the document that follows by descending id; a
    single document is followed by itself. Null text counts as empty.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "fingerprint"], lambda every: every.withColumn("fingerprint", fingerprint(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
