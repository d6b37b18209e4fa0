"""Raw ingestion requests: one JSON body ``{"logs": [...]}`` per row.

Every operator here takes a DataFrame ``(request_seq LONG, body STRING)``.
``request_seq`` orders the requests and is part of the input (an ingest key, a
queue offset); :func:`number_lines` makes one for plain text files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir import schema
from logweir.session import compute_once

NOT_A_BATCH = "request body must be an object with a logs array"
TOO_LARGE = f"logs batch exceeds maximum of {schema.MAX_LOGS_PER_BATCH}"
EMPTY_BATCH = "logs must contain at least one entry"

#: The syntax that the parser checks, without its limits.
UNLIMITED = {
    "maxNestingDepth": str(2**31 - 1), "maxNumLen": str(2**31 - 1), "maxStringLen": str(2**31 - 1),
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
}
#: Of the parser: levels of a value, characters of a number.
LEVELS, DIGITS = 1_000, 1_000
# Parts of a JSON text. All quantifiers are possessive: no part is read twice, whatever follows.
_STRING = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'
_NUMBER = r"-?+[0-9][-+0-9.eE]"
_LONG = f"{_NUMBER}{{{DIGITS},}}+"
_FLAT = rf'(?:[^"\[\]{{}}0-9-]++|{_STRING}|{_NUMBER}{{0,{DIGITS - 1}}}+(?![-+0-9.eE]))*+'
_CHUNK = rf"(?:[^\"\[\]{{}}0-9-]++|{_STRING}|{_NUMBER}{{0,{DIGITS - 1}}}+(?![-+0-9.eE])|\[{_FLAT}\]|\{{{_FLAT}\}})++"
#: Pieces of a JSON text: what is between brackets, with flat arrays and objects; a run of opening or of closing brackets; a long number.
PIECES = rf"{_CHUNK}|[\[{{]++|[\]}}]++|{_LONG}"
#: Pieces that are gone through with one list of cuts.
BLOCK = 256

# A text line and the file split it comes from.
LINE_COLUMNS = (
    "value AS body",
    "_metadata.file_modification_time AS file_time",
    "_metadata.file_path AS file",
    "_metadata.file_block_start AS block",
)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests stored as Parquet with an ordering key."""
    return spark.read.schema(schema.REQUEST).parquet(path)


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files with one request body per line, numbered in file order."""
    return number_lines(place_lines(spark.read.text(path).selectExpr(*LINE_COLUMNS)))


def place_lines(lines: DataFrame) -> DataFrame:
    """Add ``place``, which tells lines apart and orders those of one file split."""
    return lines.withColumn("place", F.monotonically_increasing_id())


def number_lines(placed: DataFrame) -> DataFrame:
    """Replace the place columns by ``request_seq``: the order of file time, file name and line.

    Works on placed lines and on anything derived from them that has at least
    one row per line. Places are consecutive in a split, so their ends give the
    size of the split and no line is moved. The one window runs over the splits,
    a list no longer than the one Spark's scan planning keeps on the driver.
    """
    split = ("file_time", "file", "block")
    splits = placed.groupBy(*split).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "file",
        "block",
        "first",
        F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(before), F.lit(0)).alias("start"),
    )
    numbered = placed.join(starts, ["file", "block"])
    return numbered.withColumn("request_seq", F.col("start") + F.col("place") - F.col("first")).drop(
        *split, "place", "start", "first"
    )


def _is_json(text: Column, mark: str) -> Column:
    """Whether a text is one JSON value by its syntax, of any depth and with numbers of any length."""
    framed = F.concat(F.lit('{"value":'), text, F.lit(f',"mark":"{mark}"}}'))
    return F.coalesce(F.from_json(framed, "mark string", UNLIMITED)["mark"] == mark, F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marks(pieces: Column) -> Column:
    """The pieces that count: ``(at, by, alone)`` with the change of depth by a run of brackets, or a long number alone."""
    def mark(piece: Column, at: Column) -> Column:
        begin, size = F.substring(piece, 1, 1), F.length(piece)
        opens = F.contains(F.lit("[{"), F.substring(piece, -1, 1))
        by = F.when(F.contains(F.lit("]}"), begin), -size).when(opens, size).otherwise(0)
        alone = (size >= DIGITS) & F.contains(F.lit("-0123456789"), begin) & piece.rlike(rf"\A{_LONG}\z")
        return F.struct(at.alias("at"), by.alias("by"), alone.alias("alone"))

    return F.filter(F.transform(pieces, mark), lambda mark: (mark["by"] != 0) | mark["alone"])


def _cuts(marks: Column) -> Column:
    """What goes into strings: pieces ``first`` to ``last``, of the first one its last ``begin`` characters (NULL: all), of the last one all but ``rest``.

    An aggregation copies its state for each element, so the list of cuts begins anew in each block of marks.
    """
    cuts_type = "array<struct<first:int,begin:int,last:int,rest:int>>"
    none, no_lists = F.array().cast(cuts_type), F.array().cast(f"array<{cuts_type}>")

    def step(state: Column, mark: Column) -> Column:
        was, depth = state["place"], state["place"]["depth"] + mark["by"]
        # A run of brackets may pass the entries' level on its way.
        entry_begins, entry_ends = (was["depth"] < 3) & (depth >= 3), (was["depth"] >= 3) & (depth < 3)
        alone, ends = mark["alone"] & (was["depth"] < 3), entry_ends & was["beyond"]
        cut = F.struct(
            F.when(alone, mark["at"]).otherwise(was["first"]).alias("first"), F.when(~alone, was["begin"]).alias("begin"),
            mark["at"].alias("last"), F.when(alone, 0).otherwise(2 - depth).alias("rest"),
        )
        place = F.struct(
            depth.alias("depth"),
            ((depth >= LEVELS) | ~entry_begins & (was["beyond"] | mark["alone"])).alias("beyond"),
            F.when(entry_begins, mark["at"]).otherwise(was["first"]).alias("first"),
            F.when(entry_begins, depth - 2).otherwise(was["begin"]).alias("begin"),
        )
        return F.struct(place.alias("place"), F.when(alone | ends, F.concat(state["cuts"], F.array(cut))).otherwise(state["cuts"]).alias("cuts"))

    def block_step(state: Column, number: Column) -> Column:
        block = F.slice(marks, number * BLOCK + 1, BLOCK)
        stepped = F.aggregate(block, F.struct(state["place"].alias("place"), none.alias("cuts")), step)
        lists = lambda after: F.concat(state["lists"], F.array(after["cuts"])).alias("lists")
        return _let(stepped, lambda after: F.struct(after["place"].alias("place"), lists(after)))

    place = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("beyond"), F.lit(0).alias("first"), F.lit(0).alias("begin"))
    numbers = F.sequence(F.lit(0), F.floor(F.size(marks) / BLOCK).cast("int"))
    return F.flatten(F.aggregate(numbers, F.struct(place.alias("place"), no_lists.alias("lists")), block_step)["lists"])


def tamed(body: Column, mark: str) -> Column:
    """``body`` with what is beyond the parser's limits put into strings that begin with ``mark``.

    ``body`` is JSON by its syntax. An entry, which is a value on the third
    level, goes as a whole if it holds a long number or too many levels, with
    its text as it was sent; a long number above that level goes alone. One pass
    over runs of brackets and long numbers notes the first and last piece of each.
    """

    def joined(pieces: Column, first: Column, last: Column) -> Column:
        return F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")

    def behind(pieces: Column, cut: Column, last: Column) -> Column:
        """What follows a cut (NULL: the start), up to a piece."""
        rest = F.coalesce(F.right(F.get(pieces, cut["last"]), cut["rest"]), F.lit(""))
        return F.concat(rest, joined(pieces, F.coalesce(cut["last"] + 1, F.lit(0)), last))

    def replaced(pieces: Column, cuts: Column) -> Column:
        def one(cut: Column, k: Column) -> Column:
            first = F.get(pieces, cut["first"])
            begin = F.coalesce(cut["begin"], F.length(first))
            text = F.concat(F.right(first, begin), joined(pieces, cut["first"] + 1, cut["last"]))
            text = F.left(text, F.length(text) - cut["rest"])
            for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                text = F.replace(text, F.lit(plain), F.lit(written))
            before = behind(pieces, F.get(cuts, k - 1), cut["first"] - 1)
            return F.concat(before, F.left(first, F.length(first) - begin), F.lit(f'"{mark}'), text, F.lit('"'))

        rest = behind(pieces, F.get(cuts, F.size(cuts) - 1), F.size(pieces) - 1)
        return F.concat(F.array_join(F.transform(cuts, one), ""), rest)

    found = F.regexp_extract_all(body, F.lit(PIECES), F.lit(0))
    return _let(found, lambda pieces: _let(_let(_marks(pieces), _cuts), lambda cuts: replaced(pieces, cuts)))


def _framed(body: Column, mark: str) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit(f',"{mark}"]')))


def _entry_or_text(entry: Column, mark: str) -> Column:
    """The entry; one that was put into a string is parsed alone, or if the parser refuses it its text as a binary value, which no JSON gives."""
    text = F.try_variant_get(entry, "$", "string")
    text = F.when((F.schema_of_variant(entry) == "STRING") & text.startswith(mark), F.substr(text, F.lit(len(mark) + 1)))
    parsed = F.from_json(F.concat(F.lit('{"entry":'), text, F.lit("}")), "entry variant")["entry"]
    return F.when(text.isNull(), entry).otherwise(F.coalesce(parsed, text.cast("binary").cast("variant")))


def parse_requests(requests: DataFrame) -> DataFrame:
    """Replace ``body`` by ``entries ARRAY<VARIANT>`` (NULL when it is no batch), ``n_entries`` and ``error``.

    The parser stops behind the first value, so the body is parsed as the first
    of two array elements. Only if the second one, a mark that no body knows, is
    where it belongs was there nothing else in the body.

    The parser has limits (1,000 digits, 1,000 levels). Only a body that it
    refuses although its syntax is right is parsed again with the entries beyond
    them put into strings; one that is refused alone, too, stays as a
    binary value with its text, a reject of its own. All of that takes a time in
    proportion to the body's length.
    """
    mark = uuid.uuid4().hex
    others = [name for name in requests.columns if name != "body"]
    once = requests.select("*", compute_once(framed=_framed(F.col("body"), mark)))
    # A parse that succeeded is not looked at again; the body goes no further.
    again = F.when(F.col("framed").isNull() & F.col("body").isNotNull() & _is_json(F.col("body"), mark), _framed(tamed(F.col("body"), mark), mark))
    framed = once.select(*others, compute_once(framed=F.coalesce("framed", again), is_tamed=F.col("framed").isNull()))
    alone = F.try_variant_get("framed", "$[1]", "string") == mark
    entries = F.when(alone, F.try_variant_get("framed", "$[0].logs", "array<variant>"))

    def restored(found: Column) -> Column:
        too_many = F.size(found) > schema.MAX_LOGS_PER_BATCH
        return F.when(too_many, found).otherwise(F.transform(found, lambda entry: _entry_or_text(entry, mark)))

    entries = F.when(F.col("is_tamed"), F.get(F.transform(F.array(entries), restored), F.lit(0))).otherwise(entries)
    parsed = framed.select(*others, compute_once(entries=entries))
    parsed = parsed.withColumn("n_entries", F.when(F.col("entries").isNotNull(), F.size("entries")))
    error = F.when(F.col("n_entries").isNull(), NOT_A_BATCH).when(
        F.col("n_entries") > schema.MAX_LOGS_PER_BATCH, TOO_LARGE
    )
    return parsed.withColumn("error", error)


def explode_requests(parsed: DataFrame) -> DataFrame:
    """One row per entry with its submitted index, and one without entry per refused or empty request.

    One pass then carries everything a report needs. (An inner explode would
    have the optimizer push a size filter below the parse, which repeats it.)
    """
    others = [name for name in parsed.columns if name != "entries"]
    entries = F.when(F.col("error").isNull(), F.col("entries"))
    return parsed.select(*others, F.posexplode_outer(entries).alias("entry_index", "entry"))


def explode_entries(parsed: DataFrame) -> DataFrame:
    """One row per entry of the requests that are not refused, with its submitted index."""
    exploded = explode_requests(parsed).where(F.col("entry_index").isNotNull())
    return exploded.select("request_seq", "entry_index", "entry")


def request_states(parsed: DataFrame) -> DataFrame:
    """``(request_seq, n_entries, error)``: the envelope result without the entries."""
    return parsed.select("request_seq", "n_entries", "error")
