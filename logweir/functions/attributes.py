"""Attribute objects: checks, text form of values, key order.

``attributes`` is a VARIANT holding a flat JSON object. ``attributes_search``
is a MAP<STRING, STRING> with the same keys and every value as text.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SAFE_INTEGER = 2**53 - 1

def native_texts(attributes: Column) -> Column:
    """MAP<STRING, STRING> as Spark prints the values; NULL when ``attributes`` is no object."""
    return F.try_variant_get(attributes, "$", "map<string,string>")


def are_plain(attributes: Column, texts: Column) -> Column:
    """True when all values are acceptable and ``texts`` has them right: nearly always.

    Decided from the schema text and the joined values, without looping over the
    attributes. Keys and strings may look unusual too; that costs time, never
    correctness.
    """
    types = F.schema_of_variant(attributes)
    usual_types = ~(
        F.contains(types, F.lit("DOUBLE"))
        | F.contains(types, F.lit("VOID"))
        | F.contains(types, F.lit("ARRAY"))
        | F.contains(F.substring(types, F.lit(2), F.length(types)), F.lit("OBJECT"))
    )
    short_decimals = ~F.contains(types, F.lit("DECIMAL")) | ~types.rlike(r"DECIMAL\((1[6-9]|[2-9][0-9])")
    return usual_types & short_decimals & ~F.array_join(F.map_values(texts), " ").rlike(r"[0-9]{16}|0\.000000")


def attribute_entries(attribute_map: Column) -> Column:
    """ARRAY<STRUCT<key, value VARIANT, kind>> from MAP<STRING, VARIANT>; NULL stays NULL."""
    return F.transform(
        F.map_entries(attribute_map),
        lambda e: F.struct(
            e["key"].alias("key"),
            e["value"].alias("value"),
            F.schema_of_variant(e["value"]).alias("kind"),
        ),
    )


def _is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")


def _as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def is_scalar(kind: Column) -> Column:
    return (kind == "STRING") | (kind == "BOOLEAN") | _is_number(kind)


def attribute_fault(entry: Column) -> Column:
    """Reason why one attribute is refused, or NULL."""
    infinite = (entry["kind"] == "DOUBLE") & (F.abs(_as_double(entry["value"])) == float("inf"))
    return F.when(
        ~is_scalar(entry["kind"]),
        F.concat(
            F.lit("invalid attributes."), entry["key"], F.lit(": must be string, number, or boolean")
        ),
    ).when(
        infinite,
        F.concat(F.lit("invalid attributes."), entry["key"], F.lit(": number must be finite")),
    )


def attribute_faults(entries: Column) -> Column:
    """Faults in key order of the VARIANT (sorted); empty when all are fine."""
    return F.filter(F.transform(entries, attribute_fault), lambda fault: fault.isNotNull())


def _needs_number_text(entry: Column) -> Column:
    """Numbers whose shortest decimal text Spark does not print itself.

    Integers beyond 2^53, more than 15 digits, tiny values, and anything written
    with an exponent.
    """
    kind = entry["kind"]
    integer = F.try_variant_get(entry["value"], "$", "bigint")
    double = F.abs(_as_double(entry["value"]))
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),", 1).try_cast("int")
    return (
        F.when(kind == "BIGINT", ~integer.between(-MAX_SAFE_INTEGER, MAX_SAFE_INTEGER))
        .when(kind.startswith("DECIMAL"), ~((digits <= 15) & ((double == 0) | (double >= 1e-6))))
        .otherwise(kind == "DOUBLE")
    )


def has_slow_numbers(entries: Column) -> Column:
    return F.exists(entries, _needs_number_text)


def _number_texts(numbers: Column) -> Column:
    """Shortest decimal texts of an ARRAY<DOUBLE>.

    Nested, so that executors need not have this package installed.
    """

    def shortest(number: float) -> str:
        """Plain digits for 1e-6 <= |x| < 1e21, else d.ddde+n."""
        if number == 0:
            return "0"
        sign, digits, exponent = Decimal(repr(number)).normalize().as_tuple()
        prefix = "-" if sign else ""
        text = "".join(map(str, digits))
        point = len(text) + exponent
        if 0 < point <= 21:
            whole, fraction = text[:point].ljust(point, "0"), text[point:]
            return prefix + whole + (f".{fraction}" if fraction else "")
        if -6 < point <= 0:
            return f"{prefix}0.{'0' * -point}{text}"
        fraction = f".{text[1:]}" if len(text) > 1 else ""
        return f"{prefix}{text[0]}{fraction}e{point - 1:+d}"

    @F.pandas_udf("array<string>")
    def texts(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: [shortest(float(x)) for x in row])

    return texts(numbers)


def add_search_map(logs: DataFrame) -> DataFrame:
    """Fill ``attributes_search`` of the rows flagged ``slow_numbers``; drop the flag.

    Only those rows go through Python. Run it on a written table, where the two
    branches are cheap reads with the flag pushed down.
    """
    quick = logs.where(~F.col("slow_numbers")).drop("slow_numbers")
    slow = logs.where(F.col("slow_numbers")).drop("slow_numbers")
    slow = slow.withColumn(
        "_entries",
        attribute_entries(F.try_variant_get("attributes", "$", "map<string,variant>")),
    )
    # One slot per entry, in entry order; texts that Spark prints itself are kept.
    slow = slow.withColumn(
        "_texts", _number_texts(F.transform("_entries", lambda e: F.coalesce(_as_number(e), F.lit(0.0))))
    )
    pairs = F.zip_with(
        F.col("_entries"),
        F.col("_texts"),
        lambda e, text: F.struct(
            e["key"].alias("key"),
            F.when(_needs_number_text(e), text)
            .otherwise(F.try_variant_get(e["value"], "$", "string"))
            .alias("value"),
        ),
    )
    slow = slow.withColumn("attributes_search", F.map_from_entries(pairs))
    return quick.unionByName(slow.drop("_entries", "_texts"))


def _as_number(entry: Column) -> Column:
    return F.when(_is_number(entry["kind"]), _as_double(entry["value"]))


def keep_scalars(attributes: Column) -> Column:
    """VARIANT object without values that are not string, number or boolean; {} for a non-object."""
    entries = F.map_entries(F.try_variant_get(attributes, "$", "map<string,variant>"))
    kept = F.filter(entries, lambda e: is_scalar(F.schema_of_variant(e["value"])))
    return F.coalesce(F.to_variant_object(F.map_from_entries(kept)), F.parse_json(F.lit("{}")))


def ordered_keys(json_object: Column) -> Column:
    """Keys of a JSON object text in property order.

    Array-index keys ascending, then the others by first appearance.
    """
    keys = F.array_distinct(F.json_object_keys(json_object))
    index_of = lambda key: F.when(key.rlike(r"^(0|[1-9]\d{0,9})\z"), key.try_cast("long"))
    is_index = lambda key: F.coalesce(index_of(key) < 4_294_967_295, F.lit(False))
    indexes = F.array_sort(F.transform(F.filter(keys, is_index), index_of)).cast("array<string>")
    return F.concat(indexes, F.filter(keys, lambda key: ~is_index(key)))
