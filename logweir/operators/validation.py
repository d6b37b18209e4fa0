"""Entry validation: each raw entry becomes an accepted log or a reject with a reason."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir import schema
from logweir.functions.attributes import (
    attribute_entries,
    attribute_fault,
    attribute_faults,
    are_plain,
    has_slow_numbers,
    native_texts,
    ordered_keys,
)
from logweir.functions.text import is_blank
from logweir.functions.timestamps import strict_timestamp
from logweir.session import compute_once
from logweir.sources.requests import EMPTY_BATCH, UNLIMITED, tamed

NOT_AN_OBJECT = "log entry must be an object"
BEYOND_LIMITS = "log entry exceeds the limits of the JSON parser"
LOG_FIELDS = ("timestamp", "level", "service", "message", "attributes", "attributes_search")


def _text_field(field: str) -> Column:
    """The field as text when it is a JSON string, else NULL."""
    value = F.try_variant_get("entry", f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("entry", f"$.{field}", "string"))


def _required(field: str) -> str:
    return f"{field} is required and must be a string"


def _text_reason(field: str) -> Column:
    text = F.col(field)
    return F.when(text.isNull(), _required(field)).when(is_blank(text), f"{field} must be non-empty")


def timestamp_reason(text: Column, parsed: Column, now: Column) -> Column:
    """Reason for a bad or too late timestamp. Exactly five minutes ahead still passes."""
    ahead = F.unix_millis(parsed) - F.unix_millis(now)
    return (
        F.when(text.isNull(), _required("timestamp"))
        .when(parsed.isNull(), "invalid timestamp")
        .when(ahead > schema.MAX_FUTURE_MS, "timestamp is more than 5 minutes in the future")
    )


def validate_entries(entries: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Check the ``entry VARIANT`` of each row; the first failing rule names the reason.

    The rules run in the order timestamp, level, service, message, attributes.
    ``now`` is an instant with a time zone, fixed for the whole batch.

    Replaces ``entry`` by ``reason`` (NULL when accepted), the log fields, ``raw``
    (text of a refused entry), ``slow_numbers`` (``attributes_search`` still needs
    :func:`logweir.functions.attributes.add_search_map`) and ``order_unsure``
    (several bad attributes: :func:`settle_attribute_order` names the first).
    """
    others = [name for name in entries.columns if name != "entry"]
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    fields = entries.select(
        *others,
        "entry",
        _text_field("timestamp").alias("timestamp_text"),
        _text_field("level").alias("level"),
        _text_field("service").alias("service"),
        _text_field("message").alias("message"),
        F.try_variant_get("entry", "$.attributes", "variant").alias("attributes"),
    )
    parsed = fields.withColumn("timestamp", strict_timestamp(F.col("timestamp_text"))).withColumn(
        "texts", native_texts(F.col("attributes"))
    )
    # Only unusual attributes are looked at one by one.
    unusual = ~are_plain(F.col("attributes"), F.col("texts"))
    entries_of = attribute_entries(F.try_variant_get("attributes", "$", "map<string,variant>"))
    listed = parsed.withColumn("attribute_entries", F.when(unusual, entries_of))
    checked = listed.withColumn("faults", attribute_faults(F.col("attribute_entries")))

    level = F.col("level")
    level_reason = F.when(level.isNull(), _required("level")).when(
        ~level.isin(*schema.LOG_LEVELS), F.concat(F.lit("invalid level: '"), level, F.lit("'"))
    )
    attributes_reason = F.when(
        F.col("attributes").isNotNull() & F.col("texts").isNull(),
        "attributes must be a flat object",
    ).otherwise(F.get("faults", F.lit(0)))
    # A field of a non-object is missing, so only rows without a timestamp can be non-objects.
    beyond = F.schema_of_variant("entry") == "BINARY"
    shape_reason = F.when(F.col("timestamp_text").isNull() & beyond, BEYOND_LIMITS).when(
        F.col("timestamp_text").isNull()
        & ~F.coalesce(F.schema_of_variant("entry").startswith("OBJECT"), F.lit(False)),
        NOT_AN_OBJECT,
    )
    other_reason = F.coalesce(
        shape_reason,
        timestamp_reason(F.col("timestamp_text"), F.col("timestamp"), now),
        level_reason,
        _text_reason("service"),
        _text_reason("message"),
    )
    reason = F.coalesce("other_reason", attributes_reason)
    slow = F.coalesce(has_slow_numbers(F.col("attribute_entries")), F.lit(False))
    several = F.coalesce(F.size("faults"), F.lit(0)) > 1
    judged = checked.withColumn("other_reason", other_reason).select(
        "*",
        compute_once(
            reason=reason,
            slow_numbers=reason.isNull() & slow,
            order_unsure=F.col("other_reason").isNull() & several,
        ),
    )
    accepted = F.col("reason").isNull()
    texts = F.coalesce("texts", F.create_map().cast("map<string,string>"))
    return judged.select(
        *others,
        "reason",
        *(F.when(accepted, F.col(name)).alias(name) for name in ("timestamp", "level", "service", "message")),
        F.when(accepted, F.coalesce("attributes", F.parse_json(F.lit("{}")))).alias("attributes"),
        F.when(accepted & ~F.col("slow_numbers"), texts).alias("attributes_search"),
        F.when(~accepted & beyond, F.try_variant_get("entry", "$", "binary").cast("string"))
        .when(~accepted, F.to_json("entry"))
        .alias("raw"),
        "slow_numbers",
        "order_unsure",
    )


def settle_attribute_order(rejects: DataFrame, requests: DataFrame) -> DataFrame:
    """Name the first bad attribute in the order it was sent.

    A VARIANT sorts its keys, so for rows flagged ``order_unsure`` the order is
    looked up in the request body. Each such body is cut into the texts of its
    entries once; the rows come to it as a list, at most 5,000 of a request.
    Needs ``(request_seq, entry_index, reason, raw, order_unsure)`` and
    ``(request_seq, body)``; returns reject rows.
    """
    # All rejects in one pass, as a second one may parse them again; a body without unsure ones is not looked at.
    entry = F.struct("entry_index", "reason", "raw", "order_unsure")
    grouped = rejects.groupBy("request_seq").agg(F.collect_list(entry).alias("rejects"), F.bool_or("order_unsure").alias("any_unsure"))
    bodies = grouped.join(requests.select("request_seq", "body"), "request_seq", "left").withColumn("body", F.when(F.col("any_unsure"), F.col("body")))
    # Entries beyond the parser's limits are of no interest here, but keep their places.
    body = F.when(F.try_parse_json("body").isNull(), tamed(F.col("body"), "")).otherwise(F.col("body"))
    texts = F.from_json(body, "logs array<string>", UNLIMITED)["logs"]
    cut = bodies.select("request_seq", "rejects", compute_once(texts=texts))
    names = ("entry_index", "reason", "raw", "order_unsure")
    # Picked before the rows part, which would each carry all texts.
    with_text = F.transform("rejects", lambda row: F.struct(
        *(row[name].alias(name) for name in names), F.when(row["order_unsure"], F.get("texts", row["entry_index"])).alias("sent")
    ))
    listed = cut.select("request_seq", F.inline(with_text))
    unsure_raw = F.when(F.col("order_unsure"), F.col("raw"))
    attributes = F.try_variant_get(F.try_parse_json(unsure_raw), "$.attributes", "map<string,variant>")
    listed = listed.withColumn("keys", ordered_keys(F.call_function("get_json_object", F.col("sent"), F.lit("$.attributes")))).withColumn(
        "faulty", F.filter(attribute_entries(attributes), lambda e: attribute_fault(e).isNotNull())
    )
    reasons = F.map_from_entries(
        F.transform(
            "faulty", lambda e: F.struct(e["key"].alias("key"), attribute_fault(e).alias("reason"))
        )
    )
    first = F.get(F.filter("keys", lambda key: F.map_contains_key("reasons", key)), F.lit(0))
    listed = listed.withColumn("reasons", reasons).withColumn(
        "reason", F.coalesce(F.try_element_at("reasons", first), F.col("reason"))
    )
    return listed.select("request_seq", "entry_index", "reason", "raw")


def rejected_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull()).select("request_seq", "entry_index", "reason", "raw")


def accepted_rows(validated: DataFrame) -> DataFrame:
    """The fixed log fields only; unknown fields of the entry are gone."""
    return validated.where(F.col("reason").isNull()).select("request_seq", "entry_index", *LOG_FIELDS, "slow_numbers")


def batch_report(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per request: status, accepted count and the rejected entries by index.

    ``states`` is ``(request_seq, n_entries, error)``, ``outcomes`` is
    ``(request_seq, entry_index, reason)``. A request has at most 5000 entries,
    which bounds the list. The request rows are joined in by the same
    aggregation, so there is one shuffle.
    """
    nothing = F.lit(None)
    envelope = states.where(F.col("error").isNotNull() | (F.col("n_entries") == 0)).select(
        "request_seq",
        F.lit(0).alias("accepted"),
        F.when(
            F.col("error").isNull(),
            F.struct(F.lit(-1).alias("index"), F.lit(EMPTY_BATCH).alias("reason")),
        ).alias("reject"),
        "error",
    )
    entries = outcomes.select(
        "request_seq",
        F.when(F.col("reason").isNull(), 1).otherwise(0).alias("accepted"),
        F.when(
            F.col("reason").isNotNull(),
            F.struct(F.col("entry_index").alias("index"), F.col("reason").alias("reason")),
        ).alias("reject"),
        nothing.cast("string").alias("error"),
    )
    return _reported(envelope.unionByName(entries))


def entry_report(validated: DataFrame) -> DataFrame:
    """:func:`batch_report` of validated entries and the rows of refused or empty requests, in one pass over them."""
    is_entry, index = F.col("entry_index").isNotNull(), F.coalesce("entry_index", F.lit(-1))
    reason = F.when(is_entry, F.col("reason")).when(F.col("error").isNull(), EMPTY_BATCH)
    rows = validated.select(
        "request_seq",
        F.when(is_entry & F.col("reason").isNull(), 1).otherwise(0).alias("accepted"),
        F.when(reason.isNotNull(), F.struct(index.alias("index"), reason.alias("reason"))).alias("reject"),
        "error",
    )
    return _reported(rows)


def _reported(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("request_seq").agg(
        F.sum("accepted").alias("accepted"),
        F.array_sort(F.collect_list("reject")).alias("rejected"),
        F.max("error").alias("error"),
    )
    status = (
        F.when(F.col("error").isNotNull(), "refused")
        .when(F.col("accepted") > 0, "ok")
        .otherwise("all_rejected")
    )
    return grouped.select("request_seq", status.alias("status"), "accepted", "rejected", "error")
