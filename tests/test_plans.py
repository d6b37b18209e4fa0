"""Physical plans: what is pruned, pushed down and kept out of Python."""

import pytest
from cases import GOLDEN_NOW, body, golden, requests
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from logweir.operators.filters import apply_filters
from logweir.operators.listing import list_logs
from logweir.operators.validation import accepted_rows, rejected_rows, validate_entries
from logweir.params import AggregateQuery, LogQuery, QueryCursor
from logweir.plans import logview
from logweir.sources.requests import explode_entries, parse_requests
from logweir.store import LogStore

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = LogStore(spark, str(tmp_path_factory.mktemp("plans")), indexed=("crate",))
    store.ingest(requests(spark, body(*golden())), "golden", GOLDEN_NOW)
    return store


def test_time_range_prunes_days_and_is_pushed_down(store):
    text = plan(apply_filters(store.logs(), LogQuery(since="2011-03-05T09:00:00Z", until="2011-03-05T12:00:00Z", service="s")))
    partition = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "log_date" in partition and ">= 2011-03-05" in partition and "<= 2011-03-05" in partition
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed and "EqualTo(service,s)" in pushed


def test_indexed_attribute_is_pushed_down_without_the_map(store):
    query = AggregateQuery(
        since="2011-03-05T09:00:00Z", until="2011-03-05T12:00:00Z", bucket="5m", attributes={"crate": "K1"}
    )
    text = plan(store.bucket_counts(query))
    assert "EqualTo(attr_crate,K1)" in text.split("PushedFilters: [")[1].split("]")[0]
    assert "attributes" not in text.split("ReadSchema: struct<")[1].split(">")[0]


def test_cursor_is_pushed_down(store):
    text = plan(apply_filters(store.logs(), LogQuery(cursor=QueryCursor.parse("2011-03-05T09:00:00Z,5"))))
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "LessThanOrEqual(timestamp" in pushed and "Or(LessThan(timestamp" in pushed


def test_listing_keeps_top_rows_per_task(store):
    text = plan(list_logs(store.logs(), LogQuery()))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_bucket_count_reads_few_columns_and_combines_early(store):
    query = AggregateQuery(since="2011-03-05T09:00:00Z", until="2011-03-05T12:00:00Z", bucket="5m", group_by="level")
    text = plan(store.bucket_counts(query, "base"))
    assert "partial_count" in text and text.count("hashpartitioning") == 1
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert schema == "timestamp:timestamp,level:string"


def test_filters_do_not_repeat_the_parse(spark):
    parsed = parse_requests(requests(spark, body(*golden())))
    validated = validate_entries(explode_entries(parsed.where("error is null")), GOLDEN_NOW)
    for frame in (accepted_rows(validated), rejected_rows(validated)):
        text = plan(frame)
        # One parse, and one of what the first refuses.
        assert text.count("parseJson(") <= 2 and text.count("RLIKE(timestamp_text") <= 1


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - {"normalize_attributes"}))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry_points.queries()[name](spark, SF_DIR))
    assert "EvalPython" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_requests_are_spread_and_rejects_settled_in_one_pass(spark):
    for made in (logview.requests_beyond_limits, logview.twice_faulty_requests):
        assert made(spark, "/root/testdata/sf0.01").select(F.spark_partition_id()).distinct().count() > 4
    # One reading for the rejects, one for the bodies.
    assert plan(entry_points.queries()["reject_order"](spark, SF_DIR)).count("FileScan parquet") == 2
