"""Physical plans: what is pushed into scans, what is broadcast, and where all rows would meet in one task."""

import re

import pytest

from keyloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    df = catalog.queries()[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["get", "get_range", "get_range_stream", "get_range_startswith", "range_predicate", "secondary_index"])
def test_filters_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[(?!\])", plan(spark, name))


@pytest.mark.parametrize("name", ["get", "count_range", "ddsketch", "multimap_counts", "set_clear", "counter_by_time"])
def test_scans_read_few_columns(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert schemas and all(s.count(":") <= 3 for s in schemas)


@pytest.mark.parametrize("name", ["interval_overlap", "clear_range", "mapped_range_get", "mapped_range_scan", "consistency_compare", "theta_join"])
def test_joins_have_equal_keys(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["atomic_add", "atomic_and", "ddsketch", "counter_rollup", "set_clear", "multimap_counts"])
def test_aggregates_are_partial_before_the_shuffle(spark, name):
    assert re.search(r"functions=\[partial_", plan(spark, name))


@pytest.mark.parametrize("name", ["segmented_range", "indexed_set", "get_range_byte_limit", "versionstamp_order"])
def test_global_orders_do_not_meet_in_one_task(spark, name):
    # rows are windowed inside ranges; only the totals of ranges have no partition
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan(spark, name))
    assert any("_r#" in w for w in windows)


def test_point_reads_have_no_shuffle(spark):
    assert "Exchange" not in plan(spark, "get")


@pytest.mark.parametrize("name", ["asof_seek", "asof_seek_both", "timestamp_to_version", "version_to_timestamp"])
def test_nearest_rows_do_not_meet_in_one_task(spark, name):
    # what has no partition is a row for each range, which aggregates give
    for window in re.findall(r"Window \[(.*?)\], \[(.*?)\]", plan(spark, name)):
        assert "_r#" in window[1] or "_r#" in window[0] or "_e#" in window[0] or "_t#" in window[0]
