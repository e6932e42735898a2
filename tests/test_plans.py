"""What the optimizer makes of the plans."""

import re

import pytest

from quillwork.plans.registry import core

QUERIES, _ = core()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))


@pytest.mark.parametrize("name,columns", [("fil_02_usable", 7), ("agg_01_stats_per_key", 6), ("label_table", 6), ("agg_19_mixed_flag", 2), ("win_10_first_seen", 3), ("agg_34_key_variants", 1)])
def test_only_needed_columns_are_read(spark, sf, name, columns):
    for s in scans(QUERIES[name](spark, sf)):
        assert len(s.split(",")) <= columns + 1, s


@pytest.mark.parametrize("name,text", [("agg_38_id_gaps", None), ("win_13_priority_cohort", None), ("joi_01_keyset_dictionary", "PushedFilters: [IsNotNull(o_orderdate)"), ("fil_03_strict", "EqualTo(standard_relation,=)"), ("prj_01_connectivity_key", None)])
def test_filters_reach_the_scan(spark, sf, name, text):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p
    assert text is None or text in p


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith(("fil_", "prj_", "agg_", "str_"))))
def test_no_row_at_a_time_python(spark, sf, name):
    assert "BatchEvalPython" not in plan(QUERIES[name](spark, sf))


def test_no_global_window_over_tables(spark, sf):
    for name in ("prj_05_row_number", "win_04_global_percentile_rank", "win_07_cumulative_recovery", "win_11_surrogate_ids", "p1_plan"):
        p = plan(QUERIES[name](spark, sf))
        for w in re.findall(r"Window \[.*?\], \[([^\]]*)\]", p):
            assert w or name == "p1_plan", f"{name}: a window without partitions"
