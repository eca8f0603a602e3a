"""What Catalyst makes of the queries: pruned scans, shared windows, no cross joins, no sort aggregates over ticks."""

import os
import re

import pytest

from tidewater.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LAZY = "sma_multi impute ffill bfill lag_features standardise sequences roc_binary rolling_std_halves minmax_close acf tick_sma tick_ema resample_month detrend split3 corr_long missing_report spectrum_peaks aligned metrics_pivot bars_by_hour_spined tick_ffill tick_bfill tick_median tick_impute".split()


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert not re.search("Cartesian|NestedLoop|SortAggregate", text)


def test_scans_are_pruned(spark):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, "sma"))
    assert schemas and all({c.split(":")[0] for c in s.split(",")} == {"o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"} for s in schemas)


def test_frames_share_a_window(spark):
    assert len(re.findall(r"Window \[", plan(spark, "sma_multi"))) == 1
    assert len(re.findall(r"Window \[", plan(spark, "ffill"))) == 1


def test_filters_reach_the_scan(spark):
    from tidewater.sources.files import read_table

    text = read_table(spark, FOLDER, "orders").where("o_orderpriority = '5-LOW'").select("o_totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,5-LOW)" in text
