"""Plan shape checks: pushdown, pruning, no cartesian products, no
single-partition windows on the data path."""

import re

import pytest

from conftest import SMALL
import __spark_entry__ as E


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["all_pairs_runs", "pvf_iter_priority", "pvf_iter_type", "rank_answers_runs",
                                  "dedupe_keep_best", "replay_weights", "stable_timing", "filter_report",
                                  "filter_report_runs", "nest_answers", "one_pair", "latest_metrics"])
def test_no_cartesian_or_global_window(spark, name):
    df = E.queries()[name](spark, SMALL)
    p = plan_of(df)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    # A window without PARTITION BY runs in one task: "Window [...], [], [...]".
    assert not re.search(r"Window \[.*?\], \[\], \[", p)


def test_scan_prunes_columns(spark):
    df = E.queries()["pass_at_k"](spark, SMALL)
    p = plan_of(df)
    assert "ReadSchema: struct<l_partkey:bigint,l_linenumber:int,l_returnflag:string,l_linestatus:string>" in p


def test_filter_pushed_to_scan(spark):
    from pairforge.plans import fixtures as X
    df = X.ch_chat(spark, SMALL)
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in p or "EqualTo(role,user)" in p
