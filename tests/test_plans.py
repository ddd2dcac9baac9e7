"""Plans read what they need and don't shuffle what they needn't."""

import re

from pyspark.sql import functions as F

from siftmine.plans import queries
from siftmine.plans.testdata import table

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    p = plan(queries.grouped_mean_topk(spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in p
    assert "TakeOrderedAndProject" in p and "BroadcastHashJoin" in p


def test_filters_reach_the_scan(spark):
    p = plan(table(spark, SF, "lineitem").where(F.col("l_quantity") > 45).select("l_orderkey"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(l_quantity,45", p)


def test_counts_are_combined_before_the_shuffle(spark):
    p = plan(queries.top10_users(spark, SF))
    assert p.count("HashAggregate") == 2 and p.count("Exchange hashpartitioning") == 1 and "partial_count" in p


def test_signatures_are_one_pass(spark):
    p = plan(queries.minhash_signatures(spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "CartesianProduct" not in p
