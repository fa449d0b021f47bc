"""Plan shape: no registered query plans a cross join or nested loop join,
and scans read only the columns they use."""

import pytest

from corpusweave.plans.queries import QUERIES as CORE  # the training-data queries have tests of their own

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in CORE if not n.startswith("stream_"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_or_nested_loop_join(spark, name):
    df = CORE[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_are_pruned(spark):
    df = CORE["status_match"](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = _plan(df)
    # lineitem is read for 4 of its 11 columns
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string,l_linestatus:string>" in plan
    assert "l_quantity" not in plan and "l_extendedprice" not in plan
