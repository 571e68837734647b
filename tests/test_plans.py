"""Plan checks: the SQL-checkable operators never build a cartesian product or
run row-at-a-time Python, and parquet scans are pruned."""
import pytest

import __spark_entry__ as E

PLAIN = [n for n in E.oracle_sql()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_no_cartesian_no_python(spark, small_dir, name):
    p = _plan(E.queries()[name](spark, small_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_is_pruned(spark, small_dir):
    # roc_auc needs no order column: Catalyst removes the whole orders join
    p = _plan(E.queries()["roc_auc"](spark, small_dir))
    assert "c_acctbal" in p and "c_name" not in p and "o_orderpriority" not in p
    # the service flags do need orders: only the two used columns are read
    p2 = _plan(E.queries()["clean_lenient"](spark, small_dir))
    assert "o_orderpriority" in p2 and "o_totalprice" not in p2 and "o_orderdate" not in p2
