"""Every oracle query at sf0.001 equals its DuckDB SQL (same hashing as the driver check)."""
import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, small_dir, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], small_dir)
    assert r["cols"], (r["scols"], r["dcols"])
    assert r["rows"][0] == r["rows"][1]
    assert r["hash"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 1 and "discount" in df.columns
