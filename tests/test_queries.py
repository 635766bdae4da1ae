"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import os

import pytest

from compare import differ
from panelworks.plans import catalog

ROOT = os.environ.get("PANELWORKS_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")
#: Too few rows on the smallest tables for the query to return any.
MAY_BE_EMPTY = {"a26_mixed_cohorts", "j24_referential_integrity", "j27_two_hop_values"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    said = differ(spark, ROOT, catalog.QUERIES[name], catalog.ORACLES[name])
    assert not said or said == "no rows" and name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, ROOT).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_validity_union_keeps_an_order_numbered_like_a_placeholder(spark, tmp_path):
    orders = spark.read.parquet(f"{ROOT}/orders.parquet").limit(40)
    orders.selectExpr("* except (o_orderkey)", "999980 + row_number() over (order by o_orderkey) as o_orderkey").selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in orders.schema]).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.QUERIES["s15_validity_union"](spark, str(tmp_path)).selectExpr("sum(known)", "sum(n)", "sum(total)").first()
    keys = range(999981, 1000021)
    assert tuple(got) == (sum(k % 5 != 0 for k in keys), 40, sum(k for k in keys if k % 5))
