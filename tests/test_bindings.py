"""The stand-in tables read every source row."""

import pytest

from rippleframe.plans import catalog
from rippleframe.plans.bindings import BINDINGS, bound


@pytest.fixture(scope="module")
def one_row(spark, tmp_path_factory):
    """Tables of one row each, whose keys are no multiples of anything."""
    top = str(tmp_path_factory.mktemp("one"))
    spark.sql("""SELECT 1L AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 2 AS l_linenumber, 'A' AS l_returnflag, 'O' AS l_linestatus, 1.0D AS l_extendedprice,
                 TIMESTAMP '1997-01-01 00:00:00' AS l_shipdate""").write.parquet(f"{top}/lineitem.parquet")
    spark.sql("SELECT 1L AS p_partkey, 'Brand#1' AS p_brand, 1 AS p_size").write.parquet(f"{top}/part.parquet")
    spark.sql("SELECT 1L AS s_suppkey, 1 AS s_nationkey").write.parquet(f"{top}/supplier.parquet")
    spark.sql("SELECT 1L AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus").write.parquet(f"{top}/orders.parquet")
    spark.sql("SELECT 1L AS c_custkey, 1 AS c_nationkey, 'MACHINERY' AS c_mktsegment").write.parquet(f"{top}/customer.parquet")
    return top


@pytest.mark.parametrize("name", sorted(BINDINGS))
def test_no_row_is_left_out(spark, one_row, name):
    assert bound(spark, one_row, name).count() == 1


def test_coverage_reason_reads_every_customer(spark, one_row):
    assert [tuple(r) for r in catalog.a20_coverage_reason(spark, one_row).collect()] == [(1, "REFLECTION")]
