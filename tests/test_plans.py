"""What plans must and must not hold."""

import pytest

from papyra.plans import q_functions, q_more, q_relational, q_retrieval  # noqa: F401
from papyra.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["a1_point_lookup"](spark, SF))
    assert "EqualTo(doc_id,42)" in p and "text" not in p.split("ReadSchema")[1]
    p = plan(QUERIES["x2_star_join"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in p and "l_tax" not in p


def test_ranks_are_cut_before_the_shuffle(spark):
    assert plan(QUERIES["i5_quota"](spark, SF)).count("WindowGroupLimit") == 4
    assert "TakeOrderedAndProject" in plan(QUERIES["f6_recency"](spark, SF))
