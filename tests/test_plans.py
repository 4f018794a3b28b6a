import pytest

from voxelloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON = {"src13_14_snk2_4_wire_round_trip", "src9_10_topk_files"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    """No product of tables, and Python only for binary formats."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    assert name in PYTHON or ("MapInArrow" not in plan and "ArrowEvalPython" not in plan)
    if "parquet" in plan:
        assert "ReadSchema" in plan


def test_box_reaches_the_scan(spark, tmp_path):
    from voxelloom.operators import maps
    from voxelloom.params import MapParams

    spark.createDataFrame([(1, 2, 3, 2.0, 1.0)], "ix int, iy int, iz int, a_occ double, a_free double").write.parquet(str(tmp_path / "beta"))
    b = spark.read.parquet(str(tmp_path / "beta"))
    plan = b.where(maps.in_box((0, 0, 0), (1, 1, 1), MapParams().resolution))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ix,0), LessThanOrEqual(ix,10)" in plan.partition("PushedFilters")[2]
