"""What explode made many rows of is never broadcast: Spark sizes it by its rows before."""

import pytest

pytest.importorskip("patchloom.llm")

from patchloom.llm import simhash  # noqa: E402


@pytest.mark.parametrize("hot", [512, 1])
def test_exploded_fingerprints_are_not_broadcast(spark, hot, tmp_path):
    signed = [1 << i for i in range(40)] + [-1 << i for i in range(40)]
    spark.createDataFrame([(v,) for v in signed], "fp long").write.parquet(path := str(tmp_path / "fp"))  # a file's size is known
    links = simhash.links(spark.read.parquet(path), hot)
    plan = links._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line]
    # keys of crowded groups alone, of which there is one for hot fingerprints at least
    assert all("LeftSemi" in j or "LeftAnti" in j for j in joins), joins
    assert plan.count("SortMergeJoin") >= (2 if hot == 1 else 1)
