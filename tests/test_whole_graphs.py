import pytest

from tallyloom.operators import graph as G


def test_levels_have_no_bound(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(104)] + [("n0", "n104"), ("a", "b"), ("b", "a"), ("b", "n1")]
    got = {r.node: r.level for r in G.levels(spark.createDataFrame(rows, "parent string, child string")).collect()}
    assert got == {f"n{i}": i for i in range(105)}


def test_a_cycle_is_an_error(spark):
    rows = [("r", "a"), ("a", "b"), ("b", "a")]
    with pytest.raises(ValueError, match="cycle"):
        G.levels(spark.createDataFrame(rows, "parent string, child string"))
