from tallyloom.plans import catalog


def test_all_parts_are_assigned(spark, tmp_path):
    rows = [(k, f"red bolt {k % 7}", f"TYPE {k % 3}") for k in range(1000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.greedy_match(spark, str(tmp_path)).collect()
    assert sorted(x for r in got for x in (r["row"], r["col"])) == list(range(1000))
    assert all(r["row"] // 10 == r["col"] // 10 == r["g"] for r in got)
