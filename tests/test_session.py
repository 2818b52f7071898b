"""Session helpers: checkpoint folder, stored tables."""

from ledgerlens.session import checkpoint_dir, ensure_checkpoint_dir, new_folder, remove_folder, write_table


def test_checkpoint_dir_is_set_in_local_mode(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and checkpoint_dir(spark)


def test_write_table_keeps_rows_and_cuts_lineage(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "id % 7 AS k").groupBy("k").count()
    kept = write_table(df, str(tmp_path / "t"), ("k",))
    assert sorted(map(tuple, kept.select("k", "count").collect())) == sorted(map(tuple, df.collect()))
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_folders_are_fresh_and_removable(spark, tmp_path):
    a, b = new_folder(spark, str(tmp_path), "x"), new_folder(spark, str(tmp_path), "x")
    assert a != b
    write_table(spark.range(3), a)
    remove_folder(spark, a)
    assert list(tmp_path.iterdir()) == []
