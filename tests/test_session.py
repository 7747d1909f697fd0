from factorloom.session import forget, shared_dir, write_table


def test_tables_are_cut_and_forgotten(spark, tmp_path):
    from pathlib import Path

    df = write_table(spark.range(5), "some")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    assert df.count() == 5 and list(folder.glob("some-*")) and "Range" not in df._jdf.queryExecution().toString()
    forget(spark)
    assert not list(folder.glob("some-*"))
    assert write_table(spark.range(0), "none").count() == 0
