from factorloom.streaming import ingest


def test_folding_files(spark, tmp_path):
    inbound, snap, check = (str(tmp_path / p) for p in ("in", "snap", "check"))
    first = spark.createDataFrame([("1", "10", 2.0), ("1", "11", 1.0), ("x", "1", 1.0)], "user_text string, item_text string, value double")
    ingest.append(first, inbound)
    ingest.fold(spark, ingest.lines(spark, inbound), snap, check).awaitTermination()
    ingest.append(spark.createDataFrame([("1", "10", None), ("1", "11", 4.0), ("2", '"tag"', 1.0)], first.schema), inbound)
    ingest.fold(spark, ingest.lines(spark, inbound), snap, check).awaitTermination()
    ingest.fold(spark, ingest.lines(spark, inbound), snap, check).awaitTermination()  # nothing new
    got = {(r.user_id, r.item_id): r.value for r in ingest.latest(spark, snap).collect()}
    assert len(got) == 2 and got[1, 11] == 5.0 and (1, 10) not in got
    assert spark.read.parquet(f"{snap}-bad/*").count() == 1
