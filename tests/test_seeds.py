from pyspark.sql import functions as F

from factorloom.operators import cluster


def test_every_vector_of_a_partition_can_be_a_seed(spark):
    """A single vector apart, at the start of a large partition, is the second seed: all other distances are 0."""
    rows = spark.range(0, 100_000, 1, 1).select("id", F.when(F.col("id") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("features"))
    for seed in (1, 2):
        assert sorted(r.centroid for r in cluster.seeds(rows, 2, seed=seed).collect()) == [[0.0, 1.0], [1.0, 0.0]]
