from factorloom.plans.sizing import cluster_settings


def test_partitions_grow_with_the_input():
    small, large = cluster_settings(10**9, 8), cluster_settings(100 * 10**12, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(large["spark.sql.shuffle.partitions"]) > 200_000
