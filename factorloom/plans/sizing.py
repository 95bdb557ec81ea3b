"""Session settings that follow from the input size and the cluster."""

from __future__ import annotations

# Bytes a shuffle task should handle: large enough to amortise a task, small enough to sort
# in memory beside other tasks of the executor.
SHUFFLE_BYTES = 200 * 1024**2


def cluster_settings(input_bytes: int, total_cores: int, *, shuffle_share: float = 0.5) -> dict[str, str]:
    """Settings for a run over ``input_bytes``; ``shuffle_share`` is the part that is shuffled.

    At 100 TB and a half shuffled this asks for about 262,000 initial partitions, which
    adaptive execution merges where aggregation has shrunk the data.
    """
    partitions = max(2 * total_cores, int(input_bytes * shuffle_share / SHUFFLE_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * SHUFFLE_BYTES),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024**2),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # no call-site capture for every column expression on the driver
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
