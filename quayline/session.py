"""Session settings.

Nothing in the library needs these to be *correct*; they are the settings the jobs were
tuned with.  ``cluster_conf`` sizes the shuffles from the number of input bytes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

MB = 1024 * 1024

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # splits the partitions of a hot order or customer key in shuffled joins
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast is always decided by Spark against this size, never forced by a hint
    "spark.sql.autoBroadcastJoinThreshold": str(32 * MB),
    # shuffled joins whose every build partition is below this need no sort
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 * MB),
}


def cluster_conf(input_bytes: int, partition_bytes: int = 256 * MB) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of table data.

    The number of shuffle partitions starts high enough that one holds about
    ``partition_bytes`` even when every scanned byte is shuffled; AQE merges the small ones.
    State of the streaming jobs goes to RocksDB so that it may exceed the heap.
    """
    shuffle = max(200, -(-input_bytes // partition_bytes))
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A quiet ``local[cpus]`` session for tests and the bench."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quayline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
    )
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
