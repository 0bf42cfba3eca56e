"""Session settings the jobs are meant to run with."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Re-plan joins and partition sizes from what was measured.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are parsed after the join with recorded responses: split a hot id
    # earlier than its bytes alone would ask for.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    # Hash instead of sort joins, so that wide items are not sorted, but only
    # where every partition of the other side was measured to be this small.
    # Has no effect below spark.sql.adaptive.advisoryPartitionSizeInBytes.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Do not look up the Python line of every column made: plans here are big.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Prompts are long: few of them per Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    if "spark.checkpoint.dir" not in more:
        folder = tempfile.mkdtemp(prefix="gradeframe-")
        atexit.register(shutil.rmtree, folder, True)
        more["spark.checkpoint.dir"] = f"file:{folder}"
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gradeframe")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        **more,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
