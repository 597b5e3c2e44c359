"""Contact tables from business listings and web pages, as PySpark DataFrame jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch between Spark and a Python worker, where the session keeps Spark's defaults of 10 000 and 64 MB:
#: texts are long, and both sides hold whole batches outside Spark's own memory bounds (the JVM also keeps much of what it frees).
BATCH = {"maxRecordsPerBatch": ("10000", "1500"), "maxBytesPerBatch": ("67108864b", "4194304b")}


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers that start on this machine import the package (on a cluster, ship it with --py-files instead), and
    bounds the size of Arrow batches."""
    for name, (default, bound) in BATCH.items():
        if spark.conf.get(key := f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(key, bound)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
    return spark
