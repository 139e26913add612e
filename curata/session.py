"""Session factory and the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from curata.plans.lineage import own_folder

#: Settings that hold on a cluster as on a laptop; sizes are left to the cluster.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "curata", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session instead."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = BASE_CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": os.environ.get("CURATA_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": "file://" + own_folder(),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
