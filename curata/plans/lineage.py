"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A cluster must name one; asking for it without is an error, never a machine's own temporary folder. Only a local
    session, whose executors are this process, gets a folder of its own, which goes when the process ends.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + own_folder()


def own_folder() -> str:
    """A temporary folder of this process, for local sessions only; removed at its end."""
    global _OWN
    if _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="curata-")
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    return os.path.join(_OWN, "shared")


_OWN: str | None = None


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: a lost executor loses nothing.

    Spark removes what was written when the result is no longer referenced, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set (``local_session`` sets it; a cluster's session should).
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)
