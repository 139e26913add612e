"""Files of any file system Hadoop knows: listing, small texts, caches that are made once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Schemes of cloud storage.
CLOUD = ("s3", "s3a", "gs", "gcs", "abfs", "abfss")


def handle(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = handle(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the visible files of a folder in the order of their names."""
    fs, p = handle(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text, None without the file."""
    fs, p = handle(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text in place of what is there, as a whole."""
    fs, p = handle(spark, path)
    _, part = handle(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"can't put {path} in place")


def made_once(spark: SparkSession, folder: str, make: Callable[[], DataFrame], key: dict | None = None) -> DataFrame:
    """A table that is made at the first call and read from its folder later, as a cache of tokenized data is.

    ``key`` tells what it was made of; another key in the folder is an error. A write that broke off is made again.
    """
    told = json.dumps(key or {}, sort_keys=True)
    if not exists(spark, f"{folder}/data/_SUCCESS"):
        make().write.mode("overwrite").parquet(f"{folder}/data")
        write_text(spark, f"{folder}/key.json", told)
    elif read_text(spark, f"{folder}/key.json") not in (None, told):
        raise ValueError(f"{folder} was made of something else")
    return spark.read.parquet(f"{folder}/data")


def checksums(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each file of a folder by name, to tell whether frozen files have changed."""
    from pyspark.sql import functions as F

    rows = spark.read.format("binaryFile").load(listed(spark, folder)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sum")).collect()
    return {r.name: r.sum for r in sorted(rows)}


def must_be_frozen(spark: SparkSession, folder: str, expected: dict[str, str]) -> None:
    """An error that names what was added, removed or changed."""
    got = checksums(spark, folder)
    changed = sorted(k for k in got.keys() | expected.keys() if got.get(k) != expected.get(k))
    if changed:
        raise ValueError(f"not as frozen: {', '.join(changed)}")
