"""Structured Streaming: windows and sessions with watermarks, resumable sinks, splits, interleaving. Each runs to the end of its input."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.operators.relational import mark_first, unions
from curata.plans.lineage import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder for a stream's state and output, in the shared folder the session names."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files of a folder (or one file) as a stream with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    one = os.path.isfile(path.removeprefix("file://"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if one else reader.parquet(path)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions in a folder, ascending: those whose write has put down its success mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def each_batch(stream: DataFrame, at: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream to the end of its input through a writer of batches; the state in ``at`` lets a later run resume."""
    q = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).outputMode(mode).start()
    q.awaitTermination()


def run(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote; with ``at`` a later run resumes there.

    Append output is a file sink, written exactly once. In the other modes each trigger writes a version of the whole
    table by its number, so a repeated trigger writes the same version again and a broken one is never read.
    """
    spark = stream.sparkSession
    at = at or scratch(spark)
    out = f"{at}/out"
    if mode == "append":
        w = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        w.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    each_batch(stream, at, lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/v{batch}"), mode)
    done = versions(spark, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/v{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str, late: str, at: str | None = None) -> DataFrame:
    """(key, start, n, total) of the tumbling windows that the watermark has closed.

    The watermark follows ``late`` behind the latest time seen. A row that comes when its window is closed is dropped, a closed
    window is written once and its state freed; windows still open when the input ends aren't in the result.
    """
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = s.groupBy(key, F.window(time, width)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return run(w.select(key, F.col("window.start").alias("start"), "n", "total"), at=at)


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str, at: str | None = None) -> DataFrame:
    """(key, start, end, n) of the sessions that the watermark has closed; late rows and open sessions as in ``windowed``."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = s.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return run(w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"), at=at)


def latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """(key, n, last_id): how far a log has come."""
    return run(source(spark, path).groupBy(key).agg(F.count("*").alias("n"), F.max(order).alias("last_id")), "complete")


def progress(stream: DataFrame, key: str, step: str, total: str, time: str, tokens: str, at: str | None = None) -> DataFrame:
    """(key, steps, total, percentage, elapsed, remaining, throughput) of an append-only training log, in seconds; NULL where no step or time has passed."""
    g = stream.groupBy(key).agg(F.max(step).alias("steps"), F.max(total).alias("total"), (F.max(F.col(time).cast("timestamp").cast("double")) - F.min(F.col(time).cast("timestamp").cast("double"))).alias("elapsed"), F.sum(tokens).alias("tokens"))
    left = F.when(F.col("steps") > 0, F.col("elapsed") / F.col("steps") * (F.col("total") - F.col("steps")))
    return run(g.select(key, "steps", "total", F.round(100 * F.col("steps") / F.col("total"), 2).alias("percentage"), "elapsed", left.alias("remaining"), F.when(F.col("elapsed") > 0, F.col("tokens") / F.col("elapsed")).alias("throughput")), "complete", at)


def held_out(key: Column, share: float, seed: int) -> Column:
    """A stateless split of a stream: whether a row is held out, by a hash of its key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def take_skip(stream: DataFrame, key: str, n: int, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(taken, rest): the first n rows as they arrive, in a fixed order inside a batch, and all that follow; exact across restarts.

    A batch counts what the versions before its own have taken, so a repeated batch decides as before.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    spark = stream.sparkSession
    at = at or scratch(spark)

    def write(df: DataFrame, batch: int) -> None:
        before = [f"{at}/taken/v{v}" for v in versions(spark, f"{at}/taken") if v < batch]
        have = spark.read.schema(stream.schema).parquet(*before).count() if before else 0
        marked = mark_first(df, n - have, [F.col(key)], [F.pmod(F.xxhash64(key), F.lit(65_536))], "__taken")
        marked.where("__taken").drop("__taken").write.mode("overwrite").parquet(f"{at}/taken/v{batch}")
        marked.where("NOT __taken").drop("__taken").write.mode("overwrite").parquet(f"{at}/rest/v{batch}")

    each_batch(stream, at, write)
    parts = []
    for side in ("taken", "rest"):
        done = [f"{at}/{side}/v{v}" for v in versions(spark, f"{at}/{side}")]
        parts.append(spark.read.schema(stream.schema).parquet(*done) if done else spark.createDataFrame([], stream.schema))
    return parts[0], parts[1]


def shuffled(stream: DataFrame, key: str, seed: int, at: str | None = None) -> DataFrame:
    """The stream's rows with (batch, place): each micro-batch in a seeded order, as a shuffle buffer of its size gives."""
    spark = stream.sparkSession
    at = at or scratch(spark)

    def write(df: DataFrame, batch: int) -> None:
        mixed = df.withColumn("batch", F.lit(batch).cast("bigint")).withColumn("place", F.xxhash64(F.col(key), F.lit(seed + batch)))
        mixed.repartitionByRange("place", key).sortWithinPartitions("place", key).write.mode("overwrite").parquet(f"{at}/out/v{batch}")

    each_batch(stream, at, write)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("place", T.LongType())])
    done = [f"{at}/out/v{v}" for v in versions(spark, f"{at}/out")]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def mapped(stream: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of whole batches over a stream, by Arrow batches."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(work, batches)

    return stream.mapInPandas(each, schema)


def interleaved(streams: dict[str, DataFrame], name: str = "stream") -> DataFrame:
    """One stream of several, each row with the name of its own; every trigger takes from all of them."""
    return unions([s.withColumn(name, F.lit(k)) for k, s in streams.items()])


def check_arguments(streaming: bool, max_steps: int | None, max_samples: int | None, validation_share: float = 0.0) -> None:
    """The rules of training on a stream: it has no length, so steps are needed, and samples and shares can't be counted."""
    if not streaming:
        return
    if not max_steps or max_steps < 1:
        raise ValueError("a stream has no length: give max_steps")
    if max_samples is not None:
        raise ValueError("max_samples doesn't go with a stream")
    if 0 < validation_share < 1:
        raise ValueError("on a stream the validation size must be a number of rows")
