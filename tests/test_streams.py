"""Streams run to their end, resume, and keep each file's rows once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curata.streaming import streams


def events(*rows):
    return [(k, dt.datetime(2024, 1, d, h), key, 1.0) for k, (d, h, key) in enumerate(rows)]


SCHEMA = "id bigint, ts timestamp, k string, v double"


def test_late_rows_are_dropped_and_closed_windows_written_once(spark, tmp_path):
    """Two runs: a row behind the watermark of the first is dropped in the second; the batch result counts it."""
    src, at = str(tmp_path / "in"), f"file://{tmp_path}/work"
    first, second = events((1, 5, "a"), (1, 6, "a"), (2, 1, "a"), (6, 0, "b")), events((1, 7, "a"), (5, 1, "a"), (9, 0, "b"))
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(src)
    got = streams.windowed(streams.source(spark, src), "ts", "k", "v", "1 day", "2 days", at)
    assert sorted((r.k, r.start.day, r.n) for r in got.collect()) == [("a", 1, 2), ("a", 2, 1)]
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    got = streams.windowed(streams.source(spark, src), "ts", "k", "v", "1 day", "2 days", at)
    assert sorted((r.k, r.start.day, r.n) for r in got.collect()) == [("a", 1, 2), ("a", 2, 1), ("a", 5, 1), ("b", 6, 1)]
    assert spark.read.parquet(src).where("k = 'a' AND day(ts) = 1").count() == 3


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(events((1, 5, "a"), (1, 6, "a"), (1, 9, "a"), (9, 0, "b")), SCHEMA).coalesce(1).write.parquet(src)
    got = streams.sessions(streams.source(spark, src), "ts", "k", "2 hours", "1 day")
    assert sorted((r.k, r.start.hour, r.end.hour, r.n) for r in got.collect()) == [("a", 5, 8, 2), ("a", 9, 11, 1)]


def test_take_skip_is_exact_across_runs(spark, tmp_path):
    src, at = str(tmp_path / "in"), f"file://{tmp_path}/work"
    spark.range(5).write.parquet(src)
    taken, rest = streams.take_skip(streams.source(spark, src), "id", 7, at)
    assert (taken.count(), rest.count()) == (5, 0)
    spark.range(5, 20).write.mode("append").parquet(src)
    taken, rest = streams.take_skip(streams.source(spark, src), "id", 7, at)
    assert (taken.count(), rest.count()) == (7, 13)
    assert {r.id for r in taken.union(rest).collect()} == set(range(20))


def test_broken_versions_are_not_read(spark, tmp_path):
    src, at = str(tmp_path / "in"), f"file://{tmp_path}/work"
    spark.range(5).write.parquet(src)
    count = lambda: streams.run(streams.source(spark, src).groupBy().count(), "complete", at).first()[0]
    assert count() == 5
    (tmp_path / "work" / "out" / "v99").mkdir()  # a trigger that broke before its success mark
    assert count() == 5


def test_map_shuffle_interleave_and_rules(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(50).write.parquet(src)
    doubled = streams.run(streams.mapped(streams.source(spark, src), lambda pdf: pdf * 2, "id bigint"))
    assert sorted(r.id for r in doubled.collect()) == list(range(0, 100, 2))
    mixed = [r.id for r in streams.shuffled(streams.source(spark, src), "id", 3).orderBy("batch", "place", "id").collect()]
    assert sorted(mixed) == list(range(50)) and mixed != sorted(mixed)
    both = streams.run(streams.interleaved({"x": streams.source(spark, src), "y": streams.source(spark, src)}))
    assert {(r.stream, r["count"]) for r in both.groupBy("stream").count().collect()} == {("x", 50), ("y", 50)}
    for bad in ((True, None, None, 0.0), (True, 5, 10, 0.0), (True, 5, None, 0.1)):
        with pytest.raises(ValueError):
            streams.check_arguments(*bad)
    streams.check_arguments(True, 5, None, 100)
    streams.check_arguments(False, None, 10, 0.1)


def test_resumes_where_it_ended(spark, tmp_path):
    src, at = str(tmp_path / "in"), f"file://{tmp_path}/work"
    spark.range(5).write.parquet(src)
    out = streams.run(streams.source(spark, src), at=at)
    assert out.count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    assert sorted(r.id for r in streams.run(streams.source(spark, src), at=at).collect()) == list(range(8))


def test_held_out_share(spark):
    n = spark.range(10_000).where(streams.held_out(F.col("id"), 0.2, 7)).count()
    assert 1800 < n < 2200
