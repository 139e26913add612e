"""Each core query against the SQL that states it, on the smallest tables."""

import glob
import math
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from curata.plans import catalog


def plain(v):
    if v is None or isinstance(v, float | np.floating) and math.isnan(v):
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return [plain(x) for x in v]
    if isinstance(v, bool | np.bool_):
        return bool(v)
    return float(v) if isinstance(v, float | np.floating) else int(v) if isinstance(v, np.integer) else v


@pytest.fixture(scope="module")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, folder, duck, name):
    df = catalog.QUERIES[name](spark, folder)
    got = df.collect()
    want = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    a = sorted(str([plain(r[c]) for c in order]) for r in got)
    b = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0


def test_entry(spark, folder):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_do_not_matter(spark, folder):
    names = ["random_subset", "topic_quotas", "one_per_prompt", "interleaved_sources"]
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(str, catalog.QUERIES[x](spark, folder).collect())) for x in names])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
