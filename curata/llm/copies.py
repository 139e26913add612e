"""Problem 2: records that are copies of each other apart from formatting, by dictionary-encoded columns.

Each field's distinct values are canonicalised once and numbered; a record becomes the sorted tuple of its
field-value numbers, and equal tuples are copies. All fields of a record count, nested ones by their path, unless the
caller names the compared ones or some to leave out. The dictionary is built by two aggregations (distinct values,
distinct canonical values); numbers are bucket and rank within the bucket, so they are the same in every run and no
task sees more than its bucket. Values shared by very many records, and canonical values of very many forms, reach
their rows by broadcast (their number is bounded, see ``curata.plans.skew``), all others by shuffle; groups of copies
are only ever aggregated.

Cases: NULL, empty and missing fields are equal; a record that is no JSON object is compared by its whole
text; NULL records are all equal; rows with a NULL key are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.plans.lineage import cut
from curata.plans.skew import dictionary_join, hot_limit
from curata.plans.spread import spread

#: Buckets of the numbering: ranks are taken within one, and with 65,536 a bucket of 10^10 values has 150,000.
BUCKETS = 65_536
#: Objects inside objects are taken apart down to this depth; what lies deeper is one value, its text.
DEPTH = 4
#: The field of a record that is no object.
WHOLE = "\u0003"


def canonical(col: Column) -> Column:
    """The content of a value: letters, digits, and the signs of formulas.

    Case, white space, and punctuation and quote marks of prose go. Stays: decimal points and grouping signs
    between digits, a gap between two digits, and + - * = / ^ < > % of formulas (a hyphen or stroke between
    two words is prose, and so are a dash and doubled asterisks).
    """
    signs, plain, unseen = "０１２３４５６７８９＋＝＊．−‐‑_", "0123456789+=*.--- ", "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
    c = F.replace(F.lower(F.translate(col, signs + unseen, plain)), F.lit("ß"), F.lit("ss"))  # upper case has two letters for it
    c = F.when(F.contains(c, F.lit("**")), F.regexp_replace(c, "\\*\\*+", " ")).otherwise(c)
    steps = (
        ("(?<=\\p{N})\\.(?=\\p{N})", "\u0001"),
        ("(?<=\\p{N}),(?=\\p{N})", "\u0002"),
        ("(?<=\\p{L}{2})[-/](?=\\p{L}{2})", " "),
        ("[^\\p{L}\\p{M}\\p{N}+*=/^<>%\u0001\u0002-]+", " "),
        # a gap counts between two digits only
        ("(?<!\\p{N}) +| +(?!\\p{N})", ""),
    )
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def schema_of(paths: Sequence[str]) -> T.StructType:
    """The schema of a record with these paths, each value as its text."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})
    make = lambda node: T.StructType([T.StructField(k, make(v) if v else T.StringType()) for k, v in node.items()])
    return make(tree)


def cells(raw: DataFrame, id_col: str, record_col: str, fields: Sequence[str] | None = None, ignored: Sequence[str] = ()) -> DataFrame:
    """(``id_col``, cells): the (field, value) pairs of each record, nested fields by their path; empty values are left out.

    ``fields`` are the paths that count, in place of all but ``ignored``; a record is then read by their schema at once.
    """
    rows = raw.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), F.col(record_col).alias("t"))
    whole = F.array(F.struct(F.lit(WHOLE).alias("field"), F.coalesce("t", F.lit("")).alias("v")))
    if fields is not None:
        schema = T.StructType([*schema_of(fields).fields, T.StructField("_bad", T.StringType())])
        d = rows.select(id_col, "t", F.from_json("t", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
        bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
        pairs = F.array(*(F.struct(F.lit(p).alias("field"), F.coalesce(f"r.{p}", F.lit("")).alias("v")) for p in fields))
        return d.select(id_col, F.when(bad, whole).otherwise(F.filter(pairs, lambda c: c["v"] != "")).alias("cells"))
    is_object = lambda c: c.rlike(r"^\s*\{")
    entries = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
    top = rows.select(id_col, "t", F.when(is_object(F.col("t")), entries(F.col("t"))).alias("m"))
    d = top.select(id_col, "t", F.transform("m", lambda e: F.struct(e["key"].alias("field"), e["value"].alias("v"))).alias("cells"))
    for _ in range(DEPTH):

        def open_(c: Column) -> Column:
            inner = F.when(is_object(c["v"]), entries(c["v"]))
            return F.coalesce(F.transform(inner, lambda e: F.struct(F.concat(c["field"], F.lit("."), e["key"]).alias("field"), e["value"].alias("v"))), F.array(c))

        d = d.select(id_col, "t", F.flatten(F.transform("cells", open_)).alias("cells"))
    kept = F.filter("cells", lambda c: ~c["field"].isin(list(ignored)) & (F.coalesce(c["v"], F.lit("")) != ""))
    return d.select(id_col, F.coalesce(kept, whole).alias("cells"))


def value_hash(*cols: Column) -> list[Column]:
    """128 bits of a value as two integers, to join by in place of the text."""
    return [F.xxhash64(F.lit(k), *cols) for k in (1, 2)]


def dictionary(records: DataFrame) -> DataFrame:
    """(a, b, freq, n): the number of each distinct (field, raw value), by its hash, and its frequency; values of no content have none."""
    # outer: for a plain explode the optimizer would put a filter on the cells below it, and parse each record once more for that
    values = records.select(F.explode_outer("cells").alias("c")).select("c.*").where("field IS NOT NULL").groupBy("field", "v").agg(F.count("*").alias("freq"))
    content = canonical(F.col("v"))
    a, b = value_hash(F.col("field"), F.col("v"))
    values = values.select(a.alias("a"), b.alias("b"), "freq", "field", content.alias("c"))
    ca, cb = value_hash(F.col("field"), F.col("c"))
    # written down: else the numbering below would canonicalise again, and each record's value at that; a filter before would, too
    values = cut(values.select("a", "b", "freq", ca.alias("ca"), cb.alias("cb"), (F.col("c") == "").alias("none"))).where("NOT none").drop("none")
    numbered = values.groupBy("ca", "cb").agg(F.count("*").alias("forms")).withColumn("bucket", F.pmod("ca", F.lit(BUCKETS)))
    # rank within the bucket: the numbers are dense there and the same in every run
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("ca", "cb"))
    numbered = numbered.select("ca", "cb", "forms", (F.col("bucket") * F.lit(1 << 40) + rank).alias("n"))
    return cut(dictionary_join(values, numbered, ["ca", "cb"], "forms", hot_limit(values.count())).select("a", "b", "freq", "n"))


def encoded(records: DataFrame, id_col: str) -> DataFrame:
    """(``id_col``, code): the record as its sorted tuple of field-value integers.

    The texts are read twice, for the dictionary and for the records' hashes; both are written down compactly.
    """
    entries = dictionary(records)
    pair = lambda c: F.struct(*(h.alias(k) for h, k in zip(value_hash(c["field"], c["v"]), "ab")))
    hashed = cut(records.select(id_col, F.transform("cells", pair).alias("h")))
    single = hashed.select(id_col, F.explode("h").alias("p")).select(id_col, "p.a", "p.b")
    joined = dictionary_join(single, entries, ["a", "b"], "freq", hot_limit(hashed.count()))
    # a NULL of each record beside its numbers, so that records without any content have a tuple too
    numbers = joined.select(id_col, "n").unionByName(hashed.select(id_col, F.lit(None).cast("bigint").alias("n")))
    return numbers.groupBy(id_col).agg(F.array_sort(F.collect_list("n")).alias("code"))


def groups(raw: DataFrame, id_col: str, record_col: str, fields: Sequence[str] | None = None, ignored: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Encoded records, and (code, keep, n) of each group of copies; n = 1 where a record has none."""
    codes = cut(encoded(cells(spread(raw), id_col, record_col, fields, ignored), id_col))
    return codes, codes.groupBy("code").agg(F.min(id_col).alias("keep"), F.count("*").alias("n"))


def copies(raw: DataFrame, id_col: str, record_col: str, fields: Sequence[str] | None = None, ignored: Sequence[str] = ()) -> DataFrame:
    """(keep, copy): each record that repeats another, with the smallest key of its group."""
    codes, kept = groups(raw, id_col, record_col, fields, ignored)
    several = kept.where("n > 1")
    rows = dictionary_join(codes, several, ["code"], "n", hot_limit(codes.count()))
    return rows.where(F.col(id_col) != F.col("keep")).select("keep", F.col(id_col).alias("copy"))
