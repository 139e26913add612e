"""Sources: registered data sets, delivered files, logs, transcripts. Sinks: subsets with fingerprints, predictions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.sources import files

#: Formats by file extension.
FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "orc": "orc", "arrow": "arrow", "txt": "text"}


#: Where an entry's data may come from, the first that is named wins; and parts of an entry that go with one format only.
PRECEDENCE = ("hub", "script", "cloud", "file")
STAGES = ("pretraining", "supervised", "preference", "rated")


@dataclass
class Dataset:
    """An entry of the registry: where a data set lies and which columns play which part."""

    name: str
    path: str
    formatting: str = "instruction"
    columns: dict[str, str | None] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    ranking: bool = False
    num_samples: int | None = None
    split: str = "train"
    origin: str = "file"

    def __post_init__(self):
        if self.formatting not in ("instruction", "chat"):
            raise ValueError(f"unknown formatting {self.formatting}")
        if self.num_samples is not None and self.num_samples < 1:
            raise ValueError("num_samples must be positive")
        if self.origin not in PRECEDENCE:
            raise ValueError(f"unknown origin {self.origin}")

    def role(self, part: str) -> str | None:
        """The column of a part. With ``columns`` given, parts it doesn't list have none, defaults included."""
        defaults = {"prompt": "instruction", "query": "input", "response": "output", "messages": "conversations"}
        return self.columns.get(part) if self.columns else defaults.get(part)


@dataclass(frozen=True)
class DataArguments:
    """What a run asks of its data; combinations that make no sense are errors."""

    datasets: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    strategy: str = "concat"
    cutoff: int = 2048
    validation: float = 0.0
    validation_sets: tuple[str, ...] = ()
    streaming: bool = False
    max_steps: int | None = None
    max_samples: int | None = None
    packing: bool = False
    mask_history: bool = False
    train_on_prompt: bool = False
    stage: str = "supervised"

    def __post_init__(self):
        from curata.streaming.streams import check_arguments

        rules = {
            "the strategy must be concat or interleave": self.strategy in ("concat", "interleave"),
            "weights are for interleaving": not self.weights or self.strategy == "interleave",
            "there must be as many weights as data sets": not self.weights or len(self.weights) == len(self.datasets),
            "the cutoff must be positive": self.cutoff > 0,
            "the validation size must not be negative": self.validation >= 0,
            "a validation size needs data sets": not self.validation or bool(self.datasets),
            "give a validation size or validation sets, not both": not (self.validation and self.validation_sets),
            "max_samples must be positive": self.max_samples is None or self.max_samples > 0,
            "mask_history and train_on_prompt exclude each other": not (self.mask_history and self.train_on_prompt),
            "unknown stage": self.stage in STAGES,
            "packing is for pretraining and supervised data": not self.packing or self.stage in STAGES[:2],
        }
        for message, holds in rules.items():
            if not holds:
                raise ValueError(message)
        check_arguments(self.streaming, self.max_steps, self.max_samples, self.validation)


class Registry:
    """Data sets by name, kept in a JSON file; with a session, in any file system it knows."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark or SparkSession.getActiveSession()

    def entries(self) -> dict[str, dict]:
        text = files.read_text(self.spark, self.path)
        return json.loads(text) if text else {}

    def get(self, name: str) -> Dataset:
        e = self.entries()
        if name not in e:
            raise KeyError(f"undefined data set {name}")
        return Dataset(name=name, **e[name])

    def put(self, d: Dataset) -> None:
        """Add or replace an entry; the file is replaced as a whole."""
        e = self.entries() | {d.name: {k: v for k, v in d.__dict__.items() if k != "name"}}
        files.write_text(self.spark, self.path, json.dumps(e, indent=1, ensure_ascii=False))


def resolved(name: str, entry: dict, folder: str, online: bool = False) -> Dataset:
    """The data set of an entry that names several places: hub before script before cloud before file.

    Hubs need a network and are an error here unless the caller is ``online``; a file's name is below the registry's folder, a cloud's is whole.
    """
    places = [k for k in PRECEDENCE if entry.get(k)]
    if not places:
        raise ValueError(f"data set {name} names no place")
    origin = places[0]
    if origin == "hub" and not online:
        if len(places) == 1:
            raise ValueError(f"data set {name} lies on a hub")
        origin = places[1]
    if origin == "cloud" and not entry["cloud"].startswith(tuple(f"{s}://" for s in files.CLOUD)):
        raise ValueError(f"{entry['cloud']} is no cloud path")
    path = entry[origin] if origin in ("hub", "cloud") else f"{folder}/{entry[origin]}"
    return Dataset(name, path, origin=origin, **{k: v for k, v in entry.items() if k not in PRECEDENCE})


def merged(parts: dict[str, tuple[Dataset, DataFrame]], stage: str, merge: bool = True) -> DataFrame | dict[str, DataFrame]:
    """The aligned data sets of a run as one, or by name; ranking data goes with preference training only, and other data with the rest."""
    from curata.operators.relational import unions

    for name, (d, _) in parts.items():
        if d.ranking != (stage == "preference"):
            raise ValueError(f"data set {name} doesn't go with {stage} training")
    return unions([df for _, df in parts.values()]) if merge else {k: df for k, (_, df) in parts.items()}


def extension_of(paths: list[str]) -> str:
    """The one extension of all files; anything else is an error."""
    kinds = {p.rsplit(".", 1)[-1].lower() for p in paths}
    if len(kinds) != 1 or (kind := kinds.pop()) not in FORMATS:
        raise ValueError("file types should be identical and known")
    return kind


def arrow_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow files as a table: each is opened where it is read, the driver sees a schema only."""
    from pyspark.sql.pandas.types import from_arrow_schema

    content = spark.read.format("binaryFile").load(paths).select("content")

    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0):
                yield pa.RecordBatch.from_pydict({"s": [pa.ipc.open_file(c.as_buffer()).schema.serialize().to_pybytes()]})

    schema = pa.ipc.read_schema(pa.py_buffer(content.limit(1).mapInArrow(schemas, "s binary").first().s))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0):
                yield from pa.ipc.open_file(c.as_buffer()).read_all().cast(schema).to_batches()

    return content.mapInArrow(rows, from_arrow_schema(schema))


def load(spark: SparkSession, d: Dataset, schema: T.StructType | str | None = None) -> DataFrame:
    """A registered data set: a file or a folder of files of one kind, in any file system Hadoop knows; ``num_samples`` caps it by position."""
    paths = files.listed(spark, d.path)
    kind = extension_of(paths)
    if kind == "arrow":
        return arrow_tables(spark, paths)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json" and any(p.endswith(".json") for p in paths):
        reader = reader.option("multiLine", True)
    if kind == "csv":
        reader = reader.option("header", schema is None)
    return reader.format(FORMATS[kind]).load(paths)


def first_samples(df: DataFrame, order: str, most: int | None) -> DataFrame:
    """At most ``most`` rows, by position."""
    return df if most is None else df.where(F.col(order) < most)


def positions(df: DataFrame, groups: list[str], name: str = "i") -> DataFrame:
    """Add the place (from 0) of each row of files in its group: files by name, lines as they stand."""
    w = Window.partitionBy(*groups).orderBy("__file", "__block", "__at")
    d = df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    return d.withColumn(name, (F.row_number().over(w) - 1).cast("bigint")).drop("__file", "__block", "__at")


def benchmark_questions(spark: SparkSession, path: str, prefix: str = "", keys: tuple[str, ...] = ("question", "problem", "Question", "input")) -> DataFrame:
    """(bench, i, question) of all benchmarks of a folder or glob of JSON lines; a bench is a file's name, after a prefix.

    The text is that of the first key with one, trimmed. A bench is small, so its places are counted in one task.
    """
    raw = spark.read.json(path)
    d = raw.select("*", F.concat(F.lit(prefix), F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:/part-[^/]*)?\.jsonl?(?:/part-[^/]*)?$", 1)).alias("bench"))
    there = [F.col(k).cast("string") for k in keys if k in raw.columns]
    return positions(d, ["bench"]).select("bench", "i", F.trim(F.coalesce(*there)).alias("question"))


def run_results(spark: SparkSession, root: str, benches: list[str], schema: str) -> DataFrame:
    """Rows of ``root/<run>/<bench>*.jsonl`` with (run, bench, file): of several files of a bench the last by name."""
    d = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root).select("*", F.col("_metadata.file_path").alias("file"))
    named = r"([^/]+)/(" + "|".join(benches) + r")[^/]*\.jsonl$"
    d = d.withColumns({"run": F.regexp_extract("file", named, 1), "bench": F.regexp_extract("file", named, 2)}).where("bench <> ''")
    last = d.groupBy("run", "bench").agg(F.max("file").alias("file"))  # as many rows as files
    return d.join(F.broadcast(last), ["run", "bench", "file"])


def save_predictions(df: DataFrame, prompt: str, predict: str, label: str, path: str) -> None:
    """Predictions as JSON lines of (prompt, predict, label); missing ones are empty."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((prompt, "prompt"), (predict, "predict"), (label, "label")))).write.mode("overwrite").json(path)


def save_report(df: DataFrame, path: str, digits: int = 3) -> str:
    """A small table as CSV and Markdown beside each other; returns the Markdown."""
    text = markdown(df, digits)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    files.write_text(df.sparkSession, f"{path}/report.md", text + "\n")
    return text


def gathered(source: DataFrame, key: str, ids: DataFrame, position: str) -> DataFrame:
    """The rows of a list of keys, in its order: (``position``, the source's columns); a key listed twice comes twice, one without a row is an error at once."""
    wanted = ids.select(key, position)
    missing = wanted.join(source.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"keys without a row, such as {[r[key] for r in missing]}")
    return wanted.join(source, key).select(position, *source.columns).orderBy(position)


def media_paths(paths: Column, folder: str) -> Column:
    """Media names below a folder, unless they are whole paths or addresses. Whether files exist is the reader's matter, where they are opened."""
    return F.transform(paths, lambda p: F.when(p.rlike(r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*://)"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)))


def changed_settings(before: str, after: str) -> dict[str, tuple[str | None, str | None]]:
    """The keys on which two configurations differ, with both values; None where one has none."""
    a, b = settings(before), settings(after)
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def settings(text: str) -> dict[str, str]:
    """``key: value`` lines of a configuration without comments and blank lines; the first colon divides."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if ":" in line:
            k, _, v = line.partition(":")
            out[k.strip()] = v.strip()
    return out


def json_lines(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line is fatal, or dropped if not strict."""
    r = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (r.schema(schema) if schema else r).json(path)


def questions(df: DataFrame, keys: tuple[str, ...] = ("question", "problem", "Question", "input")) -> DataFrame:
    """A benchmark's rows with ``question`` from the first key that has one, and ``gold`` as text."""
    there = [F.col(k).cast("string") for k in keys if k in df.columns]
    gold = F.col("answer").cast("string") if "answer" in df.columns else F.lit(None).cast("string")
    return df.select(F.trim(F.coalesce(*there)).alias("question"), gold.alias("gold"), *[c for c in df.columns if c not in (*keys, "answer")])


def multiple_choice(spark: SparkSession, path: str) -> DataFrame:
    """Headerless question,A,B,C,D,answer files; the subject is the file's name."""
    schema = ", ".join(f"{c} string" for c in ("question", "A", "B", "C", "D", "answer"))
    return spark.read.schema(schema).csv(path).withColumn("subject", F.regexp_extract(F.input_file_name(), "([^/]+)\\.csv$", 1))


def log_scores(spark: SparkSession, path: str) -> DataFrame:
    """(file, acc, pass1): the last ``Acc:`` and ``Pass@1:`` of each log; logs without both are left out."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    last = lambda p: F.try_element_at(F.regexp_extract_all("value", F.lit(p), F.lit(1)), F.lit(-1)).try_cast("double")
    d = t.select("file", last(r"(?m)^Acc: *([0-9.]+)").alias("acc"), last(r"(?m)^Pass@1:.*= *([0-9.]+)").alias("pass1"))
    return d.where("acc IS NOT NULL AND pass1 IS NOT NULL")


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of parts in which a key's row comes from the first part that has it."""
    from curata.operators.relational import best_per_key, unions

    d = unions([p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)])
    return best_per_key(d, [key], [F.col("__part")]).drop("__part")


def transcript_turns(df: DataFrame, key: str, text: str, speaker: str = "[A-Z][a-z]+") -> DataFrame:
    """(key, turn, speaker, content): turns of ``Name: words`` transcripts, a name starting a line."""
    parts = F.filter(F.split(F.col(text), f"(?m)(?=^{speaker}: )"), lambda x: x.rlike(f"^{speaker}: "))
    t = df.select(key, F.posexplode(parts).alias("turn", "x"))
    return t.select(key, "turn", F.substring_index("x", ": ", 1).alias("speaker"), F.regexp_replace(F.regexp_replace("x", f"^{speaker}: ", ""), "^\\s+|\\s+$", "").alias("content"))


def embedded_turns(text: Column, human: str = "Human:", assistant: str = "Assistant:") -> Column:
    """The turns of a transcript written into one text, wherever its marks stand: (role, content) from the first mark on, trimmed; none without a mark."""
    marks = "|".join(re.escape(m) for m in (human, assistant))
    parts = F.filter(F.split(text, f"(?={marks})"), lambda x: x.rlike(f"^({marks})"))
    content = lambda x: F.regexp_replace(F.regexp_replace(x, f"^({marks})", ""), r"^\s+|\s+$", "")
    return F.transform(parts, lambda x: F.struct(F.when(x.startswith(human), "user").otherwise("assistant").alias("role"), content(x).alias("content")))


def alternating(values: Column) -> Column:
    """A list of texts as user and assistant turns; an odd last one is dropped, fewer than two give NULL."""
    even = F.size(values) - F.size(values) % 2
    turns = F.transform(F.slice(values, F.lit(1), even), lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")))
    return F.when(F.size(values) >= 2, turns)


def preference_transcripts(df: DataFrame, key: str, chosen: str, rejected: str, human: str = "\n\nHuman: ", assistant: str = "\n\nAssistant: ") -> DataFrame:
    """(key, instruction, chosen, rejected, history): two transcripts that differ in their last answer, taken apart.

    The last answers are what follows the last assistant mark; the instruction is the human turn before it, and
    earlier pairs are the history. Rows without both marks are left out.
    """
    last = F.substring_index(F.col(chosen), assistant, -1)
    before = F.expr(f"substring(`{chosen}`, 1, length(`{chosen}`) - length(substring_index(`{chosen}`, '{assistant.encode('unicode_escape').decode()}', -1)) - {len(assistant)})")
    turns = F.filter(F.split(before, human.encode("unicode_escape").decode()), lambda x: F.trim(x) != "")
    pair = lambda t: F.array(F.trim(F.substring_index(t, assistant, 1)), F.trim(F.substring_index(t, assistant, -1)))
    history = F.transform(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))), pair)
    d = df.where(F.contains(chosen, F.lit(assistant)) & F.contains(rejected, F.lit(assistant)))
    return d.select(key, F.trim(F.element_at(turns, -1)).alias("instruction"), F.trim(last).alias("chosen"), F.trim(F.substring_index(F.col(rejected), assistant, -1)).alias("rejected"), history.alias("history"))


def benchmark_sample(parts: list[DataFrame], key: str, n: int, seed: int) -> DataFrame:
    """Sub-tasks of a benchmark as one table, without rows of several answers, at most n rows in seeded order."""
    from curata.operators.relational import uniform_sample, unions

    d = unions(parts)
    if "answer" in d.columns:
        d = d.where(~F.coalesce(F.contains(F.col("answer").cast("string"), F.lit(";")), F.lit(False)))
    return uniform_sample(d, key, n, seed)


def page(df: DataFrame, order: str, index: int, size: int = 2) -> DataFrame:
    """One page of a table in a total order."""
    return df.orderBy(order).offset(index * size).limit(size)


#: Ranges of keys whose digests make up a fingerprint.
DIGESTS = 4096


def fingerprint(df: DataFrame, key: str) -> tuple[int, int, str]:
    """(rows, distinct keys, SHA-256) of a set of keys; a task sees a bucket of them, the driver ``DIGESTS`` digests.

    Each bucket's digest is that of its sorted keys joined by commas, and the fingerprint is the digest of these in order.
    """
    k = df.select(F.col(key).cast("string").alias("k"))
    by = k.groupBy(F.pmod(F.xxhash64("k"), F.lit(DIGESTS)).alias("b")).agg(F.count("*").alias("n"), F.count_distinct("k").alias("d"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("f"))
    rows = sorted(by.collect())
    import hashlib

    return sum(r.n for r in rows), sum(r.d for r in rows), hashlib.sha256("".join(f"{r.b}:{r.f};" for r in rows).encode()).hexdigest()


def write_subset(df: DataFrame, key: str, n: int, folder: str, order: str | None = None) -> str:
    """Write exactly n distinct rows, in a given order, with a fingerprint of their keys and their list; returns the fingerprint."""
    rows, distinct, told = fingerprint(df, key)
    if rows != n or distinct != n:
        raise ValueError(f"{rows} rows with {distinct} keys, not {n}")
    (df.orderBy(order) if order else df).write.mode("errorifexists").json(f"{folder}/data")
    df.select(key).write.csv(f"{folder}/keys")
    files.write_text(df.sparkSession, f"{folder}/meta.json", json.dumps({"n": n, "key": key, "keys_sha256": told}))
    return told


def read_subset(spark: SparkSession, source: DataFrame, key: str, folder: str) -> DataFrame:
    """The rows of a written subset from their source, after checking the keys' fingerprint."""
    meta = json.loads(files.read_text(spark, f"{folder}/meta.json"))
    keys = spark.read.schema(f"{key} {dict(source.dtypes)[key]}").csv(f"{folder}/keys")
    if fingerprint(keys, key)[2] != meta["keys_sha256"]:
        raise ValueError("the keys don't match their fingerprint")
    return source.join(keys, key, "left_semi")


def markdown(df: DataFrame, digits: int = 3, rows: int = 1000) -> str:
    """A small table as Markdown; larger ones are an error, since the rows come to the driver."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in got)])
