"""Pieces shared by the training-data operators: batches, label clean-up, tokenizers."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.plans.spread import spread

#: The languages of the corpus.
LANGS = ("en", "zh", "fr", "de", "es", "pt", "ru")
#: The folder of the public tokenizer files, unless a caller names another.
TOKENIZERS = os.environ.get("CURATA_TOKENIZERS", "/opt/tokenizers")
#: Texts of a batch together hold at most about so many characters, so that one worker's arrays stay small.
CHUNK_CHARS = 2_000_000


def source_key(col: Column) -> Column:
    """One spelling of a source name: lower case, runs of other signs as one underscore; NULL stays NULL."""
    k = F.regexp_replace(F.lower(col), "[^\\p{L}\\p{N}]+", "_")
    k = F.regexp_replace(k, "^_+|_+$", "")
    return F.when(k != "", k)


def lang_label(col: Column, langs: tuple[str, ...] = LANGS) -> Column:
    """A delivered label as its two-letter language, without region or script; NULL where it names none of ``langs``."""
    k = F.regexp_extract(F.lower(F.trim(col)), "^([a-z]{2})(?:[-_][a-z0-9_-]+)?$", 1)
    return F.when(k.isin(*langs), k)


def chunks(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Slices of a batch by the size of its text columns, with these as lists of Python strings (None for NULL)."""
    n = batch.num_rows
    if not n:
        return
    size = sum((np.asarray(pc.fill_null(pc.binary_length(batch.column(x)), 0)).astype(np.int64) for x in names), np.zeros(n, np.int64))
    cut = np.concatenate([[0], np.cumsum(size + 16)]) // CHUNK_CHARS
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cut[:-1])) + 1, [n]])
    for a, b in zip(starts[:-1], starts[1:]):
        part = batch.slice(a, b - a)
        yield part, [part.column(x).to_pylist() for x in names]


#: A sampled text is at most so long (others are left to their like), and a sample's texts together about so long.
LONGEST_SAMPLED, SAMPLE_CHARS = 200_000, 4_000_000


def sample_limits(df: DataFrame, stratum: Column, text: Column, rows: int, chars: int = SAMPLE_CHARS) -> dict:
    """Of each stratum (NULL aside) the share of ``sample_hash`` that gives about ``rows`` texts of together about ``chars`` characters at most."""
    size = df.where(stratum.isNotNull() & text.isNotNull()).groupBy(stratum.alias("k")).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("c"))
    return {r.k: min(1.0, rows / r.n, chars / max(r.c, 1)) for r in size.collect()}


def sampled(key: Column, text: Column, share: Column) -> Column:
    """Whether a row is in a sample of this share, by a hash of its key; fine enough for 10^15 rows."""
    # 53 bits, so that the smallest share of the largest table is still some hashes
    return (F.shiftrightunsigned(F.xxhash64(key), 11) < (share * F.lit(float(1 << 53))).cast("bigint")) & (F.length(text) <= LONGEST_SAMPLED)


def map_batches(df: DataFrame, schema: str, texts: tuple[str, ...], make: Callable[[], Callable[..., dict[str, Iterable]]]) -> DataFrame:
    """``mapInArrow`` over bounded slices of texts.

    ``make`` runs once per task and gives the function of a slice: it gets the slice and the lists of its
    text columns and returns the output columns by name, in the order of ``schema``.
    """
    arrow = pa.schema([(k, _ARROW[t]) for k, t in (x.strip().split(" ") for x in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part, lists in chunks(batch, *texts):
                cols = work(part, *lists)
                out = pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)
                if out.num_rows:
                    yield out

    return spread(df).mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


class PieceCounter(dict):
    """Exact token counts of a public byte-level BPE vocabulary, with the counts of pieces kept.

    Byte-level BPE merges inside the pieces of its split pattern only, so a text's count is the sum of its
    pieces' counts, and a piece seen before needs no merging.
    """

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None, keep: int = 400_000):
        super().__init__()
        import regex
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's split pattern
        with open(os.path.join(folder or TOKENIZERS, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.keep = keep

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < self.keep and len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.find(text))) if text else 0


def document_tokens(docs: DataFrame, carry: list[str], name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """``carry`` columns, then ``tokens``: exact tokens of ``text`` (NULL and empty texts have none).

    ``carry`` are bigint and string columns. The pass is map-only and reads whole texts.
    """
    types = dict(docs.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in carry] + ["tokens bigint"])

    def make():
        counter = PieceCounter(name, folder)

        def work(part, texts):
            return {c: part.column(c) for c in carry} | {"tokens": [counter.count(t) for t in texts]}

        return work

    return map_batches(docs.select(*carry, "text"), schema, ("text",), make)


#: Code blocks (also unclosed), inline code, formulas, boxes, tags and addresses: no prose. Never runs past the sign 29 between two texts.
NOT_PROSE = re.compile(
    r"```[^\x1d]*?(?:```|(?=\x1d)|\Z)|`[^`\n\x1d]*`|\$\$[^$\x1d]*\$\$|\$[^$\n\x1d]*\$|\\\[[^\x1d]*?\\\]|\\\([^\x1d]*?\\\)"
    r"|\\boxed\{[^{}\n\x1d]*(?:\{[^{}\n\x1d]*\}[^{}\n\x1d]*)*\}?|\\[a-zA-Z]+|</?[a-zA-Z][^<>\n\x1d]*>|https?://\S+"
)
