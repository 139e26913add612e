"""Problem 7: filling containers of fixed capacity along a space-filling curve.

Each document's pieces are hashed to a vector and projected to three dimensions; the place of the point on a
Hilbert curve orders the documents so that neighbours are alike. The documents are range-sorted by that key (equal
places by document, so a crowd of copies is divided like any other stretch), and each range is packed in one walk
along the curve: of ``NEIGHBOURS`` documents at a time the largest goes first, into the fullest open container that
still takes it. At most ``OPEN`` containers stay open, the fullest is closed first, so containers hold neighbours and
a walk's memory doesn't grow with its range.

Cases: only documents above the capacity are split, into full containers and a rest; documents without tokens
(NULL or empty texts) take no space and lie in a container their neighbours opened (one of their own where there is
none); rows with a NULL key are kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import PieceCounter, map_batches
from curata.plans.lineage import cut

#: Bits of a dimension of the curve; documents of a range (one task's walk, about).
BITS, RANGE_DOCS = 10, 20_000
#: Documents along the curve that are placed together, largest first, and containers that stay open.
NEIGHBOURS, OPEN = 64, 256


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (one row each), by Gray-code rotations of their bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work from the top bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            flip = np.where(high, p, 0)
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= flip ^ t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


class Measure:
    """Token counts and projections of texts; pieces seen before are looked up."""

    def __init__(self, name: str, folder: str | None, keep: int = 400_000):
        self.counter, self.keep = PieceCounter(name, folder, 0), keep
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, 4))

    def known(self, piece: str) -> int:
        k = self.number[piece] = len(self.number)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        h = zlib.crc32(piece.strip().lower().encode("utf-8", "replace"))
        # three signs by the piece's hash; numbers and signs say little about a text
        self.rows[k] = (self.counter[piece], *((2.0 * (h >> b & 1) - 1) * any(c.isalpha() for c in piece) for b in (3, 11, 19)))
        return k

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.keep:
            self.reset()
        get, known, find = self.number.get, self.known, self.counter.find
        flat: list[int] = []
        ends = []
        for t in texts:
            if t:
                flat += [k if (k := get(p)) is not None else known(p) for p in find(t)]
            ends.append(len(flat))
        total = np.concatenate([np.zeros((1, 4)), np.cumsum(self.rows[np.array(flat, np.int64)], 0)])
        sums = np.diff(total[np.array([0, *ends])], axis=0)
        scale = np.sqrt(np.maximum(np.diff([0, *ends]), 1))[:, None]
        point = np.clip((np.tanh(sums[:, 1:] / scale / 3) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
        return sums[:, 0].astype(np.int64), hilbert(point.astype(np.int64))


@lru_cache(2)
def _measure(name: str, folder: str | None) -> Measure:
    return Measure(name, folder)


def measured(docs: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """(doc_id, tokens, position on the curve) of each document; map-only."""

    def make():
        measure = _measure(name, folder)

        def work(part, texts):
            tokens, place = measure(texts)
            return {"doc_id": part.column("doc_id"), "tokens": tokens, "place": place}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id bigint, tokens bigint, place bigint", ("text",), make)


class Packer:
    """One plan's walk along the curve."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.open = capacity, 0, []  # open: (room left, container), the fullest first

    def place(self, sizes: list[int]) -> list[tuple[int, int, int, int]]:
        """(item, piece, container, tokens) of the next neighbours: largest first, into the fullest container that takes it."""
        out, rest, capacity, open_ = [], [], self.capacity, self.open
        for k, n in enumerate(sizes):
            piece = 0
            while n > capacity:
                out.append((k, piece, self.bins, capacity))
                self.bins, piece, n = self.bins + 1, piece + 1, n - capacity
            rest.append((-n, k, piece))
        for n, k, piece in sorted(rest):
            n = -n
            if n == 0 and self.bins:
                out.append((k, piece, self.bins - 1, 0))
                continue
            at = bisect_left(open_, (n, -1))
            if at < len(open_):
                room, b = open_.pop(at)
            else:
                room, b, self.bins = capacity, self.bins, self.bins + 1
            out.append((k, piece, b, n))
            if room > n:
                insort(open_, (room - n, b))
        del open_[: max(len(open_) - OPEN, 0)]
        return out


def along_the_curve(items: DataFrame) -> DataFrame:
    """The documents range-partitioned and sorted by their places on the curve, equal places by document."""
    ranges = max(1, -(-items.count() // RANGE_DOCS))
    return items.repartitionByRange(ranges, "place", "doc_id").sortWithinPartitions("place", "doc_id", "tokens")


def packed(docs: DataFrame, plans: DataFrame, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(plan_id, capacity_tokens, container, doc_id, piece, tokens): each document's place in each plan."""
    capacities = sorted({(r.plan_id, r.capacity_tokens) for r in plans.where("capacity_tokens > 0").limit(1001).collect()})
    if len(capacities) > 1000:
        raise ValueError("more than 1000 plans; pass them in parts")
    items = cut(measured(docs, name, folder))  # three numbers a document: the texts are read once
    return walked(along_the_curve(items), capacities)


def walked(ranges: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Pack each range in the order it comes in."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packers = [(plan, capacity, Packer(capacity)) for plan, capacity in capacities]
        for batch in batches:
            frames = []
            for a in range(0, len(batch), NEIGHBOURS):
                near = batch.iloc[a : a + NEIGHBOURS]
                ids, sizes = near["doc_id"].to_numpy(), near["tokens"].tolist()
                for plan, capacity, packer in packers:
                    rows = np.array(packer.place(sizes), np.int64).reshape(-1, 4)
                    frames.append((plan, capacity, rows, ids[rows[:, 0]]))
            if frames:
                n = [len(rows) for _, _, rows, _ in frames]
                rows = np.concatenate([rows for _, _, rows, _ in frames])
                yield pd.DataFrame({
                    "plan_id": np.repeat([p for p, _, _, _ in frames], n), "capacity_tokens": np.repeat([c for _, c, _, _ in frames], n), "part": part, "bin": rows[:, 2],
                    "doc_id": np.concatenate([i for _, _, _, i in frames]), "piece": rows[:, 1], "tokens": rows[:, 3],
                })

    out = ranges.mapInPandas(walk, "plan_id int, capacity_tokens bigint, part bigint, bin bigint, doc_id bigint, piece int, tokens bigint")
    return out.select("plan_id", "capacity_tokens", F.concat_ws("-", "part", "bin").alias("container"), "doc_id", "piece", "tokens")


def fill(packing: DataFrame) -> DataFrame:
    """(plan_id, capacity_tokens, n_docs, n_split, n_containers, tokens, fill_share) of each plan."""
    bins = packing.groupBy("plan_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("t"), F.sum((F.col("piece") == 0).cast("bigint")).alias("d"), F.sum((F.col("piece") == 1).cast("bigint")).alias("s"))
    return bins.groupBy("plan_id", "capacity_tokens").agg(F.sum("d").alias("n_docs"), F.sum("s").alias("n_split"), F.count("*").alias("n_containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * F.col("capacity_tokens"))).alias("fill_share"))
