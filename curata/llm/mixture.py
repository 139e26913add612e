"""Problem 8: mixing sources to target weights, by Sainte-Laguë apportionment of equal token blocks.

The mix is as large as the scarcest source allows (its tokens times its repeats, over its share). Blocks of equal
size go to the sources by highest quotients, a source's blocks to groups of its shards and a group's blocks to its
shards likewise, by their tokens: an integer quota for each shard. A shard's documents, in seeded order, are a tape
of blocks; whole passes take all of it, and a last part of a pass takes a run of blocks from a seeded start. A
document belongs to a run if its middle lies in it, so long and short documents have the same chance. Of ``STARTS``
seeded starts the one counts whose documents' tokens come nearest to the quota.

Shards split every source, so none is gathered anywhere; their number grows with the source, and the driver sees at
most ``GROUPS`` groups of shards a source.

Cases: sources are compared in one spelling, and targets of one source in several spellings are added up (the
smallest of their repeats holds); documents without tokens, without a source or of a source without target aren't in
the mix; a target without documents gets no blocks, and the report shows it; no document is used more than
``max_repeats`` times.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import document_tokens, source_key
from curata.plans.lineage import cut

#: Tokens of a block; documents of a shard (about), groups of shards of a source, starts that are tried in a shard.
BLOCK, SHARD_DOCS, GROUPS, STARTS = 2048, 20_000, 4096, 32


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 got + 1); the first of equal ones wins.

    The start from the rounded shares leaves at most one seat a weight to settle, whatever ``seats`` is.
    """
    total = sum(weights)
    if seats <= 0 or total <= 0:
        return [0] * len(weights)
    got = [int(max(0.0, w * seats / total - 0.5)) for w in weights]
    heap = [(-w / (2 * g + 1), k) for k, (w, g) in enumerate(zip(weights, got)) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    while True:  # give back what a higher quotient claims
        low = min((k for k in range(len(got)) if got[k]), key=lambda k: (weights[k] / (2 * got[k] - 1), -k))
        high = max(range(len(got)), key=lambda k: (weights[k] / (2 * got[k] + 1), -k))
        if weights[high] / (2 * got[high] + 1) <= weights[low] / (2 * got[low] - 1) * (1 + 1e-12):
            return got
        got[low] -= 1
        got[high] += 1


def quotas(targets: list[tuple[str, float, int]], supply: dict[str, dict[int, int]]) -> list[tuple[str, int, int, int]]:
    """(source, group, tokens of the group, quota in blocks) from (source, share, repeats) and tokens by group of shards."""
    have = {s: sum(supply.get(s, {}).values()) for s, _, _ in targets}
    live = [(s, w, r) for s, w, r in targets if have[s] > 0 and w > 0 and r > 0]
    if not live:
        return []
    every = sum(w for _, w, _ in live)
    total = min(have[s] * r * every / w for s, w, r in live)
    blocks = int(total / BLOCK)
    out = []
    for (s, _, r), n in zip(live, sainte_lague([w for _, w, _ in live], blocks)):
        groups = sorted(supply[s].items())
        out += [(s, k, t, q) for (k, t), q in zip(groups, sainte_lague([float(t) for _, t in groups], min(n, int(have[s] * r / BLOCK))))]
    return out


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    rows = rows.groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 targets")
    return sorted((r.source, float(r.w or 0), int(r.r or 0)) for r in rows)


def run_of_blocks(sizes: np.ndarray, rest: int, starts: np.ndarray) -> np.ndarray:
    """Which documents of a tape a run of ``rest`` tokens takes: of the given starts the one that comes nearest to ``rest``.

    A document is taken if its middle lies in the run; the tape is a ring, so every document has the same chance.
    """
    total = int(sizes.sum())
    middle = 2 * np.cumsum(sizes) - sizes  # doubled, so integers
    best, taken = None, np.zeros(len(sizes), bool)
    for start in starts.tolist():
        inside = (middle - 2 * start) % (2 * total) < 2 * rest
        off = abs(int(sizes[inside].sum()) - rest)
        if best is None or off < best:
            best, taken = off, inside
    return taken


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 42, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(source, doc_id, copies, tokens): the documents of the mix, how often each is used, and its size."""
    spark: SparkSession = docs.sparkSession
    goals = _targets(targets)
    keyed = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").where(F.col("source").isin([s for s, _, _ in goals]))
    sized = cut(document_tokens(keyed, ["doc_id", "source"], name, folder)).where("tokens > 0")
    # shards by the source's own size: a small source in many shards would meet its quotas badly
    shards = {r.source: -(-r["count"] // SHARD_DOCS) for r in sized.groupBy("source").count().collect()}
    parts = F.coalesce(*(F.when(F.col("source") == s, F.lit(n)) for s, n in shards.items()), F.lit(1)).cast("bigint")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), parts))
    tapes = sized.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).withColumn("group", (F.col("shard") % GROUPS).cast("int"))
    supply: dict[str, dict[int, int]] = {}
    for r in tapes.groupBy("source", "group").agg(F.sum("t").alias("t")).collect():  # at most targets x GROUPS rows
        supply.setdefault(r.source, {})[r.group] = r.t
    plan, repeats = quotas(goals, supply), {s: r for s, _, r in goals}
    granted = spark.createDataFrame([(s, k, q, repeats[s]) for s, k, _, q in plan], "source string, group int, blocks bigint, most int")

    def apportion(group: pd.DataFrame) -> pd.DataFrame:
        """The quotas of a group's shards."""
        group = group.sort_values("shard")
        blocks = sainte_lague([float(t) for t in group["t"]], int(group["blocks"].iloc[0]))
        return group.assign(quota=[q * BLOCK for q in blocks])[["source", "shard", "t", "quota", "most"]]

    quota = tapes.join(F.broadcast(granted), ["source", "group"]).groupBy("source", "group").applyInPandas(apportion, "source string, shard bigint, t bigint, quota bigint, most int")

    def take(shard: pd.DataFrame) -> pd.DataFrame:
        """Whole passes for all documents; of the last pass a run of blocks."""
        shard = shard.sort_values(["at", "doc_id"], kind="stable")
        quota, most, total = (int(shard[c].iloc[0]) for c in ("quota", "most", "t"))
        passes, rest = divmod(quota, total)
        copies = np.full(len(shard), passes)
        if rest and passes < most:
            h = hashlib.sha256(f"{seed}|{shard['source'].iloc[0]}|{shard['shard'].iloc[0]}".encode()).digest()
            starts = np.random.default_rng(int.from_bytes(h[:8], "big")).integers(0, total, STARTS)
            copies += run_of_blocks(shard["tokens"].to_numpy(), rest, starts)
        return shard.assign(copies=copies)[["source", "doc_id", "copies", "tokens"]]

    # a shard holds about SHARD_DOCS documents, three numbers each
    chosen = sized.join(quota, ["source", "shard"]).withColumn("at", F.xxhash64("doc_id", F.lit(seed)))
    mix = chosen.groupBy("source", "shard").applyInPandas(take, "source string, doc_id bigint, copies bigint, tokens bigint")
    return mix.where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_docs, used_docs, tokens, most_copies): a row for each target."""
    goals = targets.select(source_key(F.col("source")).alias("source"), "target_share").where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    got = mix.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("used_docs"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    both = goals.join(got, "source", "left").fillna(0, ["n_docs", "used_docs", "tokens", "most_copies"])
    # as many rows as targets
    return both.withColumn("actual_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0))).select("source", "target_share", "actual_share", "n_docs", "used_docs", "tokens", "most_copies")
