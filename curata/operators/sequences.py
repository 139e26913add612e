"""Token sequences for training: budgets, labels, packing, blocks, padding, masks. Higher-order functions on arrays."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def length_budget(source: Column, target: Column, cutoff: Column | int) -> tuple[Column, Column]:
    """How much of source and target to keep within a cutoff.

    A short target keeps itself and the source is cut; a short source keeps itself and the target is cut;
    else both shrink in proportion. Fractions are cut off.
    """
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    both = F.floor(cutoff * (target / (source + target)))
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(both)
    keep = F.least(most, target).cast("int")
    return F.least(F.greatest(cutoff - keep, F.lit(0)), source).cast("int"), keep


def words_as_ids(text: Column) -> Column:
    """A checkable stand-in for a tokenizer: the code point of each character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def encode_turns(turns: Column, cutoff: int, train_on_prompt: bool = False, mask_history: bool = False) -> Column:
    """Fold (source ids, target ids) pairs into (input_ids, labels) under a running budget.

    ``turns`` is an array of structs ``source``, ``target``. Sources have no labels unless ``train_on_prompt``; with
    ``mask_history`` only the last turn trains and the budget is spent from the last turn backwards.
    """
    seq = F.reverse(turns) if mask_history else turns
    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("input_ids"), empty.alias("labels"), F.lit(0).alias("total"), F.lit(0).alias("turn"))

    def step(acc: Column, t: Column) -> Column:
        s, k = length_budget(F.size(t["source"]), F.size(t["target"]), F.lit(cutoff) - acc["total"])
        full = acc["total"] >= cutoff
        source, target = F.slice(t["source"], 1, F.greatest(s, F.lit(0))), F.slice(t["target"], 1, F.greatest(k, F.lit(0)))
        blank = lambda a: F.transform(a, lambda _: F.lit(IGNORE))
        own = source if train_on_prompt else blank(source)
        answer = F.when(acc["turn"] > 0, blank(target)).otherwise(target) if mask_history else target
        ids, labels = F.concat(source, target), F.concat(own, answer)
        grown = F.struct(
            (F.concat(ids, acc["input_ids"]) if mask_history else F.concat(acc["input_ids"], ids)).alias("input_ids"),
            (F.concat(labels, acc["labels"]) if mask_history else F.concat(acc["labels"], labels)).alias("labels"),
            (acc["total"] + F.size(source) + F.size(target)).cast("int").alias("total"),
            (acc["turn"] + 1).alias("turn"),
        )
        return F.when(full, acc).otherwise(grown)

    return F.aggregate(seq, start, step, lambda acc: F.struct(acc["input_ids"].alias("input_ids"), acc["labels"].alias("labels")))


def ones(ids: Column) -> Column:
    """The attention mask of a sequence."""
    return F.transform(ids, lambda _: F.lit(1))


def greedy_bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """Repeatedly fill a container with the largest length that fits; indices by container. Longer ones are left out."""
    left = sorted((n, k) for k, n in enumerate(lengths) if n <= capacity)
    out = []
    while left:
        room, here = capacity, []
        while (at := bisect_right(left, (room, len(lengths)))) > 0:
            n, k = left.pop(at - 1)
            room -= n
            here.append(k)
        out.append(here)
    return out


def pack_batches(df: DataFrame, key: str, ids: str, capacity: int, batch: int = 1000) -> DataFrame:
    """(batch_id, pack_id, n_sequences, tokens, keys, input_ids, position_ids, segment_ids): sequences packed by batch.

    A batch is ``floor(key / batch)``, so results depend on keys alone, not on the layout. Sequences above the
    capacity are dropped before packing, as upstream does; packs are padded to the capacity with 0.
    """

    def pack(bid: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        seqs, keys, rows = [list(x) for x in pdf[ids]], pdf[key].tolist(), []
        for p, members in enumerate(greedy_bins([len(s) for s in seqs], capacity)):
            flat = [t for k in members for t in seqs[k]]
            pos = [i for k in members for i in range(len(seqs[k]))]
            seg = [j + 1 for j, k in enumerate(members) for _ in seqs[k]]
            pad = [0] * (capacity - len(flat))
            rows.append((bid[0], p, len(members), len(flat), [keys[k] for k in members], flat + pad, pos + pad, seg + pad))
        return pd.DataFrame(rows, columns=["batch_id", "pack_id", "n_sequences", "tokens", "keys", "input_ids", "position_ids", "segment_ids"])

    schema = "batch_id bigint, pack_id int, n_sequences int, tokens int, keys array<bigint>, input_ids array<int>, position_ids array<int>, segment_ids array<int>"
    return df.groupBy(F.floor(F.col(key) / batch).alias("batch_id")).applyInPandas(pack, schema)


def pack_turns(df: DataFrame, key: str, source: str, target: str, capacity: int, batch: int = 1000) -> DataFrame:
    """(batch_id, pack_id, n_sequences, tokens, keys, input_ids, labels, position_ids, segment_ids): pairs of texts, cut to the budget and packed.

    Ids are code points; labels stand on the targets only. Batches and packs are those of ``pack_batches``; as each pair is cut to the
    capacity by ``length_budget`` first, none is dropped.
    """
    s, t = length_budget(F.length(source), F.length(target), capacity)
    d = df.select(key, F.substring(source, F.lit(1), s).alias("s"), F.substring(target, F.lit(1), t).alias("t"))

    def pack(bid: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        sources, targets = ([np.frombuffer(x.encode("utf-32-le"), "<i4") for x in pdf[c]] for c in "st")
        sizes, keys, rows = [len(a) + len(b) for a, b in zip(sources, targets)], pdf[key].to_numpy(), []
        for p, members in enumerate(greedy_bins(sizes, capacity)):
            n = [sizes[k] for k in members]
            pad = np.zeros(capacity - sum(n), np.int32)
            ids = np.concatenate([x for k in members for x in (sources[k], targets[k])] + [pad])
            labels = np.concatenate([x for k in members for x in (np.full(len(sources[k]), IGNORE, np.int32), targets[k])] + [pad + IGNORE])
            places = np.concatenate([np.arange(x, dtype=np.int32) for x in n] + [pad])
            segments = np.concatenate([np.repeat(np.arange(1, len(n) + 1, dtype=np.int32), n), pad])
            rows.append((bid[0], p, len(n), sum(n), keys[members], ids, labels, places, segments))
        return pd.DataFrame(rows, columns=["batch_id", "pack_id", "n_sequences", "tokens", "keys", "input_ids", "labels", "position_ids", "segment_ids"])

    schema = "batch_id bigint, pack_id int, n_sequences int, tokens int, keys array<bigint>, input_ids array<int>, labels array<int>, position_ids array<int>, segment_ids array<int>"
    return d.groupBy(F.floor(F.col(key) / batch).alias("batch_id")).applyInPandas(pack, schema)


def blocks(df: DataFrame, key: str, ids: str, block: int, end: int, batch: int = 1000) -> DataFrame:
    """(batch_id, block_id, ids): sequences with an end sign joined and cut into equal blocks; a batch's rest is dropped.

    Places come from a running sum of lengths inside the batch; each sequence is sliced by the blocks it touches,
    and a block is put together from at most ``block`` pieces.
    """
    s = df.select(F.col(key), F.floor(F.col(key) / batch).alias("batch_id"), F.concat(F.col(ids), F.array(F.lit(end))).alias("s"))
    w = Window.partitionBy("batch_id").orderBy(key)
    s = s.withColumn("to", F.sum(F.size("s")).over(w)).withColumn("from", F.col("to") - F.size("s")).withColumn("total", F.sum(F.size("s")).over(Window.partitionBy("batch_id")))
    cuts = s.withColumn("block_id", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))).where((F.col("block_id") + 1) * block <= F.col("total"))
    first = F.greatest(F.col("block_id") * block, F.col("from")) - F.col("from")
    last = F.least((F.col("block_id") + 1) * block, F.col("to")) - F.col("from")
    cuts = cuts.withColumn("piece", F.slice("s", (first + 1).cast("int"), (last - first).cast("int")))
    return cuts.groupBy("batch_id", "block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "piece"))), lambda x: x["piece"])).alias("ids"))


def text_blocks(df: DataFrame, key: str, text: str, block: int, end: int, batch: int = 1000) -> DataFrame:
    """(batch_id, block_id, ids): as ``blocks`` over the code points of texts. The texts themselves are shuffled, once, and a batch has ``batch`` keys."""

    def cut(bid: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, text])
        sign = np.array([end], np.int32)
        flat = np.concatenate([x for t in pdf[text] for x in (np.frombuffer(t.encode("utf-32-le", "replace"), "<i4"), sign)])
        n = len(flat) // block
        return pd.DataFrame({"batch_id": bid[0], "block_id": np.arange(n), "ids": pd.Series(list(flat[: n * block].reshape(n, block)), dtype=object)})

    d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    return d.groupBy(F.floor(F.col(key) / batch).alias("batch_id")).applyInPandas(cut, "batch_id bigint, block_id bigint, ids array<int>")


def padded(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def collated(df: DataFrame, batch: str, ids: str, labels: str, multiple: int = 8, pad: int = 0) -> DataFrame:
    """Sequences padded to their batch's longest, rounded up to a multiple."""
    width = (F.ceil(F.max(F.size(ids)).over(Window.partitionBy(batch)) / multiple) * multiple).cast("int")
    d = df.withColumn("width", width)
    return d.withColumn("mask", padded(ones(F.col(ids)), F.col("width"), 0)).withColumn(ids, padded(F.col(ids), F.col("width"), pad)).withColumn(labels, padded(F.col(labels), F.col("width"), IGNORE))


def segment_lengths(mask: Column) -> Column:
    """Lengths of the segments 1, 2, ... of an index mask, 0 being padding."""
    return F.when(F.array_max(mask) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(mask), F.lit(1))), lambda k: F.size(F.filter(mask, lambda x: x == k)))).otherwise(F.array().cast("array<int>"))


def cumulative(lengths: Column) -> Column:
    """0 and the running sums."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def block_mask(mask: Column) -> Column:
    """Block-diagonal causal mask of an index mask: 1 where place i may look at place j."""
    return F.transform(mask, lambda x, i: F.transform(mask, lambda y, j: ((x == y) & (x != 0) & (j <= i)).cast("int")))


def token_accuracy(predictions: Column, labels: Column) -> Column:
    """Share of labelled places whose prediction, made one place before, is right; NULL without labels."""
    pairs = F.zip_with(F.slice(predictions, F.lit(1), F.greatest(F.size(predictions) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, y: F.struct(p.alias("p"), y.alias("y")))
    kept = F.filter(pairs, lambda x: x["y"] != IGNORE)
    return F.when(F.size(kept) > 0, F.size(F.filter(kept, lambda x: x["p"] == x["y"])) / F.size(kept))


def shifted_pairs(df: DataFrame, batch: str, order: str, response: str) -> DataFrame:
    """Each row with the response of the row before in its batch; the first has the last one's."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("mismatched", F.coalesce(F.lag(response).over(w), F.last(response).over(whole)))


def encode_preference(prompt: Column, chosen: Column, rejected: Column, cutoff: int) -> Column:
    """(chosen_ids, chosen_labels, rejected_ids, rejected_labels): one prompt, the budget by the longer response."""
    s, t = length_budget(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), cutoff)
    p, a, b = F.slice(prompt, F.lit(1), s), F.slice(chosen, F.lit(1), t), F.slice(rejected, F.lit(1), t)
    blank = F.transform(p, lambda _: F.lit(IGNORE))
    return F.struct(F.concat(p, a).alias("chosen_ids"), F.concat(blank, a).alias("chosen_labels"), F.concat(p, b).alias("rejected_ids"), F.concat(blank, b).alias("rejected_labels"))


def encode_rated(prompt: Column, response: Column, mismatched: Column, cutoff: int) -> Column:
    """(input_ids, labels, kl_ids, kl_labels): a rated response, and the mismatched one of the same batch, each in its own budget."""
    parts = []
    for name, ids in (("input", response), ("kl", mismatched)):
        s, t = length_budget(F.size(prompt), F.size(ids), cutoff)
        p, a = F.slice(prompt, F.lit(1), s), F.slice(ids, F.lit(1), t)
        parts += [F.concat(p, a).alias(f"{name}_ids"), F.concat(F.transform(p, lambda _: F.lit(IGNORE)), a).alias("labels" if name == "input" else "kl_labels")]
    return F.struct(*parts)


def encoder(stage: str, packing: bool = False):
    """The encoder of a training stage: texts in blocks, turns (packed or not), preference pairs, rated responses."""
    by_stage = {("pretraining", False): blocks, ("pretraining", True): blocks, ("supervised", False): encode_turns, ("supervised", True): pack_batches, ("preference", False): encode_preference, ("rated", False): encode_rated}
    if (stage, packing) not in by_stage:
        raise ValueError(f"no encoder for {stage} data{' with packing' if packing else ''}")
    return by_stage[stage, packing]


def sampling_plan(samples: int, most: int) -> tuple[int, int]:
    """(rounds, samples of a round): the fewest rounds of equal size whose size divides the samples and is at most ``most``."""
    if samples < 1 or most < 1:
        raise ValueError("samples and batch must be positive")
    size = max(d for d in range(1, min(samples, most) + 1) if samples % d == 0)
    return samples // size, size
