"""Measures over arrays of scores and log-probabilities, and of training runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def letter_of(scores: Column) -> Column:
    """The letter of the highest score, the first of equal ones; NULL for an empty array."""
    return F.when(F.size(scores) > 0, F.char(F.array_position(scores, F.array_max(scores)) + 64))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sequence_logp(logps: Column, labels: Column) -> Column:
    """(sum, n) of the log-probabilities at labelled places: place i of ``logps`` predicts label i + 1."""
    kept = F.filter(F.zip_with(logps, F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, y: F.struct(p.alias("p"), y.alias("y"))), lambda x: F.coalesce(x["y"] != IGNORE, F.lit(False)) & x["p"].isNotNull())
    return F.struct(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"]).alias("total"), F.size(kept).alias("n"))


def perplexity(logps: Column, labels: Column) -> Column:
    """exp of the mean negative log-probability; NULL without labelled places."""
    s = sequence_logp(logps, labels)
    return F.when(s["n"] > 0, F.exp(-s["total"] / s["n"]))


def labelled(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def learning_rate(ratio: Column, cutoff: int, batch: int, base_rate: float = 3e-4, base_tokens: int = 4_000_000, small: bool = False) -> Column:
    """A rate by the root of the labelled tokens of a batch, given their ratio."""
    rate = base_rate * F.sqrt(cutoff * batch * ratio / base_tokens)
    return rate / 6 if small else rate


def tokens_per_second(tokens: Column, epochs: Column, seconds: Column) -> Column:
    """NULL where no time passed."""
    return F.when(seconds > 0, tokens * epochs / seconds)


def chosen_first(chosen: Column, rejected: Column) -> Column:
    """1 where the chosen side scores higher, else 0; the mean is the preference accuracy."""
    return (chosen > rejected).cast("int")


def model_flops(tokens: Column, length: Column, layers: int, hidden: int, inner: int, vocabulary: int, heads: int, kv_heads: int, backward: bool = True) -> Column:
    """Floating-point operations of a decoder with gated feed-forward layers over ``tokens`` in sequences of ``length``.

    Two a weight and token, three times with the backward pass; attention adds two products of length x hidden a layer.
    """
    kv = hidden * kv_heads / heads
    weights = layers * (2 * hidden * hidden + 2 * hidden * kv + 3 * hidden * inner) + hidden * vocabulary
    return (3 if backward else 1) * (2.0 * weights * tokens + 4.0 * layers * hidden * length * tokens)


def utilisation(flops: Column, seconds: Column, peak: Column) -> Column:
    """The share of a device's peak that was used; NULL where no time passed."""
    return F.when(seconds > 0, flops / seconds / peak)
