"""Problem 4: repeated content inside each text, judged by the text's rule and its host's rate.

A text's rule: the share of its words that stand in phrases of six or more words (ten characters in Chinese)
which occurred earlier in the text. Rule failures are added up by host (source), the hosts' rates are shrunk
towards the corpus' rate with a beta prior fitted to all hosts by moments, and each host's verdict is joined
back to its texts. The decision rests on both: a text fails from a share of a third, and each doubling of its
host's shrunk odds over the corpus' lowers that threshold by ``SHARE_ERROR`` (each halving raises it), at most by
``MOST_DOUBLINGS`` of them. Hosts within a factor of two of the corpus leave the third as it is.

Cases: NULL, empty and wordless texts have share 0 and pass; a NULL host is a host of its own.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import map_batches
from curata.plans.lineage import cut
from curata.plans.skew import dictionary_join, hot_limit

#: Words (or Chinese characters) of the shortest phrase, and the share from which a text fails.
PHRASE_WORDS, PHRASE_CHARS, MIN_SHARE = 6, 10, 1 / 3
#: How far a doubling of the host's odds moves a text's threshold, and how many doublings count.
SHARE_ERROR, MOST_DOUBLINGS = 0.015, 3
#: A host is bad if its shrunk rate is at least so many times the corpus' rate.
BAD_HOST = 2.0

_TOKEN = re.compile(r"\x1d|[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
#: A running number before a copy: at the start of a line or sentence, set off by a sign.
_RUNNING = re.compile(r"(^|\n|[.!?:;。！？\x1d])([ \t]*)(?:[#(\[]?\d+(?:[.):\]]|\s*[-–—:、])(?!\d)|#\d+)", re.M)


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a sequence so far and its next member."""
    h = (h ^ (x + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def repeated_shares(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them stand in repeated phrases."""
    joined = "\x1d".join((t or "").replace("\x1d", " ") for t in texts).lower()
    tokens = _TOKEN.findall(_RUNNING.sub(r"\1\2", joined))
    seen: dict[str, int] = {}
    number = count()
    for t in set(tokens):
        seen[t] = next(number)
    ids = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
    end = ids == seen.get("\x1d", -1)
    text = np.cumsum(end)
    text, ids = text[~end], ids[~end]
    names = np.array(sorted(seen, key=seen.get), dtype=object)
    cjk = np.fromiter((x >= "぀" and len(x) == 1 and x <= "鿿" for x in names), bool, len(names))[ids] if len(ids) else np.zeros(0, bool)
    n = np.bincount(text, minlength=len(texts))
    marked = np.zeros(len(ids), bool)
    codes = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    chars = np.concatenate([[0], np.cumsum(cjk)])
    for width in (PHRASE_WORDS, PHRASE_CHARS):
        if len(ids) < width:
            continue
        m = len(ids) - width + 1
        h = np.zeros(m, np.uint64)
        for k in range(width):
            h = mix(h, codes[k : k + m])
        ok = text[:m] == text[width - 1 :]
        if width == PHRASE_WORDS:
            ok &= chars[width:] == chars[:m]  # six words only where none is a character
        else:
            ok &= chars[width:] != chars[:m]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        key = mix(h[at], text[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(at), bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]  # stable: the first of equals is the earliest
        hit = at[again]
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
        marked |= np.cumsum(cover)[:-1] > 0
    return n, np.bincount(text[marked], minlength=len(texts))


def text_rule(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(``id_col``, host, n_words, repeated, share, fails) of each row; map-only."""

    def make():
        def work(part, texts):
            n, r = repeated_shares(texts)
            return {id_col: part.column(id_col), "host": part.column("host"), "n_words": n, "repeated": r, "share": r / np.maximum(n, 1), "fails": (r > 0) & (r >= MIN_SHARE * n)}

        return work

    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(host_col).cast("string").alias("host"), text_col)
    return map_batches(rows, f"{id_col} bigint, host string, n_words bigint, repeated bigint, share double, fails boolean", (text_col,), make)


def host_rates(rules: DataFrame) -> DataFrame:
    """(host, n, n_failed, rate, shrunk_rate, bad_host, threshold) with an empirical beta prior over all hosts.

    ``rules`` is used more than once; cut it first.
    """
    hosts = rules.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("fails").cast("bigint")).alias("n_failed")).withColumn("rate", F.col("n_failed") / F.col("n"))
    # moments of the hosts' rates, weighted by rows; a + b = m (1 - m) / v - 1
    prior = hosts.agg((F.sum("n_failed") / F.sum("n")).alias("m"), F.sum(F.col("n") * F.col("rate") * F.col("rate")).alias("s"), F.sum("n").alias("w"))
    prior = prior.withColumn("v", F.greatest(F.col("s") / F.col("w") - F.col("m") * F.col("m"), F.lit(1e-9)))
    one = prior.select("m", F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)).alias("strength")).first()
    m, strength = one.m or 0.0, one.strength or 1.0
    shrunk = (F.col("n_failed") + F.lit(strength * m)) / (F.col("n") + F.lit(strength))
    # whole doublings of the odds, towards zero
    odds = lambda p: p / (1 - p)
    doublings = F.log2(F.least(F.greatest(odds(F.least(shrunk, F.lit(1 - 1e-9))), F.lit(1e-12)) / F.lit(odds(min(max(m, 1e-9), 1 - 1e-9))), F.lit(1e12)))
    whole = F.when(doublings >= 0, F.floor(doublings)).otherwise(F.ceil(doublings))
    moved = F.least(F.greatest(whole, F.lit(-MOST_DOUBLINGS)), F.lit(MOST_DOUBLINGS)) * F.lit(SHARE_ERROR)
    return hosts.select("host", "n", "n_failed", "rate", shrunk.alias("shrunk_rate"), (shrunk >= F.lit(BAD_HOST * m)).alias("bad_host"), (F.lit(MIN_SHARE) - moved).alias("threshold"))


def verdicts(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Each row's own share and rule, its host's shrunk rate and verdict, and whether the row ``fails`` by both."""
    rules = cut(text_rule(df, id_col, text_col, host_col))  # numbers only: the texts are read once
    hosts = host_rates(rules).select("host", "n", "shrunk_rate", "bad_host", "threshold")
    d = dictionary_join(rules.withColumn("host", F.coalesce("host", F.lit(""))), hosts, ["host"], "n", hot_limit(rules.count()))
    # the share's own rounding must not decide at exactly the threshold
    by_both = (F.col("repeated") > 0) & (F.col("repeated") + 1e-9 >= F.col("threshold") * F.col("n_words"))
    return d.withColumnRenamed("fails", "rule_fails").withColumn("fails", by_both)
