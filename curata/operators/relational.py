"""Audit reports, funnels, deterministic selection, sampling, mixing and scoring as DataFrame plans."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.udfs import answers_equal, canonical_answer, meeting_keys
from curata.plans.lineage import cut
from curata.plans.skew import dictionary_join, hot_limit


#: Bits of a gram's hash in the map of rare grams: at most 2^20 numbers are sent along.
MAP_BITS = 20


def contamination(docs: DataFrame, doc_id: str, text_words: Column, items: DataFrame, item_id: str, item_words: Column, shingle, n: int = 8, most_items: int = 5) -> DataFrame:
    """(doc_id, item_id, score, pos): for each document and item the share of the item's n-grams found in it.

    Grams of more than ``most_items`` items don't count as hits but stay in the denominator; hits count places, so
    repeated passages can lift a score above 1. ``pos`` is the first hit. The documents' grams first meet a broadcast map of
    the rare grams' hashes, ``MAP_BITS`` bits each and so of bounded size whatever the number of items; the few that are left are
    joined with the grams themselves, by broadcast or shuffle as their size allows.
    """
    # words in a projection of their own: a lambda would evaluate them for each gram
    grams = items.select(F.col(item_id).alias("item"), item_words.alias("w")).select("item", F.explode(F.array_distinct(shingle(F.col("w"), n))).alias("gram"))
    size = grams.groupBy("item").agg(F.count("*").alias("n_grams"))
    few = grams.groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") <= most_items).select("gram")
    rare = cut(grams.join(few, "gram").groupBy("gram").agg(F.collect_list("item").alias("owners")))  # of at most most_items
    probes = docs.select(F.col(doc_id).alias("doc"), text_words.alias("w")).select("doc", F.posexplode(shingle(F.col("w"), n)).alias("pos", "gram"))
    bits = F.xxhash64("gram").bitwiseAND(F.lit((1 << MAP_BITS) - 1)).alias("bits")
    probes = probes.withColumn("bits", bits).join(F.broadcast(rare.select(bits).distinct()), "bits", "left_semi").drop("bits")
    hits = probes.join(rare, "gram").select("doc", "pos", F.explode("owners").alias("item"))
    got = hits.groupBy("doc", "item").agg(F.count("*").alias("hits"), F.min("pos").alias("pos"))
    return got.join(size, "item").select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.round(F.col("hits") / F.col("n_grams"), 3).alias("score"), "pos")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order; never an arbitrary survivor."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(stage, label, n_left) after each predicate, from one pass. A NULL predicate drops the row."""
    passed: list[Column] = []
    so_far = F.lit(True)
    for _, p in stages:
        so_far = so_far & F.coalesce(p, F.lit(False))
        passed.append(so_far)
    counts = df.agg(F.count("*").alias("c0"), *(F.count_if(p).alias(f"c{k + 1}") for k, p in enumerate(passed)))
    rows = [F.struct(F.lit(k).alias("stage"), F.lit(label).alias("label"), F.col(f"c{k}").alias("n_left")) for k, label in enumerate(["all", *(s for s, _ in stages)])]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def seeded_key(*cols: Column, seed: int) -> Column:
    """A sort key as good as random, the same in every run and layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def mark_first(df: DataFrame, n: int, order: Sequence[Column], bucket: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: whether a row is among the first n in the total order (bucket..., order...), without ordering the table in one task.

    ``bucket`` is a coarse part of the order with a bounded number of values (at most some ten thousands). Their counts tell in
    which bucket the n-th row lies; buckets before it belong whole, later ones not at all, and only that one is ordered.
    """
    b = [f"__b{k}" for k in range(len(bucket))]
    d = df.withColumns(dict(zip(b, bucket)))
    counts = d.groupBy(*b).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the buckets
    edge = counts.withColumn("__before", before).where((F.col("__before") < n) & (F.col("__before") + F.col("__n") >= n)).first() if n > 0 else None
    if edge is None:  # fewer rows than n, or none wanted
        return d.withColumn(name, F.lit(n > 0)).drop(*b)
    key, at = F.struct(*b), F.struct(*(F.lit(edge[c]).alias(c) for c in b))
    here = key.eqNullSafe(at)
    rank = F.row_number().over(Window.partitionBy(*b).orderBy(*order))
    outside = d.where(~here).withColumn(name, key < at)
    inside = d.where(here).withColumn(name, rank <= n - edge["__before"])
    return outside.unionByName(inside).drop(*b)


def first_n(df: DataFrame, n: int, order: Sequence[Column], bucket: Sequence[Column]) -> DataFrame:
    """Exactly the first n rows of a total order (all if there are fewer); see ``mark_first``."""
    return mark_first(df, n, order, bucket, "__first").where("__first").drop("__first")


def seeded_order(key: str, seed: int) -> tuple[list[Column], list[Column]]:
    """(order, bucket) of the seeded order by a key: 65,536 buckets by the head of the hash."""
    h = seeded_key(F.col(key), seed=seed)
    return [h, F.col(key)], [F.substring(h, 1, 4)]


def uniform_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all if there are fewer) without replacement."""
    return first_n(df, n, *seeded_order(key, seed))


def rank_by_buckets(df: DataFrame, groups: Sequence[str], bucket: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the place (from 1) in the group's total order (bucket..., order...), without gathering a group.

    The place is the number of rows in the group's earlier buckets plus the rank inside the bucket, so a task sees a
    bucket only, however many rows a group has. NULL groups are groups.
    """
    b = [f"__b{k}" for k in range(len(bucket))]
    d = df.withColumns(dict(zip(b, bucket)))
    counts = d.groupBy(*groups, *b).agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*groups).orderBy(*b).rowsBetween(Window.unboundedPreceding, -1))
    keys = [*groups, *b]
    offsets = counts.select(*(F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)), F.coalesce(earlier, F.lit(0)).alias("__before"))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__o{i}")) for i, k in enumerate(keys)))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return d.join(offsets, on).withColumn(name, inside + F.col("__before")).drop(*b, "__before", *(f"__o{i}" for i in range(len(keys))))


def seeded_rank(df: DataFrame, groups: Sequence[str], key: str, seed: int, name: str) -> DataFrame:
    """Add ``name``: the place of each row in its group's seeded order."""
    h = seeded_key(F.col(key), seed=seed)
    return rank_by_buckets(df, groups, [F.substring(h, 1, 3)], [h, F.col(key)], name)


def fair_level(df: DataFrame, group: str, total: int) -> tuple[int, int]:
    """(k, rest): with max-min fair quotas for ``total`` rows all groups give their first k - 1 rows and ``rest`` groups a k-th.

    Only the sizes of groups that occur come to the driver; n rows have at most sqrt(2 n) different ones.
    """
    sizes = sorted((r["n"], r["g"]) for r in df.groupBy(group).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("g")).collect())
    groups, taken, level = sum(g for _, g in sizes), 0, 0
    for n, g in sizes:
        step = groups * (n - level)
        if taken + step >= total:
            more, rest = divmod(total - taken, groups)
            return level + more + 1, rest
        taken, level, groups = taken + step, n, groups - g
    return level + 1, 0  # everything


def fair_first(ranked: DataFrame, rank: str, group: str, level: tuple[int, int]) -> DataFrame:
    """The rows below the level, and the k-th rows of the first groups: one row a group is ordered."""
    k, rest = level
    whole = ranked.where(F.col(rank) < k)
    return whole.unionByName(ranked.where(F.col(rank) == k).orderBy(group).limit(rest)) if rest else whole


def water_fill(df: DataFrame, group: str, key: str, total: int, seed: int) -> DataFrame:
    """A sample of ``total`` rows with max-min fair quotas by group: the k-th rows of all groups before any k+1-th."""
    return fair_first(seeded_rank(df, [group], key, seed, "quota_rank"), "quota_rank", group, fair_level(df, group, total))


def oversample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows: whole seeded passes over the table, then a part of one; ``round`` counts the passes."""
    rows = df.count()
    if not rows:
        return df.withColumn("round", F.lit(0))
    full, rest = divmod(n, rows)
    marked = mark_first(df, rest, *seeded_order(key, seed), "__last")
    last = F.lit(full - 1) + F.col("__last").cast("int")
    return marked.where(last >= 0).withColumn("round", F.explode(F.sequence(F.lit(0), last))).drop("__last")


def split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``split`` = validation for the first ceil(share n) rows in seeded order (a share of 1 or more is a count)."""
    n = int(share) if share >= 1 else -(-int(df.count() * share * 1_000_000) // 1_000_000)
    marked = mark_first(df, n, *seeded_order(key, seed), "__held")
    return marked.withColumn("split", F.when(F.col("__held"), "validation").otherwise("train")).drop("__held")


def interleave(df: DataFrame, source: str, key: str, weights: dict[str, int], seed: int, stop: str = "first") -> DataFrame:
    """Rows of several sources in turns by integer weights; ``stop`` at the first source that runs out, or recycle to the last.

    ``turn`` is the round and ``slot`` the place in it, so the order is (turn, slot) and needs no global counter.
    """
    weight = F.coalesce(*(F.when(F.col(source) == k, F.lit(v)) for k, v in weights.items()))
    ranked = seeded_rank(df.where(F.col(source).isin(list(weights))), [source], key, seed, "__r").withColumn("__r", F.col("__r") - 1)
    sizes = {r[source]: r["n"] for r in ranked.groupBy(source).agg(F.count("*").alias("n")).collect()}
    turns = [-(-sizes.get(k, 0) // v) if stop == "all" else sizes.get(k, 0) // v for k, v in weights.items()]
    last = (max if stop == "all" else min)(turns, default=0)
    if stop == "all":
        size = F.coalesce(*(F.when(F.col(source) == k, F.lit(sizes.get(k, 0))) for k in weights))
        copies = F.ceil((last * weight - F.col("__r")) / size).cast("int")
        ranked = ranked.where(copies > 0).withColumn("__c", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("__r", F.col("__r") + F.col("__c") * size).drop("__c")
    return ranked.withColumn("turn", F.floor(F.col("__r") / weight)).withColumn("slot", (F.col("__r") % weight).cast("int")).where(F.col("turn") < last).drop("__r")


def tiers(cases: Sequence[tuple[Column, int]], otherwise: int = -1) -> Column:
    """The number of the first case that holds."""
    return F.coalesce(*(F.when(p, F.lit(v)) for p, v in cases), F.lit(otherwise))


def fill_by_tier(df: DataFrame, tier: str, group: str, order: Sequence[Column], bucket: Sequence[Column], total: int) -> DataFrame:
    """``total`` rows by ascending tier; inside the tier that doesn't fit, with fair quotas by group.

    Tiers that fit are taken as they are; only the tier at the edge is ranked, by buckets.
    """
    d = df.where(F.col(tier) >= 0)
    left, whole = total, []
    for r in sorted(d.groupBy(tier).count().collect(), key=lambda r: r[tier]):  # as many rows as tiers
        if r["count"] > left:
            edge = d.where(F.col(tier) == r[tier])
            part = fair_first(rank_by_buckets(edge, [group], bucket, order, "__rank"), "__rank", group, fair_level(edge, group, left)).drop("__rank")
            return d.where(F.col(tier).isin(whole)).unionByName(part) if whole else part
        whole.append(r[tier])
        left -= r["count"]
    return d


def with_shortfall(primary: DataFrame, reserve: DataFrame, key: str, total: int, order: Sequence[Column], bucket: Sequence[Column]) -> DataFrame:
    """The primary rows, topped up from the reserve (without them) in its order; ``origin`` tells which."""
    have = primary.count()
    extra = first_n(reserve.join(primary.select(key), key, "left_anti"), max(total - have, 0), order, bucket)
    return primary.withColumn("origin", F.lit("primary")).unionByName(extra.withColumn("origin", F.lit("fill")), allowMissingColumns=True)


def group_report(df: DataFrame, keys: Sequence[str], length: str, shares: dict[str, Column], distinct: str) -> DataFrame:
    """Rows, distinct keys, exact percentiles and maximum of a length, and percentages of conditions, by group."""
    q = F.percentile(F.col(length), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"), q.alias("q"), F.max(length).alias("longest"), *(F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4).alias(k) for k, c in shares.items()))
    return out.select(*keys, "n", "n_distinct", *(F.floor(F.col("q")[k]).cast("bigint").alias(f"p{p}") for k, p in enumerate((50, 90, 99))), "longest", *shares)


def composition(df: DataFrame, group: str, length: str, distinct: str) -> DataFrame:
    """One row: rows, tokens, median, distinct prompts, groups, largest group's share, entropy of the groups in bits."""
    by = df.groupBy(group).agg(F.count("*").alias("c"))
    total = F.sum("c")
    # sum p log2 p from counts alone: log2 n - sum(c log2 c) / n
    spread = by.agg(F.count("*").alias("n_groups"), F.round(F.max("c") / total, 6).alias("max_share"), F.round(F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total, 6).alias("entropy_bits"))
    size = df.agg(F.count("*").alias("n"), F.sum(length).alias("tokens"), F.percentile(length, F.lit(0.5)).alias("median_tokens"), F.count_distinct(distinct).alias("n_distinct"))
    return size.withColumn("k", F.lit(1)).join(spread.withColumn("k", F.lit(1)), "k").drop("k")


@dataclass(frozen=True)
class Selection:
    """How a training subset is selected: difficulty band, deduplication order, quotas, size."""

    low: float = 0.0
    high: float = 1.0
    drop_noise: bool = True
    quotas: bool = False
    hardest: bool = False
    total: int = 15_000
    seed: int = 42

    def __post_init__(self):
        if not 0 <= self.low <= self.high <= 1 or self.total < 1:
            raise ValueError("the band must lie in 0..1 and the size be positive")


#: Named selections; a caller may make others.
PRESETS = {
    "filter_only": Selection(drop_noise=False),
    "filter_difficulty": Selection(0.25, 0.75),
    "full_method": Selection(0.25, 0.75, quotas=True),
    "hardest_only": Selection(0.0, 0.25, hardest=True),
}


def select(rows: DataFrame, how: Selection, key: str = "pool_idx", prompt: str = "prompt_hash", group: str = "cluster_id") -> DataFrame:
    """A subset of quality rows with scores: band, noise rule, one row a prompt, then quotas, hardness or chance decides.

    Rows without a pass rate are outside every band narrower than 0..1.
    """
    d = rows
    if (how.low, how.high) != (0.0, 1.0):
        d = d.where(F.col("pass_rate").between(how.low - 1e-9, how.high + 1e-9))
    if how.drop_noise:
        noise = (F.col("pass_rate") == 0) & F.col("r1_agreement").isNotNull() & ~F.coalesce("r1_in_majority", F.lit(False))
        d = d.where(~F.coalesce(noise, F.lit(False)))
    d = best_per_key(d.where(F.col(prompt).isNotNull()), [prompt], [F.col("r1_in_majority").desc_nulls_last(), seeded_key(F.col(key), seed=how.seed), F.col(key)])
    if how.quotas:
        return water_fill(d.where(F.col(group) >= 0), group, key, how.total, how.seed).drop("quota_rank")
    if how.hardest:
        h, rate = seeded_key(F.col(key), seed=how.seed), F.coalesce("pass_rate", F.lit(2.0))
        return first_n(d, how.total, [rate, h, F.col(key)], [F.floor(rate * 64), F.substring(h, 1, 2)])
    return uniform_sample(d, key, how.total, how.seed)


def few_shot(questions: DataFrame, q_key: str, pool: DataFrame, p_key: str, group: str, n: int, seed: int) -> DataFrame:
    """(q_key, p_key, shot): n examples of each group of a small pool for every question of the group, the same for all.

    The examples are ranked once a group; questions join n rows each.
    """
    ranked = seeded_rank(pool, [group], p_key, seed, "shot").where(F.col("shot") <= n).select(group, p_key, "shot")
    return questions.select(q_key, group).join(ranked, group).select(q_key, p_key, "shot")


def verdict_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows whose verdict differs between two gradings, or that only one has."""
    a = before.select(*keys, F.col(column).alias("before"))
    b = after.select(*keys, F.col(column).alias("after"))
    return a.join(b, list(keys), "full").where(~F.col("before").eqNullSafe(F.col("after")))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k from n samples of which c are right: 1 - C(n-c, k) / C(n, k)."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def class_agreement(df: DataFrame, group: str, key: str, answer: str) -> DataFrame:
    """(key, group, agreement, in_majority) of the rows whose group has several: the largest class of equal answers over the group's rows, and whether
    the row's class is a strict majority.

    Empty and NULL answers equal nothing, each is a class of its own. Equality isn't transitive, classes are its closure; an answer is graded
    against those of later keys, as gold. Distinct normal forms are graded once a group, and only those pairs that share a key any two equal answers share
    (``udfs.answer_keys``: value buckets, members, points of expressions); only groups with equal forms of other spelling are gathered.
    """
    rows = df.where(F.col(group).isNotNull()).select(key, group, F.when(F.col(answer) != "", F.col(answer)).alias("a"))
    size = rows.groupBy(group).agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(size, group).withColumn("form", F.when(F.col("a").isNotNull(), canonical_answer("a")))
    forms = cut(rows.where("form IS NOT NULL").groupBy(group, "form").agg(F.count("*").alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("a").alias("a")))
    keyed = cut(forms.select(group, "form", "lo", "hi", "a", F.explode(meeting_keys("a")).alias("k")))
    x, y = (keyed.select(group, "k", *(F.col(c).alias(f"{c}_{side}") for c in ("form", "lo", "hi", "a"))) for side in "xy")
    pairs = x.join(y, [group, "k"]).where("form_x < form_y").drop("k").distinct().withColumn("xy", answers_equal("a_x", "a_y")).withColumn("yx", answers_equal("a_y", "a_x"))
    edges = pairs.where("(lo_x < hi_y AND xy) OR (lo_y < hi_x AND yx)").select(group, "form_x", "form_y")

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def find(v):
            while parent.setdefault(v, v) != v:
                v = parent[v]
            return v

        for u, v in zip(pdf["form_x"], pdf["form_y"]):
            parent[find(u)] = find(v)
        return pd.DataFrame({group: pdf[group].iloc[0], "form": list(parent), "root": [find(v) for v in list(parent)]})

    roots = edges.groupBy(group).applyInPandas(components, f"`{group}` string, form string, root string")
    f = forms.join(roots, [group, "form"], "left").withColumn("root", F.coalesce("root", "form"))
    f = f.withColumn("size", F.sum("c").over(Window.partitionBy(group, "root")))
    best = f.groupBy(group).agg(F.max("size").alias("best"))
    d = rows.join(best, group, "left").join(f.select(group, "form", "size"), [group, "form"], "left")
    return d.select(key, group, F.round(F.coalesce("best", F.lit(1)) / F.col("n"), 6).alias("agreement"), F.coalesce(F.col("size") * 2 > F.col("n"), F.lit(False)).alias("in_majority"))


#: A prime below 2^31, and Poisson(1) as the number of these shares of it that a draw reaches.
PRIME = 2**31 - 1
POISSON = [int(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) * PRIME) for k in range(9)]


def bootstrap_gap(scores: DataFrame, bench: str, question: str, a: str, b: str, rounds: int, seed: int) -> DataFrame:
    """(lo, hi, mean): percentiles 2.5 and 97.5 of the macro-averaged gap a - b over resampled questions.

    Every question enters each round with a Poisson(1) weight, the form of resampling with replacement that needs no draws across
    rows: nothing is joined or ordered, and rounds x benches sums are all that is shuffled. The weight in round r comes from
    (x + r y) mod PRIME with x and y hashed from (seed, bench, question), so it is the same in every layout.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), bench, F.col(question).cast("string")))
    part = lambda k: F.conv(F.substring(h, k, 8), 16, 10).cast("bigint") % PRIME
    q = scores.select(bench, (F.col(a) - F.col(b)).alias("gap"), part(1).alias("hx"), part(9).alias("hy")).where("gap IS NOT NULL")
    drawn = q.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("v", (F.col("hx") + F.col("round") * F.col("hy")) % PRIME)
    weight = sum(((F.col("v") >= t).cast("int") for t in POISSON), F.lit(0))
    means = drawn.select("round", bench, "gap", weight.alias("w")).groupBy("round", bench).agg(F.try_divide(F.sum(F.col("w") * F.col("gap")), F.sum("w")).alias("m"))
    rounds_ = means.groupBy("round").agg(F.avg("m").alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return rounds_.agg(p.alias("p"), F.avg("m").alias("mean")).select(F.round(F.col("p")[0], 6).alias("lo"), F.round(F.col("p")[1], 6).alias("hi"), F.round("mean", 6).alias("mean"))


def gate(p: Column, ref: Column, n: Column) -> Column:
    """Whether a score is within noise of its reference: |p - ref| <= max(0.03, 3 sqrt(max(ref (1 - ref), 0.01) / n))."""
    return F.abs(p - ref) <= F.greatest(F.lit(0.03), 3 * F.sqrt(F.greatest(ref * (1 - ref), F.lit(0.01)) / n))


def smoothed(values: Column) -> Column:
    """Exponential moving average of an ordered array with the weight 1.8 (sigmoid(0.05 n) - 0.5)."""
    w = F.lit(1.8) * (1 / (1 + F.exp(-F.lit(0.05) * F.size(values))) - 0.5)
    start = F.struct(F.element_at(values, 1).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        y = acc["last"] * w + (1 - w) * x
        return F.struct(y.alias("last"), F.concat(acc["out"], F.array(y)).alias("out"))

    return F.aggregate(values, start, step)["out"]


def unions(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of all by name; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def length_cdf(df: DataFrame, length: str, interval: int) -> DataFrame:
    """(bucket, n, cumulative, percent) of lengths in steps of ``interval``.

    The running sum is over buckets, of which there are at most the longest length over the interval.
    """
    b = df.where(F.col(length).isNotNull()).groupBy((F.floor(F.col(length) / interval) * interval).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("bucket"))
    return b.select("bucket", "n", run.alias("cumulative"), F.round(100 * run / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dim, v): mean of each dimension, aggregated before the shuffle."""
    return df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("v"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def term_weights(docs: DataFrame, doc: str, group: str, words: Column, stop: Sequence[str], top: int) -> DataFrame:
    """(group, rank, term, weight): each group's terms by mean tf-idf, with smooth idf and unit rows.

    Terms are kept whole; ranks come from a window of each group over its distinct terms.
    """
    t = docs.select(doc, group, F.explode(words).alias("term")).where(~F.col("term").isin(list(stop))).groupBy(doc, group, "term").agg(F.count("*").alias("tf"))
    t = cut(t)  # read three times: numbers and words, not texts
    n = docs.select(doc).distinct().count()
    df_ = t.groupBy("term").agg(F.count("*").alias("df"))
    weight = df_.select("term", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    # a term of a third of all documents is sent along, the others are shuffled
    w = cut(dictionary_join(t, weight, ["term"], "df", hot_limit(t.count())).withColumn("x", F.col("tf") * F.col("idf")))
    norm = w.groupBy(doc).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    size = docs.groupBy(group).agg(F.count("*").alias("size"))
    mean = w.join(norm, doc).groupBy(group, "term").agg(F.sum(F.col("x") / F.col("norm")).alias("s")).join(size, group).select(group, "term", F.round(F.col("s") / F.col("size"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= top).select(group, "rank", "term", "weight")


def folded_runs(df: DataFrame, run: str, excluded: Sequence[str] = ("crashed", "test")) -> DataFrame:
    """Runs without those whose name holds an excluded word, with ``base``: the shortest other run that a name continues after an underscore, else itself.

    The names are few; the rows join them once.
    """
    kept = df.where(~reduce(lambda a, b: a | b, (F.contains(F.lower(run), F.lit(w)) for w in excluded)))
    names = kept.select(F.col(run).alias("__name")).distinct()
    # a run's possible bases are the heads of its own name, so this is an equality join
    heads = names.select("__name", F.explode(F.transform(F.split("__name", "_"), lambda _, i: F.array_join(F.slice(F.split("__name", "_"), F.lit(1), i + 1), "_"))).alias("__head"))
    base = heads.join(names.select(F.col("__name").alias("__head")), "__head").groupBy("__name").agg(F.min_by("__head", F.length("__head")).alias("base"))
    return kept.join(base, F.col(run) == F.col("__name")).drop("__name")


def slice_of(df: DataFrame, members: dict[str, Sequence] | None = None, ranges: dict[str, tuple] | None = None, flags: dict[str, bool] | None = None) -> DataFrame:
    """The rows of an interactive view: columns among given values, within closed ranges (None is open), flags as wanted. A NULL is in no slice."""
    for c, values in (members or {}).items():
        df = df.where(F.col(c).isin(list(values)))
    for c, (low, high) in (ranges or {}).items():
        df = df.where(F.lit(True) if low is None else F.col(c) >= low).where(F.lit(True) if high is None else F.col(c) <= high)
    for c, wanted in (flags or {}).items():
        df = df.where(F.col(c) == F.lit(wanted))
    return df


def macro_average(df: DataFrame, run: str, bench: str, score: str, required: Sequence[str]) -> DataFrame:
    """(run, average) over a required list of benches; NULL where one is missing."""
    d = df.where(F.col(bench).isin(list(required))).groupBy(run).agg(F.avg(score).alias("a"), F.count_distinct(F.when(F.col(score).isNotNull(), F.col(bench))).alias("k"))
    return df.select(run).distinct().join(d, run, "left").select(run, F.when(F.col("k") == len(set(required)), F.round("a", 6)).alias("average"))


def first_finished(df: DataFrame, keys: Sequence[str], priority: str, score: str) -> DataFrame:
    """Of each key the row of the first source, by priority, that has a score; keys without one are left out."""
    return best_per_key(df.where(F.col(score).isNotNull()), keys, [F.col(priority)])


def run_order(run: Column) -> Column:
    """A sort key of runs: the base first, then the random ones, then all by name."""
    return F.struct((run != "base").alias("a"), (~run.startswith("random")).alias("b"), run.alias("c"))


def diagnostics(samples: DataFrame, keys: Sequence[str], length: str, limit: int, boxed: Column, looping: Column, right: Column) -> DataFrame:
    """Median and 90th percentile of lengths, shares at the limit, without box and looping, and accuracy of the boxed and the unboxed ones; NULL for an empty part."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    q = F.percentile(length, F.array(F.lit(0.5), F.lit(0.9)))
    d = samples.groupBy(*keys).agg(q.alias("q"), share(F.col(length) >= limit).alias("hit_max"), share(~boxed).alias("no_boxed"), share(looping).alias("loop"), share(F.when(boxed, right)).alias("right_boxed"), share(F.when(~boxed, right)).alias("right_unboxed"))
    return d.select(*keys, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), "hit_max", "no_boxed", "loop", "right_boxed", "right_unboxed")


def assigned(vectors: DataFrame, key: str, vector: str, centers: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """(key, cluster, distance, distances): the nearest of the given centres, the smaller number of equal ones, and the distance to every centre."""
    d = F.array(*(F.sqrt(squared_distance(F.col(vector), F.array(*map(F.lit, c)))) for _, c in centers))
    numbers = F.array(*(F.lit(k) for k, _ in centers))
    return vectors.select(key, d.alias("distances")).select(key, F.element_at(numbers, F.array_position("distances", F.array_min("distances")).cast("int")).alias("cluster"), F.array_min("distances").alias("distance"), "distances")
