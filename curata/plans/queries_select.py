"""Queries of funnels, deterministic selection, sampling, joins, sets and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.operators import relational as R
from curata.plans.registry import query
from curata.sources import table

SEED = 42
_STAGES = [
    ("math", "domain = 'math'"), ("not truncated", "NOT truncated"), ("boxed", "has_boxed"), ("answered", "answer_kind <> 'none'"),
    ("no proof", "NOT proof_like"), ("clean", "NOT contam AND NOT contam_dev"), ("unflagged", "NOT flagged"),
]
_COLS = ["pool_idx", "domain", "truncated", "has_boxed", "answer_kind", "proof_like", "contam", "contam_dev", "flagged", "prompt_hash", "total_tokens"]


def _key(seed: int, col: str) -> str:
    return f"md5('{seed}|' || {col})"


def _quality(upto: int = len(_STAGES)) -> str:
    return " AND ".join(f"coalesce({p}, FALSE)" for _, p in _STAGES[:upto]) or "TRUE"


@query(" UNION ALL ".join(f"SELECT {k} AS stage, '{'all' if not k else _STAGES[k - 1][0]}' AS label, count(*) FILTER (WHERE {_quality(k)}) AS n_left FROM audit_pool" for k in range(len(_STAGES) + 1)))
def selection_funnel(spark, folder):
    """Rows left after each quality predicate, in one pass."""
    return R.funnel(table(spark, folder, "audit_pool", *_COLS), [(label, F.expr(p)) for label, p in _STAGES])


@query(f"WITH f AS (SELECT stage, n_left FROM ({' UNION ALL '.join(f'SELECT {k} AS stage, count(*) FILTER (WHERE {_quality(k)}) AS n_left FROM audit_pool' for k in range(len(_STAGES) + 1))})) SELECT stage, n_left, lag(n_left) OVER (ORDER BY stage) - n_left AS dropped FROM f")
def funnel_drops(spark, folder):
    """What each stage drops."""
    f = selection_funnel(spark, folder)  # as many rows as stages
    return f.select("stage", "n_left", (F.lag("n_left").over(Window.orderBy("stage")) - F.col("n_left")).alias("dropped"))


_SCORED = "(SELECT a.*, s.pass_rate, s.r1_agreement, s.r1_in_majority, s.cluster_id FROM audit_pool a LEFT JOIN (SELECT DISTINCT * FROM pool_scores) s USING (pool_idx))"


def scored(spark, folder, *cols: str) -> DataFrame:
    s = table(spark, folder, "pool_scores").distinct().select("pool_idx", "pass_rate", "r1_agreement", "r1_in_majority", "cluster_id")
    return table(spark, folder, "audit_pool", *dict.fromkeys(["pool_idx", *cols])).join(s, "pool_idx", "left")


_BAND = "pass_rate >= 0.25 - 1e-9 AND pass_rate <= 0.75 + 1e-9"
_NOISE = "pass_rate = 0 AND r1_agreement IS NOT NULL AND NOT coalesce(r1_in_majority, FALSE)"
_TIER = f"CASE WHEN {_BAND} THEN 0 WHEN pass_rate = 0 AND NOT coalesce({_NOISE}, FALSE) THEN 1 WHEN pass_rate = 1 THEN 2 ELSE -1 END"


@query(f"SELECT pool_idx, pass_rate, CAST({_TIER} AS INTEGER) AS tier FROM {_SCORED} WHERE {_quality()}")
def difficulty_tiers(spark, folder):
    """Difficulty tiers of the rows that pass the funnel; the first case that holds wins."""
    d = scored(spark, folder, *_COLS).where(_quality())
    noise = F.coalesce(F.expr(_NOISE), F.lit(False))
    return d.select("pool_idx", "pass_rate", R.tiers([(F.expr(_BAND), 0), ((F.col("pass_rate") == 0) & ~noise, 1), (F.col("pass_rate") == 1, 2)]).alias("tier"))


_FIRST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY total_tokens DESC NULLS LAST, pool_idx) AS rn FROM {_SCORED} WHERE {_quality()} AND prompt_hash IS NOT NULL) WHERE rn = 1"


def survivors(spark, folder) -> DataFrame:
    d = scored(spark, folder, *_COLS).where(_quality()).where("prompt_hash IS NOT NULL")
    return R.best_per_key(d, ["prompt_hash"], [F.col("total_tokens").desc_nulls_last(), F.col("pool_idx")])


@query(f"SELECT pool_idx, prompt_hash, total_tokens FROM ({_FIRST})")
def one_per_prompt(spark, folder):
    """The longest row of each prompt, ties by key."""
    return survivors(spark, folder).select("pool_idx", "prompt_hash", "total_tokens")


@query(f"SELECT pool_idx FROM audit_pool ORDER BY {_key(SEED, 'pool_idx')}, pool_idx LIMIT 500")
def random_subset(spark, folder):
    """A uniform sample of exactly 500 rows."""
    return R.uniform_sample(table(spark, folder, "audit_pool", "pool_idx"), "pool_idx", 500, SEED)


@query(f"SELECT pool_idx, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_key(SEED, 'pool_idx')}, pool_idx) AS k FROM ({_FIRST}) WHERE cluster_id >= 0) ORDER BY k, cluster_id LIMIT 300")
def topic_quotas(spark, folder):
    """300 rows with max-min fair quotas over the clusters."""
    return R.water_fill(survivors(spark, folder).where("cluster_id >= 0"), "cluster_id", "pool_idx", 300, SEED).select("pool_idx", "cluster_id")


@query(f"SELECT pool_idx, total_tokens FROM ({_FIRST}) ORDER BY total_tokens DESC NULLS LAST, pool_idx LIMIT 200")
def longest_rows(spark, folder):
    """The 200 longest rows after deduplication."""
    return survivors(spark, folder).select("pool_idx", "total_tokens").orderBy(F.col("total_tokens").desc_nulls_last(), "pool_idx").limit(200)


_TIERED = f"SELECT *, {_TIER} AS tier FROM ({_FIRST})"


@query(f"SELECT pool_idx, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY tier, cluster_id ORDER BY total_tokens, pool_idx) AS k FROM ({_TIERED}) WHERE tier >= 0) ORDER BY tier, k, cluster_id NULLS FIRST LIMIT 400")
def tiered_selection(spark, folder):
    """400 rows by tier, with fair quotas in the tier that doesn't fit, short ones first."""
    noise = F.coalesce(F.expr(_NOISE), F.lit(False))
    t = survivors(spark, folder).withColumn("tier", R.tiers([(F.expr(_BAND), 0), ((F.col("pass_rate") == 0) & ~noise, 1), (F.col("pass_rate") == 1, 2)]))
    return R.fill_by_tier(t, "tier", "cluster_id", [F.col("total_tokens").asc_nulls_last(), F.col("pool_idx")], [F.floor(F.coalesce("total_tokens", F.lit(2**62)) / 256)], 400).select("pool_idx", "tier")


@query(
    f"""WITH p AS (SELECT pool_idx FROM ({_FIRST}) WHERE {_BAND}), r AS (SELECT pool_idx FROM ({_FIRST}) WHERE NOT coalesce({_BAND}, FALSE) ORDER BY {_key(SEED, 'pool_idx')}, pool_idx LIMIT (SELECT greatest(900 - count(*), 0) FROM p))
    SELECT pool_idx, 'primary' AS origin FROM p UNION ALL SELECT pool_idx, 'fill' AS origin FROM r"""
)
def shortfall_fill(spark, folder):
    """The preferred rows, topped up to 900 from the others in seeded order."""
    s = survivors(spark, folder).select("pool_idx", F.coalesce(F.expr(_BAND), F.lit(False)).alias("preferred"))
    out = R.with_shortfall(s.where("preferred").drop("preferred"), s.where("NOT preferred").drop("preferred"), "pool_idx", 900, *R.seeded_order("pool_idx", SEED))
    return out.select("pool_idx", "origin")


@query(f"SELECT id, 0 AS round FROM amc UNION ALL SELECT id, 1 AS round FROM amc UNION ALL SELECT id, 2 AS round FROM (SELECT id FROM amc ORDER BY {_key(SEED, 'id')}, id LIMIT 120)")
def oversampled_items(spark, folder):
    """600 draws from 240 items: two whole passes and a part."""
    return R.oversample(table(spark, folder, "amc", "id"), "id", 600, SEED)


@query(f"SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents ORDER BY {_key(SEED, 'doc_id')}, doc_id LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM documents)) THEN 'validation' ELSE 'train' END AS split FROM documents")
def train_validation(spark, folder):
    """A tenth of the documents held out, exactly."""
    return R.split(table(spark, folder, "documents", "doc_id"), "doc_id", 0.1, SEED)


_WEIGHT = "CASE domain WHEN 'math' THEN 3 WHEN 'code' THEN 2 WHEN 'other' THEN 1 END"


@query(
    f"""WITH s AS (SELECT domain, count(*) AS n FROM documents WHERE domain IS NOT NULL GROUP BY domain), l AS (SELECT min(n // {_WEIGHT}) AS last FROM s),
    r AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {_key(SEED, 'doc_id')}, doc_id) - 1 AS r, {_WEIGHT} AS w FROM documents WHERE domain IS NOT NULL)
    SELECT doc_id, domain, CAST(r // w AS BIGINT) AS turn, CAST(r % w AS INTEGER) AS slot FROM r, l WHERE r // w < last"""
)
def interleaved_sources(spark, folder):
    """All domains in turns of 3, 2 and 1, until the first runs out."""
    return R.interleave(table(spark, folder, "documents", "doc_id", "domain"), "domain", "doc_id", {"math": 3, "code": 2, "other": 1}, SEED)


@query(f"""WITH s AS ({_FIRST.replace('SELECT *', 'SELECT *', 1)}), g AS (SELECT cluster_id, count(*) AS c FROM s GROUP BY cluster_id)
    SELECT (SELECT count(*) FROM s) AS n, (SELECT CAST(sum(total_tokens) AS BIGINT) FROM s) AS tokens, (SELECT quantile_cont(total_tokens, 0.5) FROM s) AS median_tokens, (SELECT count(DISTINCT prompt_hash) FROM s) AS n_distinct,
    count(*) AS n_groups, round(max(c) / sum(c), 6) AS max_share, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy_bits FROM g""")
def subset_composition(spark, folder):
    """Size, median, distinct prompts, cluster entropy and largest share of the selected rows."""
    return R.composition(survivors(spark, folder), "cluster_id", "total_tokens", "prompt_hash")


@query("SELECT sha256(string_agg(CAST(pool_idx AS VARCHAR), ',' ORDER BY pool_idx)) AS fingerprint, count(*) AS n FROM (" + f"SELECT pool_idx FROM audit_pool ORDER BY {_key(SEED, 'pool_idx')}, pool_idx LIMIT 500)")
def subset_fingerprint(spark, folder):
    """SHA-256 of the sorted keys of a subset; the subset's size is a parameter, so its keys fit in a row."""
    s = random_subset(spark, folder)
    return s.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("pool_idx")), lambda x: x.cast("string")), ","), 256).alias("fingerprint"), F.count("*").alias("n"))


@query("SELECT pool_idx, prompt_hash FROM audit_pool a WHERE EXISTS (SELECT 1 FROM generations g WHERE g.prompt_hash = a.prompt_hash)")
def rows_with_samples(spark, folder):
    """Semi-join: rows whose prompt has generations."""
    return table(spark, folder, "audit_pool", "pool_idx", "prompt_hash").join(table(spark, folder, "generations", "prompt_hash"), "prompt_hash", "left_semi").select("pool_idx", "prompt_hash")


@query("SELECT pool_idx, prompt_hash FROM audit_pool a WHERE NOT EXISTS (SELECT 1 FROM generations g WHERE g.prompt_hash = a.prompt_hash)")
def rows_without_samples(spark, folder):
    """Anti-join: rows whose prompt has none (or no hash)."""
    return table(spark, folder, "audit_pool", "pool_idx", "prompt_hash").join(table(spark, folder, "generations", "prompt_hash"), "prompt_hash", "left_anti").select("pool_idx", "prompt_hash")


@query(f"SELECT pool_idx FROM audit_pool WHERE flagged UNION SELECT pool_idx FROM (SELECT pool_idx FROM audit_pool ORDER BY {_key(SEED, 'pool_idx')}, pool_idx LIMIT 500)")
def review_set(spark, folder):
    """Union without copies of a sample and the flagged rows."""
    return R.unions([table(spark, folder, "audit_pool", "pool_idx", "flagged").where("flagged").select("pool_idx"), random_subset(spark, folder)]).distinct()


@query("SELECT coalesce(a.c, b.c) AS word, a.c IS NOT NULL AS in_math, b.c IS NOT NULL AS in_code FROM (SELECT DISTINCT source AS c FROM audit_pool WHERE domain = 'math' AND source IS NOT NULL) a FULL JOIN (SELECT DISTINCT source AS c FROM audit_pool WHERE domain = 'code' AND source IS NOT NULL) b ON a.c = b.c WHERE a.c IS NULL OR b.c IS NULL")
def source_difference(spark, folder):
    """Symmetric difference of the spellings of sources in two domains."""
    d = table(spark, folder, "audit_pool", "source", "domain").where("source IS NOT NULL AND domain IN ('math', 'code')")
    s = d.groupBy(F.col("source").alias("word")).agg(F.bool_or(F.col("domain") == "math").alias("in_math"), F.bool_or(F.col("domain") == "code").alias("in_code"))
    return s.where("in_math <> in_code")


@query(
    r"""SELECT pool_idx, record::JSON->>'$.instruction' AS instruction, coalesce(record::JSON->>'$.input', '') AS input, record::JSON->>'$.system' AS system, record::JSON->>'$.extra_info.category' AS category,
    record::JSON->>'$.extra_info.source' AS source, CAST(record::JSON->>'$.extra_info.index' AS BIGINT) AS src_index FROM pool_raw"""
)
def ingested_records(spark, folder):
    """Delivered JSON records as flat rows; a NULL or missing input is empty."""
    schema = "instruction string, input string, system string, extra_info struct<category:string,source:string,index:bigint>"
    r = table(spark, folder, "pool_raw", "pool_idx", "record").select("pool_idx", F.from_json("record", schema).alias("r"))
    return r.select("pool_idx", "r.instruction", F.coalesce("r.input", F.lit("")).alias("input"), "r.system", "r.extra_info.category", "r.extra_info.source", F.col("r.extra_info.index").alias("src_index"))


@query("SELECT prompt_hash, CAST((rn - 1) % 4 AS INTEGER) AS shard, CAST((rn - 1) // 4 // 50 AS BIGINT) AS chunk FROM (SELECT prompt_hash, row_number() OVER (ORDER BY prompt_hash) AS rn FROM (SELECT DISTINCT prompt_hash FROM generations WHERE prompt_hash IS NOT NULL))")
def generation_chunks(spark, folder):
    """Shard and chunk of each prompt in the order of its hash.

    The place comes from counts of hash prefixes (4096 at most) and ranks inside a prefix, so no task orders all prompts.
    """
    g = table(spark, folder, "generations", "prompt_hash").where("prompt_hash IS NOT NULL").distinct().withColumn("head", F.substring("prompt_hash", 1, 3))
    heads = g.groupBy("head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("head", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("prompt_hash")) - 1 + F.col("before")
    return g.join(heads, "head").withColumn("at", place).select("prompt_hash", (F.col("at") % 4).cast("int").alias("shard"), F.floor(F.floor(F.col("at") / 4) / 50).cast("bigint").alias("chunk"))
