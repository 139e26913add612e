"""Queries of contamination, audit reports, scores and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.functions import udfs as U
from curata.operators import relational as R
from curata.plans.lineage import cut
from curata.plans.registry import query
from curata.plans.spread import spread
from curata.sources import table

_TOK = f"regexp_extract_all(lower(%s), '{T.TOKEN}')"


def _grams(alias: str, words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_transform(range(0, CAST(greatest(len({words}) - 8, 0) AS BIGINT) + 1), lambda i: array_to_string(list_slice({words}, i + 1, i + 8), ' ')) END AS {alias}"


_CONTAM = f"""WITH q AS (SELECT id, {_TOK % 'problem'} AS w FROM amc), qg AS (SELECT DISTINCT id, unnest(g) AS gram FROM (SELECT id, {_grams('g', 'w')} FROM q)),
  size AS (SELECT id, count(*) AS n FROM qg GROUP BY id), rare AS (SELECT * FROM qg WHERE gram IN (SELECT gram FROM qg GROUP BY gram HAVING count(*) <= 5)),
  d AS (SELECT pool_idx, {_TOK % 'output'} AS w FROM audit_pool WHERE output IS NOT NULL), dg AS (SELECT pool_idx, unnest(g) AS gram, unnest(range(len(g))) AS pos FROM (SELECT pool_idx, {_grams('g', 'w')} FROM d)),
  hits AS (SELECT pool_idx, id, count(*) AS hits, min(pos) AS pos FROM dg JOIN rare USING (gram) GROUP BY ALL),
  scored AS (SELECT pool_idx, id, round(hits / n, 3) AS score, CAST(pos AS INTEGER) AS pos FROM hits JOIN size USING (id))"""


def _scored(spark, folder) -> DataFrame:
    items, docs = table(spark, folder, "amc", "id", "problem"), spread(table(spark, folder, "audit_pool", "pool_idx", "output").where("output IS NOT NULL"))
    return R.contamination(docs, "pool_idx", T.tokens(F.col("output")), items, "id", T.tokens(F.col("problem")), T.hashed_shingles)


@query(_CONTAM + " SELECT pool_idx, id, score FROM (SELECT *, row_number() OVER (PARTITION BY pool_idx ORDER BY score DESC, pos, id) AS rn FROM scored WHERE score >= 0.5) WHERE rn = 1")
def contamination(spark, folder):
    """The best matching item of each contaminated output; ties go to the earlier hit, then the smaller item."""
    best = R.best_per_key(_scored(spark, folder).where("score >= 0.5"), ["pool_idx"], [F.desc("score"), F.col("pos"), F.col("id")])
    return best.select("pool_idx", "id", "score")


@query(_CONTAM + " SELECT id, count(*) AS n, max(score) AS top FROM scored WHERE score >= 0.3 AND score < 0.5 GROUP BY id")
def near_misses(spark, folder):
    """Items with outputs just below the contamination threshold."""
    return _scored(spark, folder).where("score >= 0.3 AND score < 0.5").groupBy("id").agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query(
    f"""WITH q AS (SELECT id, {_TOK % 'problem'} AS w FROM amc), g AS (SELECT DISTINCT id, unnest(g) AS gram FROM (SELECT id, {_grams('g', 'w')} FROM q)),
  a AS (SELECT * FROM g WHERE id % 3 = 0), b AS (SELECT DISTINCT gram FROM g WHERE id % 3 <> 0)
  SELECT a.id, count(*) AS n_grams, count(b.gram) AS shared, round(count(b.gram) / count(*), 6) AS overlap, count(b.gram) >= 0.5 * count(*) AS excluded FROM a LEFT JOIN b USING (gram) GROUP BY a.id"""
)
def held_out_overlap(spark, folder):
    """Candidates for a development set (every third item) that share half of their distinct grams with the other items."""
    w = table(spark, folder, "amc", "id", "problem").select("id", T.tokens(F.col("problem")).alias("w"))
    g = w.select("id", F.explode(F.array_distinct(T.shingles(F.col("w"), 8))).alias("gram"))
    a = g.where("id % 3 = 0")
    b = g.where("id % 3 <> 0").select("gram").distinct().withColumn("hit", F.lit(1))
    s = a.join(b, "gram", "left").groupBy("id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("shared"))
    return s.select("id", "n_grams", "shared", F.round(F.col("shared") / F.col("n_grams"), 6).alias("overlap"), (F.col("shared") >= 0.5 * F.col("n_grams")).alias("excluded"))


_SHARES = {"truncated_pct": "truncated", "no_think_pct": "NOT has_think_close", "boxed_pct": "has_boxed", "flagged_pct": "flagged"}


@query(
    "SELECT domain, count(*) AS n, count(DISTINCT prompt_hash) AS n_distinct, "
    + ", ".join(f"CAST(floor(quantile_cont(resp_tokens, {q})) AS BIGINT) AS p{p}" for p, q in ((50, 0.5), (90, 0.9), (99, 0.99)))
    + ", max(resp_tokens) AS longest, "
    + ", ".join(f"round(100 * avg(CASE WHEN coalesce({c}, FALSE) THEN 1.0 ELSE 0.0 END), 4) AS {k}" for k, c in _SHARES.items())
    + " FROM audit_pool GROUP BY domain"
)
def audit_by_domain(spark, folder):
    """Rows, distinct prompts, length percentiles and shares by domain."""
    cols = ["domain", "prompt_hash", "resp_tokens", "truncated", "has_think_close", "has_boxed", "flagged"]
    return R.group_report(table(spark, folder, "audit_pool", *cols), ["domain"], "resp_tokens", {k: F.expr(c) for k, c in _SHARES.items()}, "prompt_hash")


@query("SELECT domain, source, count(*) AS n FROM audit_pool GROUP BY ALL")
def domain_sources(spark, folder):
    return table(spark, folder, "audit_pool", "domain", "source").groupBy("domain", "source").agg(F.count("*").alias("n"))


@query("SELECT answer_kind, dup_count, count(*) AS n, count(DISTINCT prompt_hash) AS prompts FROM audit_pool GROUP BY ALL")
def value_counts(spark, folder):
    """Counts of kinds of answers and copies; NULL is a value."""
    return table(spark, folder, "audit_pool", "answer_kind", "dup_count", "prompt_hash").groupBy("answer_kind", "dup_count").agg(F.count("*").alias("n"), F.count_distinct("prompt_hash").alias("prompts"))


_FLAGS = ("flag_repetition", "flag_lang_mix", "flag_malformed", "flagged")


@query(" UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f} AND domain = 'math') AS math, count(*) FILTER (WHERE {f}) AS everything FROM audit_pool" for f in _FLAGS))
def flag_matrix(spark, folder):
    """Each flag in mathematics and in all rows, from one pass."""
    df = table(spark, folder, "audit_pool", "domain", *_FLAGS)
    one = df.agg(*(F.count_if(F.col(f) & (F.col("domain") == "math")).alias(f"{f}_m") for f in _FLAGS), *(F.count_if(F.col(f)).alias(f"{f}_a") for f in _FLAGS))
    rows = F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"{f}_m").alias("math"), F.col(f"{f}_a").alias("everything")) for f in _FLAGS))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("SELECT contam_bench, count(*) AS n, count(DISTINCT contam_qid) AS questions FROM audit_pool WHERE contam GROUP BY ALL")
def contaminated_benches(spark, folder):
    return table(spark, folder, "audit_pool", "contam_bench", "contam_qid", "contam").where("contam").groupBy("contam_bench").agg(F.count("*").alias("n"), F.count_distinct("contam_qid").alias("questions"))


@query("SELECT pool_idx, prompt_hash, count(*) OVER (PARTITION BY prompt_hash) AS copies FROM audit_pool WHERE prompt_hash IS NOT NULL")
def group_sizes(spark, folder):
    """The size of each prompt's group on every row: an aggregation joined back, so no group is gathered in one task."""
    df = table(spark, folder, "audit_pool", "pool_idx", "prompt_hash").where("prompt_hash IS NOT NULL")
    return df.join(df.groupBy("prompt_hash").agg(F.count("*").alias("copies")), "prompt_hash").select("pool_idx", "prompt_hash", "copies")


_GEN = "(SELECT DISTINCT * FROM generations)"


@query(
    f"""SELECT prompt_hash, rep_pool_idx, CAST(len(answers) AS INTEGER) AS k, CAST(len(list_filter(answers, lambda x: x <> '')) AS INTEGER) AS answered, CASE WHEN len(gen_tokens) > 0 THEN round(list_avg(gen_tokens), 6) END AS mean_tokens,
    CASE WHEN len(finish) > 0 THEN round(len(list_filter(finish, lambda x: x = 'length')) / len(finish), 6) END AS cap_share FROM {_GEN}"""
)
def sample_measures(spark, folder):
    """Measures of the sample arrays: size, answered, mean tokens, share at the limit."""
    g = table(spark, folder, "generations").distinct()
    total = F.aggregate("gen_tokens", F.lit(0), lambda a, x: a + x)
    return g.select(
        "prompt_hash", "rep_pool_idx", F.size("answers").alias("k"), F.size(F.filter("answers", lambda x: x != "")).alias("answered"),
        F.when(F.size("gen_tokens") > 0, F.round(total / F.size("gen_tokens"), 6)).alias("mean_tokens"),
        F.when(F.size("finish") > 0, F.round(F.size(F.filter("finish", lambda x: x == "length")) / F.size("finish"), 6)).alias("cap_share"),
    )


@query(
    f"""WITH a AS (SELECT rep_pool_idx, len(answers) AS n, unnest(answers) AS x, unnest(range(len(answers))) AS i FROM {_GEN} WHERE len(answers) > 1),
    c AS (SELECT rep_pool_idx, n, CASE WHEN x = '' THEN '#' || i ELSE x END AS x, count(*) AS size FROM a GROUP BY ALL)
    SELECT rep_pool_idx, max(round(size / n, 6)) AS agreement, bool_or(size * 2 > n AND x NOT LIKE '#%') AS has_majority FROM c GROUP BY rep_pool_idx"""
)
def answer_agreement(spark, folder):
    """Share of the most frequent spelling among sampled answers, and whether it is a strict majority; empty answers equal nothing. Grading: ``prompt_agreement``."""
    g = table(spark, folder, "generations").distinct().where(F.size("answers") > 1)
    a = g.select("rep_pool_idx", F.size("answers").alias("n"), F.posexplode("answers").alias("i", "x"))
    c = a.groupBy("rep_pool_idx", "n", F.when(F.col("x") == "", F.concat(F.lit("#"), "i")).otherwise(F.col("x")).alias("x")).agg(F.count("*").alias("size"))
    return c.groupBy("rep_pool_idx").agg(F.max(F.round(F.col("size") / F.col("n"), 6)).alias("agreement"), F.bool_or((F.col("size") * 2 > F.col("n")) & ~F.col("x").startswith("#")).alias("has_majority"))


@query()
def prompt_agreement(spark, folder):
    """Agreement of the responses to each prompt that has several, by graded answers; a missing hash is made from the prompt."""
    p = table(spark, folder, "audit_pool", "pool_idx", "prompt", "prompt_hash", "r1_answer")
    made = F.substring(F.sha1(U.normal_prompt(F.when(F.col("prompt_hash").isNull(), F.col("prompt")))), 1, 16)
    return R.class_agreement(spread(p).withColumn("prompt_hash", F.coalesce("prompt_hash", made)), "prompt_hash", "pool_idx", "r1_answer")


@query("SELECT a.pool_idx, a.domain, s.pass_rate, s.n_correct, coalesce(s.cluster_id, -1) AS cluster_id FROM audit_pool a LEFT JOIN (SELECT DISTINCT * FROM pool_scores) s USING (pool_idx)")
def wide_scores(spark, folder):
    """Audit rows with their scores and clusters; -1 where there is none."""
    s = table(spark, folder, "pool_scores").distinct()
    return table(spark, folder, "audit_pool", "pool_idx", "domain").join(s, "pool_idx", "left").select("pool_idx", "domain", "pass_rate", "n_correct", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


# Runs on benches: orders stand for questions, their lines for samples, a market segment for a run, a nation for a bench.
_GRID = """SELECT c_mktsegment AS run, n_name AS bench, o_orderkey AS question, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
_PASS3 = "CASE WHEN c = 0 THEN 0.0 WHEN n - c < 3 THEN 1.0 ELSE 1 - (n - c) / n * ((n - c - 1) / (n - 1)) * ((n - c - 2) / (n - 2)) END"


def grid(spark, folder) -> DataFrame:
    li, o = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag"), table(spark, folder, "orders", "o_orderkey", "o_custkey")
    samples = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))  # before the joins
    c, n = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), table(spark, folder, "nation", "n_nationkey", "n_name")
    d = samples.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(F.col("c_mktsegment").alias("run"), F.col("n_name").alias("bench"), F.col("o_orderkey").alias("question"), "n", "c")


@query(f"SELECT run, bench, count(*) AS questions, round(avg(c / n), 6) AS pass1, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_right, round(avg({_PASS3}), 6) AS pass3 FROM ({_GRID}) GROUP BY ALL")
def run_scores(spark, folder):
    """Mean, any-of-n and unbiased pass@3 of each run on each bench."""
    g = grid(spark, folder)
    return g.groupBy("run", "bench").agg(
        F.count("*").alias("questions"), F.round(F.avg(F.col("c") / F.col("n")), 6).alias("pass1"), F.round(F.avg((F.col("c") > 0).cast("double")), 6).alias("any_right"),
        F.round(F.avg(F.when(F.col("n") >= 3, R.pass_at_k(F.col("n").cast("int"), F.col("c").cast("int"), 3)).otherwise((F.col("c") > 0).cast("double"))), 6).alias("pass3"),
    )


_RUNS = f"r AS (SELECT run, bench, count(*) AS questions, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS p FROM ({_GRID}) GROUP BY ALL)"


@query(f"WITH {_RUNS}, b AS (SELECT bench, p AS ref FROM r WHERE run = 'BUILDING') SELECT run, bench, p, ref, abs(p - ref) <= greatest(0.03, 3 * sqrt(greatest(ref * (1 - ref), 0.01) / questions)) AS within FROM r JOIN b USING (bench)")
def baseline_gate(spark, folder):
    """Scores against a reference run, within noise or not."""
    r = run_scores(spark, folder).select("run", "bench", "questions", F.col("any_right").alias("p"))
    b = r.where("run = 'BUILDING'").select("bench", F.col("p").alias("ref"))
    return r.join(b, "bench").select("run", "bench", "p", "ref", R.gate(F.col("p"), F.col("ref"), F.col("questions")).alias("within"))


@query(
    f"""WITH {_RUNS}, m AS (SELECT run, round(avg(p), 6) AS p, count(*) AS n FROM r GROUP BY run), b AS (SELECT max(p) AS hi, min(p) AS lo FROM m WHERE run IN ('BUILDING', 'FURNITURE'))
    SELECT run, p, round(p - hi, 6) AS gap, CASE WHEN p - hi > hi - lo THEN 'exceeds' WHEN p < lo THEN 'worse' ELSE 'within noise' END AS verdict FROM m JOIN b ON TRUE WHERE run NOT IN ('BUILDING', 'FURNITURE')"""
)
def run_verdicts(spark, folder):
    """Macro averages against the spread of two baseline runs."""
    m = run_scores(spark, folder).groupBy("run").agg(F.round(F.avg("any_right"), 6).alias("p"))
    base = ["BUILDING", "FURNITURE"]
    # the spread is one row; a window over the runs would gather as few
    w = Window.partitionBy()
    inside = F.when(F.col("run").isin(base), F.col("p"))
    d = m.withColumn("hi", F.max(inside).over(w)).withColumn("lo", F.min(inside).over(w)).where(~F.col("run").isin(base))
    gap = F.col("p") - F.col("hi")
    return d.select("run", "p", F.round(gap, 6).alias("gap"), F.when(gap > F.col("hi") - F.col("lo"), "exceeds").when(F.col("p") < F.col("lo"), "worse").otherwise("within noise").alias("verdict"))


_POISSON = " + ".join(f"CASE WHEN v >= {t} THEN 1 ELSE 0 END" for t in R.POISSON)


@query(
    f"""WITH l AS (SELECT n_name AS bench, l_suppkey AS question, c_mktsegment AS run, l_returnflag = 'R' AS hit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT bench, question, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (WHERE run = 'BUILDING') - avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (WHERE run = 'MACHINERY') AS gap FROM l GROUP BY ALL),
    k AS (SELECT bench, gap, CAST('0x' || substr(md5('7|' || bench || '|' || question), 1, 8) AS BIGINT) % {R.PRIME} AS x, CAST('0x' || substr(md5('7|' || bench || '|' || question), 9, 8) AS BIGINT) % {R.PRIME} AS y FROM s WHERE gap IS NOT NULL),
    d AS (SELECT r.range AS round, bench, gap, (x + r.range * y) % {R.PRIME} AS v FROM k, range(2000) r), w AS (SELECT round, bench, gap, {_POISSON} AS w FROM d), m AS (SELECT round, bench, sum(w * gap) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL),
    e AS (SELECT round, avg(m) AS m FROM m GROUP BY round) SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, round(avg(m), 6) AS mean FROM e"""
)
def paired_bootstrap(spark, folder):
    """Interval of the gap between two runs by paired resampling of all questions, 2000 rounds.

    An order belongs to one run, so the questions are the suppliers, which the runs of a bench share; their lines are the samples.
    """
    li = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag")
    samples = li.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    o, c = table(spark, folder, "orders", "o_orderkey", "o_custkey"), table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    runs = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(table(spark, folder, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = samples.join(o.join(runs, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    part = lambda run, x: F.sum(F.when(F.col("c_mktsegment") == run, F.col(x)))
    s = d.groupBy(F.col("n_name").alias("bench"), F.col("l_suppkey").alias("question")).agg((part("BUILDING", "c") / part("BUILDING", "n")).alias("a"), (part("MACHINERY", "c") / part("MACHINERY", "n")).alias("b"))
    return R.bootstrap_gap(s, "bench", "question", "a", "b", 2000, 7)


@query(
    f"""SELECT coalesce(bench, 'Average') AS category, count(*) AS questions, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_GRID}) GROUP BY GROUPING SETS ((bench), ())"""
)
def category_accuracy(spark, folder):
    """Accuracy by category with the grand average."""
    r = grid(spark, folder).rollup("bench").agg(F.count("*").alias("questions"), F.round(F.avg((F.col("c") > 0).cast("double")), 6).alias("accuracy"))
    return r.select(F.coalesce("bench", F.lit("Average")).alias("category"), "questions", "accuracy")


_CELLS = ("mc", "numeric", "expression")


@query("SELECT domain, " + ", ".join(f"round(count(*) FILTER (WHERE answer_kind = '{k}') / count(*) FILTER (WHERE answer_kind IN {_CELLS}), 6) AS {k}" for k in _CELLS) + f" FROM audit_pool WHERE answer_kind IN {_CELLS} GROUP BY domain")
def kind_crosstab(spark, folder):
    """Kinds of answers by domain, as shares of the row."""
    p = table(spark, folder, "audit_pool", "domain", "answer_kind").where(F.col("answer_kind").isin(list(_CELLS))).groupBy("domain").pivot("answer_kind", list(_CELLS)).count().fillna(0, list(_CELLS))
    total = sum((F.col(k) for k in _CELLS), F.lit(0))
    return p.select("domain", *(F.round(F.col(k) / total, 6).alias(k) for k in _CELLS))


@query("SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cumulative, round(100 * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 4) AS percent FROM (SELECT CAST(floor(n_chars / 500) * 500 AS BIGINT) AS bucket, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL)")
def length_cdf(spark, folder):
    """Cumulative distribution of document lengths."""
    return R.length_cdf(table(spark, folder, "documents", "n_chars"), "n_chars", 500)


@query("SELECT domain, CAST(least(floor(tail_zlib_ratio * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM audit_pool WHERE tail_zlib_ratio BETWEEN 0 AND 1 GROUP BY ALL")
def ratio_histogram(spark, folder):
    """Fifty fixed bins of the compression ratio by domain."""
    df = table(spark, folder, "audit_pool", "domain", "tail_zlib_ratio").where("tail_zlib_ratio BETWEEN 0 AND 1")
    return df.groupBy("domain", F.least(F.floor(F.col("tail_zlib_ratio") * 50), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c}) AS least, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS q{int(100 * q)}" for q in (0.25, 0.5, 0.75)) + f", max({c}) AS most FROM (SELECT DISTINCT * FROM pool_scores)" for c in ("pass_rate", "r1_agreement")
    )
)
def score_summary(spark, folder):
    """Count, mean, deviation and quartiles of the score columns, from one pass."""
    s = table(spark, folder, "pool_scores").distinct()
    one = s.agg(*(F.struct(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("sd"), F.min(c).alias("least"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).alias("most")).alias(c) for c in ("pass_rate", "r1_agreement")))
    r = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("s")) for c in ("pass_rate", "r1_agreement")))).alias("r"))
    return r.select("r.measure", "r.s.n", "r.s.mean", "r.s.sd", "r.s.least", *(F.round(F.col("r.s.q")[k], 6).alias(f"q{25 * (k + 1)}") for k in range(3)), "r.s.most")


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) / count(*) OVER (PARTITION BY source) AS share FROM documents")
def source_cdf(spark, folder):
    """Each document's place in its source's lengths, from 0."""
    d = table(spark, folder, "documents", "doc_id", "source", "n_chars")
    # a length is a bucket (and a block of keys within it), so the largest source is spread over its lengths
    r = R.rank_by_buckets(d.fillna(2**62, ["n_chars"]), ["source"], [F.col("n_chars"), F.floor(F.col("doc_id") / 100_000)], [F.col("doc_id")], "place")
    size = d.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    return r.join(size, F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", ((F.col("place") - 1) / F.col("n")).alias("share"))


@query(
    """WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM d),
    w AS (SELECT *, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) AS w FROM k), s AS (SELECT a.event_type, a.k, sum(CASE WHEN b.k = 1 THEN pow(a.w, a.k - 1) * b.v ELSE (1 - a.w) * pow(a.w, a.k - b.k) * b.v END) AS y FROM w a JOIN w b ON a.event_type = b.event_type AND b.k <= a.k GROUP BY ALL)
    SELECT event_type, list(round(y, 6) ORDER BY k) AS smoothed FROM s GROUP BY event_type"""
)
def loss_smoothing(spark, folder):
    """Smoothed series of event values by type, in the order of time, to six places."""
    e = table(spark, folder, "events", "event_id", "ts", "event_type", "value")
    s = e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v")).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s"))
    return s.select("event_type", F.transform(R.smoothed(F.transform("s", lambda x: x["v"])), lambda y: F.round(y, 6)).alias("smoothed"))


@query(
    """WITH d AS (SELECT doc_id, domain, text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, domain, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM d),
    tf AS (SELECT doc_id, domain, term, count(*) AS tf FROM t WHERE term NOT IN ('the', 'and', 'for', 'that', 'with', 'this', 'are', 'not') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM d),
    w AS (SELECT doc_id, domain, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n), norm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM w GROUP BY doc_id), size AS (SELECT domain, count(*) AS size FROM d GROUP BY domain),
    m AS (SELECT w.domain, term, round(sum(x / norm) / any_value(size), 6) AS weight FROM w JOIN norm USING (doc_id) JOIN size ON w.domain = size.domain GROUP BY ALL)
    SELECT * FROM (SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY weight DESC, term) AS INTEGER) AS rank, term, weight FROM m) WHERE rank <= 8"""
)
def cluster_terms(spark, folder):
    """The eight weightiest words of each domain's documents by mean tf-idf."""
    d = table(spark, folder, "documents", "doc_id", "domain", "text").where("text IS NOT NULL")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    return R.term_weights(d, "doc_id", "domain", words, ("the", "and", "for", "that", "with", "this", "are", "not"), 8)


@query(
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings), c AS (SELECT label, dim, avg(x) AS v FROM e GROUP BY ALL),
    d AS (SELECT vec_id, label, sum((x - v) * (x - v)) AS dist FROM e JOIN c USING (label, dim) GROUP BY ALL)
    SELECT label, vec_id, rank, round(dist, 5) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 3"""
)
def nearest_to_centroid(spark, folder):
    """The three vectors nearest to each label's mean."""
    e = table(spark, folder, "embeddings")
    c = R.centroids(e, "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("center"))
    d = e.join(c, "label").withColumn("dist", R.squared_distance(F.col("embedding"), F.col("center")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("dist", "vec_id"))
    return d.withColumn("rank", rank).where("rank <= 3").select("label", "vec_id", "rank", F.round("dist", 5).alias("dist"))


@query()
def vector_clusters(spark, folder):
    """k-means of unit vectors: the best of four seeded starts; sizes of the clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    v = cut(e.select("vec_id", array_to_vector(F.transform("embedding", lambda x: (x / norm).cast("double"))).alias("features")))  # read by four fits
    models = [KMeans(k=10, seed=s, maxIter=20).fit(v) for s in range(4)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(v).groupBy(F.col("prediction").alias("cluster_id")).agg(F.count("*").alias("n"))


@query("SELECT min(n) AS least, median(n) AS mid, max(n) AS most FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def cluster_sizes(spark, folder):
    return table(spark, folder, "embeddings", "label").groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("mid"), F.max("n").alias("most"))
