"""Queries of sources and sinks by round trips, run discovery, prompts by benchmark, diagnostics and measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curata.functions import answers as A
from curata.functions import metrics as M
from curata.functions import text as T
from curata.functions import udfs as U
from curata.operators import dialogue as D
from curata.operators import relational as R
from curata.operators import sequences as S
from curata.operators import tools
from curata.plans.queries_audit import _GRID, grid, run_scores
from curata.plans.registry import query
from curata.plans.spread import spread
from curata.sources import files, readers, table
from curata.streaming import streams
from curata.streaming.streams import scratch

# Sources and sinks: each writes the rows in the delivered form below the session's shared folder and reads them back.


@query("SELECT CASE WHEN id % 2 = 0 THEN 'amc_even' ELSE 'dev:odd' END AS bench, row_number() OVER (PARTITION BY id % 2 ORDER BY id) - 1 AS i, trim(problem) AS question FROM amc")
def benchmark_union(spark, folder):
    """A benchmark and a development set as JSON lines with different keys, read as one table of (bench, i, question)."""
    at, amc = scratch(spark), table(spark, folder, "amc", "id", "problem")
    put = lambda rest, key, path: amc.where(F.col("id") % 2 == rest).coalesce(1).sortWithinPartitions("id").select(F.concat(F.lit(" "), "problem", F.lit(" ")).alias(key)).write.json(path)
    put(0, "problem", f"{at}/test/amc_even.jsonl")
    put(1, "Question", f"{at}/dev/odd.jsonl")
    return R.unions([readers.benchmark_questions(spark, f"{at}/test/*"), readers.benchmark_questions(spark, f"{at}/dev/*", "dev:")])


@query(f"SELECT lower(run) AS run, 'orders' AS bench, question, c, n FROM ({_GRID})")
def latest_results(spark, folder):
    """Results of runs, each with an older and a newer file: the last by name counts."""
    at = scratch(spark)
    g = grid(spark, folder).select(F.lower("run").alias("run"), "question", "c", "n")
    runs = [r.run for r in g.select("run").distinct().collect()]  # market segments
    for run in runs:
        mine = g.where(F.col("run") == run).drop("run").coalesce(1)
        mine.withColumn("c", F.lit(-1).cast("bigint")).write.json(f"{at}/tmp/{run}/old")
        mine.write.json(f"{at}/tmp/{run}/new")
        for age, name in (("old", "orders_2024.jsonl"), ("new", "orders_2025.jsonl")):
            part = files.listed(spark, f"{at}/tmp/{run}/{age}")[0]
            fs, source = files.handle(spark, part)
            _, target = files.handle(spark, f"{at}/runs/{run}/{name}")
            fs.mkdirs(target.getParent())
            fs.rename(source, target)
    return readers.run_results(spark, f"{at}/runs", ["orders"], "question bigint, c bigint, n bigint").select("run", "bench", "question", "c", "n")


@query("SELECT problem AS prompt, coalesce(question, '') AS predict, CAST(answer AS VARCHAR) AS label FROM amc")
def saved_predictions(spark, folder):
    """Predictions written as JSON lines and read again."""
    at = scratch(spark)
    readers.save_predictions(table(spark, folder, "amc"), "problem", "question", "answer", f"{at}/predictions")
    return readers.json_lines(spark, f"{at}/predictions", "prompt string, predict string, label string")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def tokenized_cache(spark, folder):
    """Documents as token ids (code points), made at the first call and read from the cache at the second."""
    at = scratch(spark)
    make = lambda: spread(table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")).select("doc_id", U.code_points("text").alias("ids"))
    files.made_once(spark, at, make, {"cutoff": 0})
    return files.made_once(spark, at, lambda: spark.range(0), {"cutoff": 0}).select("doc_id", F.size("ids").cast("bigint").alias("n"))


@query("SELECT lower(c_mktsegment) AS run, round(avg(c_acctbal), 3) AS acc FROM customer GROUP BY ALL")
def scraped_logs(spark, folder):
    """Scores scraped from text logs, one a run, with an earlier value and an unfinished log beside them."""
    at = scratch(spark)
    c = table(spark, folder, "customer", "c_mktsegment", "c_acctbal").groupBy(F.lower("c_mktsegment").alias("run")).agg(F.round(F.avg("c_acctbal"), 3).alias("acc"))
    for r in c.collect():  # market segments
        files.write_text(spark, f"{at}/log_{r.run}.txt", f"start\nAcc: 0.1\nPass@1: 0/1 = 0.0\nAcc: {r.acc}\nPass@1: 1/2 = 0.5\n")
    files.write_text(spark, f"{at}/log_unfinished.txt", "start\n")
    return readers.log_scores(spark, at).select(F.regexp_extract("file", "log_([a-z]+)\\.txt$", 1).alias("run"), "acc")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def table_formats(spark, folder):
    """A table written as CSV with a header and read through a registry entry."""
    at, s = scratch(spark), table(spark, folder, "supplier", "s_suppkey", "s_name", "s_acctbal")
    s.write.option("header", True).csv(f"{at}/csv")
    registry = readers.Registry(f"{at}/registry.json", spark)
    registry.put(readers.Dataset("suppliers", f"{at}/csv"))
    d = readers.load(spark, registry.get("suppliers"))
    return d.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("SELECT pool_idx, domain FROM audit_pool WHERE flagged")
def rebuilt_subset(spark, folder):
    """A subset written with the fingerprint of its keys and rebuilt from its source by them."""
    at, p = scratch(spark), table(spark, folder, "audit_pool", "pool_idx", "domain", "flagged")
    s = p.where("flagged").drop("flagged")
    readers.write_subset(s, "pool_idx", s.count(), f"{at}/subset", "pool_idx")
    return readers.read_subset(spark, p.drop("flagged"), "pool_idx", f"{at}/subset")


@query("SELECT row_number() OVER (ORDER BY md5('3|' || id), id) - 1 AS pos, id, answer FROM amc")
def ordered_gather(spark, folder):
    """Items by a list of keys, in the list's order."""
    amc = table(spark, folder, "amc", "id", "answer")
    h = R.seeded_key(F.col("id"), seed=3)
    ids = amc.select("id", (F.row_number().over(Window.orderBy(h, "id")) - 1).cast("bigint").alias("pos"))  # the list is given; here of the 240 items
    return readers.gathered(amc, "id", ids, "pos")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, 0 AS p FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lower(source), 1 FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) = 1")
def first_source_wins(spark, folder):
    """Two overlapping sources as one, a key's row from the first that has it."""
    d = table(spark, folder, "documents", "doc_id", "source", "lang")
    return readers.first_wins([d.where("lang = 'en'").select("doc_id", "source"), d.select("doc_id", F.lower("source").alias("source"))], "doc_id")


@query("SELECT id, problem FROM amc WHERE id < 100")
def capped_samples(spark, folder):
    """At most a number of samples, by position."""
    return readers.first_samples(table(spark, folder, "amc", "id", "problem"), "id", 100)


@query("SELECT 'L' || CAST(o_orderkey % 7 AS VARCHAR) AS level, count(*) AS n FROM orders WHERE o_orderkey % 7 = 5 AND (CAST(year(o_orderdate) AS VARCHAR) LIKE '%199%' OR CAST(year(o_orderdate) AS VARCHAR) LIKE '%202%') AND NOT contains(o_orderpriority, ';') GROUP BY ALL")
def question_filters(spark, folder):
    """Questions of one level, of some years by text, and without several answers."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderpriority").withColumn("level", F.concat(F.lit("L"), F.col("o_orderkey") % 7))
    years = F.year("o_orderdate").cast("string")
    return o.where((F.col("level") == "L5") & (F.contains(years, F.lit("199")) | F.contains(years, F.lit("202"))) & ~F.contains("o_orderpriority", F.lit(";"))).groupBy("level").agg(F.count("*").alias("n"))


# Filters, orders, averages


@query("SELECT CASE WHEN domain IN ('math', 'code') THEN domain ELSE 'other' END AS domain, count(*) AS n FROM audit_pool GROUP BY ALL")
def mapped_domains(spark, folder):
    """Domains as math, code or other."""
    d = F.col("domain")
    return table(spark, folder, "audit_pool", "domain").select(F.when(d.isin("math", "code"), d).otherwise("other").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT pool_idx FROM audit_pool WHERE domain IN ('math', 'code') AND answer_kind IN ('numeric', 'expression') AND total_tokens >= 200 AND total_tokens <= 2000 AND dup_count <= 3 AND has_boxed = TRUE AND flagged = FALSE")
def pool_slice(spark, folder):
    """An interactive slice of the pool: members, closed ranges, flags."""
    p = table(spark, folder, "audit_pool", "pool_idx", "domain", "answer_kind", "total_tokens", "dup_count", "has_boxed", "flagged")
    return R.slice_of(p, {"domain": ["math", "code"], "answer_kind": ["numeric", "expression"]}, {"total_tokens": (200, 2000), "dup_count": (None, 3)}, {"has_boxed": True, "flagged": False}).select("pool_idx")


_RUN_NAMES = "CASE o_orderkey % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'base_lora' WHEN 2 THEN 'random_s1' WHEN 3 THEN 'random_s1_long_x' WHEN 4 THEN 'crashed_7' ELSE 'mytest_2' END"


@query(f"WITH r AS (SELECT {_RUN_NAMES} AS run, o_totalprice AS x FROM orders) SELECT CASE WHEN run LIKE 'base%' THEN 'base' ELSE 'random_s1' END AS base, count(*) AS n, round(avg(x), 4) AS score FROM r WHERE run NOT LIKE '%crashed%' AND run NOT LIKE '%test%' GROUP BY ALL")
def merged_runs(spark, folder):
    """Runs without crashed and test ones, tagged copies folded into their run."""
    o = table(spark, folder, "orders", "o_orderkey", "o_totalprice").select(F.expr(_RUN_NAMES).alias("run"), "o_totalprice")
    return R.folded_runs(o, "run").groupBy("base").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score"))


@query("SELECT * FROM (VALUES (1, 'base'), (2, 'random_s1'), (3, 'random_s2'), (4, 'advanced'), (5, 'zeta')) v(place, run)")
def ordered_runs(spark, folder):
    """The order of a table of results: the base, the random runs, the others by name."""
    d = spark.createDataFrame([(r,) for r in ("zeta", "random_s2", "base", "advanced", "random_s1")], "run string")
    return d.select(F.row_number().over(Window.orderBy(R.run_order(F.col("run")))).alias("place"), "run")  # a table of results


_SCORES = f"(SELECT run, bench, round(avg(c / n), 6) AS p FROM ({_GRID}) WHERE NOT (run = 'MACHINERY' AND bench = 'FRANCE') GROUP BY ALL)"


@query(f"SELECT run, CASE WHEN count(*) FILTER (WHERE bench IN ('FRANCE', 'PERU', 'CHINA')) = 3 THEN round(avg(p) FILTER (WHERE bench IN ('FRANCE', 'PERU', 'CHINA')), 6) END AS average FROM {_SCORES} GROUP BY run")
def required_average(spark, folder):
    """Macro averages over required benches; a run that misses one has none."""
    s = run_scores(spark, folder).where("NOT (run = 'MACHINERY' AND bench = 'FRANCE')")
    return R.macro_average(s, "run", "bench", "pass1", ["FRANCE", "PERU", "CHINA"])


@query("SELECT p_brand AS bench, src AS priority, score FROM (SELECT p_brand, p_size % 3 AS src, CASE WHEN sum(p_retailprice) % 2 < 1 THEN NULL ELSE round(max(p_retailprice), 2) END AS score FROM part GROUP BY ALL) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY src) = 1")
def finished_scores(spark, folder):
    """Of each bench the score of the first source that has finished."""
    p = table(spark, folder, "part", "p_brand", "p_size", "p_retailprice").groupBy(F.col("p_brand").alias("bench"), (F.col("p_size") % 3).alias("priority"))
    s = p.agg(F.when(F.sum("p_retailprice") % 2 < 1, None).otherwise(F.round(F.max("p_retailprice"), 2)).alias("score"))
    return R.first_finished(s, ["bench"], "priority", "score").select("bench", "priority", "score")


_LOOP = "max_line_repeat >= 25 OR tail_zlib_ratio < 0.10"


@query(
    f"""SELECT domain, quantile_cont(resp_tokens, 0.5) AS p50, quantile_cont(resp_tokens, 0.9) AS p90, round(avg(CASE WHEN resp_tokens >= 1000 THEN 1.0 WHEN resp_tokens IS NULL THEN NULL ELSE 0.0 END), 6) AS hit_max, round(avg(CASE WHEN has_boxed THEN 0.0 WHEN NOT has_boxed THEN 1.0 END), 6) AS no_boxed,
    round(avg(CASE WHEN {_LOOP} THEN 1.0 WHEN NOT ({_LOOP}) THEN 0.0 END), 6) AS loop, round(avg(CASE WHEN has_boxed THEN CASE WHEN contam THEN 1.0 WHEN NOT contam THEN 0.0 END END), 6) AS right_boxed, round(avg(CASE WHEN NOT has_boxed THEN CASE WHEN contam THEN 1.0 WHEN NOT contam THEN 0.0 END END), 6) AS right_unboxed FROM audit_pool GROUP BY domain"""
)
def output_diagnostics(spark, folder):
    """Lengths, shares at the limit, without box and looping, and rates of the boxed and unboxed outputs by domain."""
    p = table(spark, folder, "audit_pool", "domain", "resp_tokens", "has_boxed", "max_line_repeat", "tail_zlib_ratio", "contam")
    return R.diagnostics(p, ["domain"], "resp_tokens", 1000, F.col("has_boxed"), F.expr(_LOOP), F.col("contam"))


@query("SELECT source, count(*) AS candidates, count(*) FILTER (WHERE n_chars >= 200 AND lang IS NOT NULL) AS kept FROM documents GROUP BY source")
def set_manifest(spark, folder):
    """Candidates and kept rows of each set."""
    d = table(spark, folder, "documents", "source", "n_chars", "lang")
    return d.groupBy("source").agg(F.count("*").alias("candidates"), F.count_if(F.expr("n_chars >= 200 AND lang IS NOT NULL")).alias("kept"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean FROM (SELECT DISTINCT * FROM pool_scores)" for c in ("base_cap_frac", "base_mean_tokens", "pass_rate", "r1_agreement")))
def metric_means(spark, folder):
    """Means of all measures of a table, by name."""
    names = ["base_cap_frac", "base_mean_tokens", "pass_rate", "r1_agreement"]
    s = table(spark, folder, "pool_scores").distinct().agg(*(F.round(F.avg(c), 6).alias(c) for c in names))
    return s.unpivot([], names, "metric", "mean")


# Functions and measures


@query(r"SELECT pool_idx, CAST(len(regexp_extract_all(coalesce(prompt, ''), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS BIGINT) AS n FROM audit_pool WHERE regexp_full_match(coalesce(prompt, ''), '[\x00-\x7F]*')")
def token_lengths(spark, folder):
    """Tokens of the ASCII prompts by the default tokenizer; another is a parameter."""
    p = table(spark, folder, "audit_pool", "pool_idx", "prompt").where(F.coalesce("prompt", F.lit("")).rlike("^[\\x00-\\x7F]*$"))
    return spread(p).select("pool_idx", U.token_lengths()("prompt").alias("n"))


@query("SELECT a.rep_pool_idx, a.k, CASE WHEN TRY_CAST(replace(x, ',', '') AS DOUBLE) IS NOT NULL AND TRY_CAST(replace(g, ',', '') AS DOUBLE) IS NOT NULL THEN abs(TRY_CAST(replace(x, ',', '') AS DOUBLE) - TRY_CAST(replace(g, ',', '') AS DOUBLE)) <= 1e-5 ELSE trim(x) = trim(g) END AS right_ FROM (SELECT rep_pool_idx, unnest(answers) AS x, CAST(unnest(range(len(answers))) AS INTEGER) AS k FROM (SELECT DISTINCT * FROM generations)) a JOIN (SELECT pool_idx, r1_answer AS g FROM audit_pool WHERE r1_answer IS NOT NULL) p ON pool_idx = rep_pool_idx WHERE x IS NOT NULL")
def simple_grades(spark, folder):
    """Sampled answers graded by number or spelling alone; distinct pairs once."""
    g = table(spark, folder, "generations").distinct().select("rep_pool_idx", F.posexplode("answers").alias("k", "x")).where("x IS NOT NULL")
    p = table(spark, folder, "audit_pool", F.col("pool_idx").alias("rep_pool_idx"), F.col("r1_answer").alias("g")).where("g IS NOT NULL")
    d = g.join(p, "rep_pool_idx")
    pairs = d.select("x", "g").distinct().withColumn("right_", U.simply_equal("x", "g"))
    return d.join(pairs, ["x", "g"]).select("rep_pool_idx", "k", "right_")


#: Pairs of expressions and whether they are the same, worked out by hand.
_PAIRS = [
    ("x+1", "1+x", True), ("(x+1)^2", "x^2+2x+1", True), ("\\frac{1}{x-1}-\\frac{1}{x+1}", "\\frac{2}{x^2-1}", True), ("\\sqrt{8}", "2\\sqrt2", True), ("x+1", "x+2", False), ("\\sin^2x+\\cos^2x", "1", True),
    ("y=2x+1", "2x-y+1=0", True), ("y=2x+1", "y=2x", False), ("\\log_2 8", "3", True), ("e^{i\\pi}", "-1", True), ("ab", "ba", True), ("\\frac{x}{y}", "\\frac{y}{x}", False), ("2^{10}", "1024", True), ("n!", "n", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {same})" for a, b, same in _PAIRS) + ") v(a, b, same)")
def expression_grades(spark, folder):
    """Pairs of expressions and equations judged as functions of their names."""
    d = spark.createDataFrame([(a, b) for a, b, _ in _PAIRS], "a string, b string")
    return d.select("a", "b", U.latex_equal("a", "b").alias("same"))


@query("SELECT id, 'True' AS answer FROM amc WHERE id % 3 = 0 UNION ALL SELECT id, '(b)' FROM amc WHERE id % 3 = 1 UNION ALL SELECT id, CAST(CAST(answer AS BIGINT) AS VARCHAR) FROM amc WHERE id % 3 = 2 AND answer = floor(answer)")
def theorem_answers(spark, folder):
    """Answers of theorem questions out of sentences: truth, option, number with a unit."""
    a = table(spark, folder, "amc", "id", "answer").where("id % 3 <> 2 OR answer = floor(answer)")
    said = F.when(F.col("id") % 3 == 0, "Hence the answer is True.").when(F.col("id") % 3 == 1, "so the option is (B)").otherwise(F.concat(F.lit("The answer is "), F.col("answer").cast("bigint"), F.lit(" cm.")))
    return a.select("id", U.theorem_answers(said).alias("answer"))


@query("SELECT id, '\\begin{pmatrix}' || CAST(id AS VARCHAR) || '\\' || CAST(id + 1 AS VARCHAR) || '\\end{pmatrix}' AS matrix FROM amc")
def set_matrices(spark, folder):
    """Sets as column matrices."""
    return table(spark, folder, "amc", "id").select("id", A.sets_as_matrices(F.concat(F.lit(" {"), "id", F.lit(","), F.col("id") + 1, F.lit("} "))).alias("matrix"))


@query("SELECT c_custkey AS ckey, c_name AS cname FROM (SELECT c_custkey, c_name FROM customer)")
def lowered_keys(spark, folder):
    """Columns by lower-cased names."""
    d = table(spark, folder, "customer", F.col("c_custkey").alias("CKey"), F.col("c_name").alias("CName"))
    return d.toDF(*T.keys_lowered(d.columns))


_MODULES = [("even", "Solve: {q}", "END"), ("odd", "Question: {q}\nAnswer:", "")]


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'Solve: ' || problem || 'END' ELSE 'Question: ' || problem || chr(10) || 'Answer:' END AS prompt FROM amc WHERE problem IS NOT NULL")
def prompts_by_bench(spark, folder):
    """Prompts by a table of each bench's own pattern, sent along: it has as many rows as benches."""
    m = spark.createDataFrame([(b, *p.split("{q}"), end) for b, p, end in _MODULES], "bench string, head string, tail string, stop string")
    q = table(spark, folder, "amc", "id", "problem").where("problem IS NOT NULL").withColumn("bench", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return q.join(F.broadcast(m), "bench").select("id", F.concat("head", "problem", "tail", "stop").alias("prompt"))


@query("SELECT plan_id, 3 * (2e0 * (32 * (2 * 4096e0 * 4096 + 2 * 4096e0 * 1024 + 3 * 4096e0 * 14336) + 4096e0 * 128256) * 1000000 + 4e0 * 32 * 4096 * capacity_tokens * 1000000) AS flops FROM pack_plans")
def training_flops(spark, folder):
    """Operations of a training step over a million tokens at each capacity."""
    p = table(spark, folder, "pack_plans")
    return p.select("plan_id", M.model_flops(F.lit(1_000_000), F.col("capacity_tokens"), 32, 4096, 14336, 128256, 32, 8).alias("flops"))


@query("SELECT label, avg(CASE WHEN embedding[1] > embedding[2] THEN 1.0 ELSE 0.0 END) AS accuracy FROM embeddings GROUP BY label")
def preference_accuracy(spark, folder):
    """How often the chosen side scores higher."""
    return table(spark, folder, "embeddings", "embedding", "label").groupBy("label").agg(F.avg(M.chosen_first(F.col("embedding")[0], F.col("embedding")[1])).alias("accuracy"))


@query("SELECT event_type, round(sum(value) * 3 / date_diff('second', min(ts), max(ts)), 6) AS tokens_per_second FROM events GROUP BY event_type HAVING date_diff('second', min(ts), max(ts)) > 0")
def effective_speed(spark, folder):
    """Tokens a second of three epochs."""
    e = table(spark, folder, "events", "event_type", "ts", "value").groupBy("event_type").agg(F.sum("value").alias("t"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("s"))
    return e.where("s > 0").select("event_type", F.round(M.tokens_per_second(F.col("t"), F.lit(3), F.col("s")), 6).alias("tokens_per_second"))


@query("SELECT pool_idx, CASE WHEN len(w) > 1 AND n > 0 THEN round(hit / n, 6) END AS accuracy FROM (SELECT pool_idx, w, len(list_filter(range(2, len(w) + 1), lambda i: w[i] % 3 <> 0)) AS n, len(list_filter(range(2, len(w) + 1), lambda i: w[i] % 3 <> 0 AND w[i - 1] = w[i])) AS hit FROM (SELECT rep_pool_idx AS pool_idx, gen_tokens AS w FROM (SELECT DISTINCT * FROM generations)))")
def token_accuracies(spark, folder):
    """Share of labelled places that the place before predicts; every third value has no label."""
    g = table(spark, folder, "generations").distinct().select(F.col("rep_pool_idx").alias("pool_idx"), F.col("gen_tokens").alias("w"))
    labels = F.transform("w", lambda x: F.when(x % 3 == 0, F.lit(S.IGNORE)).otherwise(x))
    return g.select("pool_idx", F.round(S.token_accuracy(F.col("w"), labels), 6).alias("accuracy"))


@query("SELECT o_orderkey, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS ones FROM (SELECT l_orderkey AS o_orderkey, CAST(l_quantity AS INTEGER) % 5 + 1 AS n FROM lineitem) GROUP BY o_orderkey")
def block_masks(spark, folder):
    """Places that may look at each other under the block-diagonal mask of an order's lines."""
    li = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    parts = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("int") % 5 + 1).alias("n")))).alias("p"))
    mask = F.flatten(F.transform("p", lambda x, i: F.array_repeat(i + 1, x["n"])))
    m = parts.select("o_orderkey", mask.alias("mask")).select("o_orderkey", S.block_mask(F.col("mask")).alias("m"))
    return m.select("o_orderkey", F.aggregate(F.flatten("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ones"))


@query("WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings), c AS (SELECT label, dim, avg(x) AS v FROM e GROUP BY ALL), d AS (SELECT vec_id, c.label AS cluster, sqrt(sum((x - v) * (x - v))) AS dist FROM e JOIN c USING (dim) GROUP BY ALL) SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, round(dist, 5) AS distance, CAST((SELECT count(DISTINCT label) FROM embeddings) AS INTEGER) AS n FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1")
def centroid_assignment(spark, folder):
    """Each vector's nearest of all labels' means, with its distance to every one counted."""
    e = table(spark, folder, "embeddings", "vec_id", "label", "embedding")
    c = R.centroids(e, "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("v"))
    centers = sorted((int(r.label), r.v) for r in c.collect())  # as many as labels
    a = R.assigned(e, "vec_id", "embedding", centers)
    return a.select("vec_id", F.col("cluster").cast("int").alias("cluster"), F.round("distance", 5).alias("distance"), F.size("distances").alias("n"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN id % 3 = 0 THEN 'open' END AS tool, CASE WHEN id % 3 = 0 THEN url END AS url FROM amc")
def called_tools(spark, folder):
    """Tools and arguments of the calls found in texts."""
    a = table(spark, folder, "amc", "id", "url")
    call = F.concat(F.lit('<tool_call>\n{"name": "open", "arguments": {"url": "'), "url", F.lit('"}}\n</tool_call>'))
    c = a.select("id", tools.extract_calls("qwen")(F.when(F.col("id") % 3 == 0, call).otherwise(F.col("url"))).alias("calls"))
    first = F.try_element_at("calls", F.lit(1))
    return c.select("id", F.coalesce(F.size("calls"), F.lit(0)).alias("n"), first["name"].alias("tool"), F.get_json_object(first["arguments"], "$.url").alias("url"))


@query("SELECT doc_id, ['/media/' || source || '/1.png', 'https://x/' || source] AS paths FROM documents WHERE source IS NOT NULL")
def media_files(spark, folder):
    """Media names below a folder; addresses stay."""
    d = table(spark, folder, "documents", "doc_id", "source").where("source IS NOT NULL")
    names = F.array(F.concat("source", F.lit("/1.png")), F.concat(F.lit("https://x/"), "source"))
    return d.select("doc_id", readers.media_paths(names, "/media/").alias("paths"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'Yes' ELSE '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || 'Yes' END AS target FROM amc")
def thought_targets(spark, folder):
    """Answers of a reasoning template: an empty thought is put before one without, if thinking is off."""
    a = table(spark, folder, "amc", "id")
    return a.select("id", F.when(F.col("id") % 2 == 0, D.with_thought(F.lit("Yes"), None)).otherwise(D.with_thought(F.lit("Yes"), False)).alias("target"))




@query("SELECT pool_idx FROM audit_pool ORDER BY pool_idx LIMIT 50 OFFSET 100")
def example_slice(spark, folder):
    """The examples of a slice [start, end) in the order of their keys."""
    return readers.page(table(spark, folder, "audit_pool", "pool_idx"), "pool_idx", 2, 50)


@query("SELECT id, trim(problem) AS question, CAST(answer AS VARCHAR) AS reply, CAST(2 AS INTEGER) AS n FROM amc WHERE problem IS NOT NULL")
def embedded_transcripts(spark, folder):
    """Turns of transcripts written into one text."""
    a = table(spark, folder, "amc", "id", "problem", "answer").where("problem IS NOT NULL")
    t = a.select("id", readers.embedded_turns(F.concat(F.lit("Talk. Human: "), "problem", F.lit("\nAssistant: "), F.col("answer").cast("string"))).alias("t"))
    return t.select("id", F.col("t")[0]["content"].alias("question"), F.col("t")[1]["content"].alias("reply"), F.size("t").alias("n"))


_SIDE = "CASE WHEN w * h > 1000000 THEN sqrt(1e6 / (w * h)) ELSE 1.0 END"


@query(
    f"""WITH a AS (SELECT p_partkey, p_size * 100 AS w, CAST(floor(p_retailprice) AS INTEGER) AS h FROM part), b AS (SELECT p_partkey, CAST(floor(w * {_SIDE}) AS INTEGER) AS w, CAST(floor(h * {_SIDE}) AS INTEGER) AS h FROM a)
    SELECT p_partkey, CAST(floor(w * CASE WHEN w * h < 400000 THEN sqrt(4e5 / (w * h)) ELSE 1.0 END) AS INTEGER) AS width, CAST(floor(h * CASE WHEN w * h < 400000 THEN sqrt(4e5 / (w * h)) ELSE 1.0 END) AS INTEGER) AS height FROM b"""
)
def image_sizes(spark, folder):
    """Sizes of images scaled into bounds of pixels."""
    p = table(spark, folder, "part", "p_partkey", "p_size", "p_retailprice")
    return p.select("p_partkey", D.image_size(F.col("p_size") * 100, F.col("p_retailprice").cast("int"), 1_000_000, 400_000).alias("s")).select("p_partkey", "s.*")


#: Pairs of answers and whether they grade as the same, worked out by hand.
_ANSWERS = [
    ("\\dfrac{1}{2}", "0.5", True), ("50\\%", "0.5", True), ("(1, 2)", "(1,2)", True), ("(2,1)", "(1,2)", False), ("x = 3", "3", True), ("1,000", "1000", True), ("7", "8", False), ("12 cm", "12", True), ("3/2, 1.6", "8/5, 1.5", True), ("1,1,2", "1,2,2", False),
    ("twelve", "12", True), ("[0, \\infty)", "[0,inf)", True), ("(0,1)", "[0,1)", False), ("the answer is B", "B", True), ("", "1", False), ("2x+1=3y", "3y=2x+1", True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {same})" for a, b, same in _ANSWERS) + ") v(pred, gold, same)")
def answer_grades(spark, folder):
    """Pairs of answers judged by the full cascade."""
    d = spark.createDataFrame([(a, b) for a, b, _ in _ANSWERS], "pred string, gold string")
    return d.select("pred", "gold", U.answers_equal("pred", "gold").alias("same"))


@query("SELECT CAST(pool_idx // 1000 AS BIGINT) AS batch_id, count(*) AS n_sequences, CAST(sum(length(r1_answer)) AS BIGINT) AS tokens, TRUE AS fits FROM audit_pool WHERE length(r1_answer) BETWEEN 1 AND 64 GROUP BY ALL")
def packed_totals(spark, folder):
    """Greedy packing by batches keeps every sequence that fits, all its tokens, and the capacity."""
    a = table(spark, folder, "audit_pool", "pool_idx", "r1_answer").where("r1_answer IS NOT NULL AND r1_answer <> ''").select("pool_idx", S.words_as_ids(F.col("r1_answer")).alias("ids"))
    p = S.pack_batches(a, "pool_idx", "ids", 64)
    return p.groupBy("batch_id").agg(F.sum("n_sequences").alias("n_sequences"), F.sum("tokens").alias("tokens"), F.bool_and((F.col("tokens") <= 64) & (F.size("input_ids") == 64)).alias("fits"))


@query("SELECT 'taken' AS side, 100 AS n UNION ALL SELECT 'rest', count(*) - 100 FROM events")
def stream_split(spark, folder):
    """The first hundred rows of a stream and all that follow."""
    taken, rest = streams.take_skip(streams.source(spark, f"{folder}/events.parquet"), "event_id", 100)
    return R.unions([df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n") for side, df in (("taken", taken), ("rest", rest))])


@query("SELECT event_id, 'events' AS stream, 2 * value AS value FROM events UNION ALL SELECT o_orderkey, 'orders', 2 * o_totalprice FROM orders")
def interleaved_streams(spark, folder):
    """Two streams as one, mapped by a function of whole batches."""
    e = streams.source(spark, f"{folder}/events.parquet").select("event_id", "value")
    o = streams.source(spark, f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("value"))
    both = streams.interleaved({"events": e, "orders": o}).select("event_id", "stream", "value")
    return streams.run(streams.mapped(both, lambda pdf: pdf.assign(value=2 * pdf["value"]), "event_id bigint, stream string, value double"))


@query("SELECT event_id, TRUE AS ordered FROM events")
def shuffled_stream(spark, folder):
    """A stream's rows in a seeded order inside each batch: every row once, places ascending with the hash."""
    s = streams.shuffled(streams.source(spark, f"{folder}/events.parquet").select("event_id"), "event_id", 3)
    return s.select("event_id", (F.col("place") == F.xxhash64("event_id", (F.col("batch") + 3).cast("int"))).alias("ordered"))
