"""Queries of presets, formats, measures and encoders of the second rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import answers as A
from curata.functions import metrics as M
from curata.operators import relational as R
from curata.operators import sequences as S
from curata.plans.queries_select import _COLS, _SCORED, _key, _quality, scored
from curata.plans.registry import query
from curata.sources import table


def _nested(start: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        start = "replace({}, '{}', '{}')".format(start, a.replace("'", "''"), b.replace("'", "''"))
    return start


_TOLD = _nested("list_extract(string_split(r1_answer, '='), -1)", [*A.REPLACED, *((x, "") for x in A.REMOVED)])
_HELD = "CASE WHEN len(string_split(t, '$')) > 2 THEN list_extract(string_split(t, '$'), 2) ELSE t END"
for _w in ("text", "textbf", "overline"):
    _HELD = f"regexp_replace({_HELD}, '\\\\{_w}\\{{([^}}\n]*)\\}}', '\\1', 'g')"
_HELD = f"regexp_replace({_HELD}, '\\\\boxed\\{{(.*)\\}}', '\\1', 'g')"
_HELD = f"regexp_replace(regexp_replace({_HELD}, 'frac([^{{])(.)', 'frac{{\\1}}{{\\2}}', 'g'), 'sqrt([^{{])', 'sqrt{{\\1}}', 'g')"


@query(
    f"""WITH a AS (SELECT pool_idx, {_TOLD} AS t FROM audit_pool WHERE r1_answer IS NOT NULL), b AS (SELECT pool_idx, replace({_HELD}, '$', '') AS x FROM a)
    SELECT pool_idx, CASE WHEN regexp_matches(replace(x, ',', ''), '^[0-9]+$') THEN replace(x, ',', '') WHEN regexp_matches(x, '^[0-9]+(\\.00?%?|%)$') THEN regexp_extract(x, '^[0-9]+') WHEN regexp_matches(x, '^[A-Ga-g]$') THEN lower(x) ELSE x END AS answer FROM b"""
)
def normal_final_answers(spark, folder):
    """Answers in the normal form of quantitative benchmarks."""
    return table(spark, folder, "audit_pool", "pool_idx", "r1_answer").where("r1_answer IS NOT NULL").select("pool_idx", A.final_answer(F.col("r1_answer")).alias("answer"))


@query("SELECT id, 'Question: 1 + 1?' || chr(10) || 'Answer: 2' || chr(10) || chr(10) || chr(10) || 'Question: ' || problem || chr(10) || 'Answer:' AS prompt FROM amc")
def few_shot_prompts(spark, folder):
    """Items in a prompt format after one worked example."""
    return table(spark, folder, "amc", "id", "problem").select("id", A.formatted("cot", F.col("problem"), [("1 + 1?", "2")]).alias("prompt"))


def _preset(low: float, high: float, noise: bool) -> str:
    band = "TRUE" if (low, high) == (0, 1) else f"pass_rate BETWEEN {low} - 1e-9 AND {high} + 1e-9"
    rule = "NOT coalesce(pass_rate = 0 AND r1_agreement IS NOT NULL AND NOT coalesce(r1_in_majority, FALSE), FALSE)" if noise else "TRUE"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY r1_in_majority DESC NULLS LAST, {_key(42, 'pool_idx')}, pool_idx) AS rn FROM {_SCORED} WHERE {_quality()} AND {band} AND {rule} AND prompt_hash IS NOT NULL) WHERE rn = 1"


_PICKS = {
    "filter_only": f"SELECT pool_idx FROM ({_preset(0, 1, False)}) ORDER BY {_key(42, 'pool_idx')}, pool_idx LIMIT 300",
    "filter_difficulty": f"SELECT pool_idx FROM ({_preset(0.25, 0.75, True)}) ORDER BY {_key(42, 'pool_idx')}, pool_idx LIMIT 300",
    "full_method": f"SELECT pool_idx FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_key(42, 'pool_idx')}, pool_idx) AS k FROM ({_preset(0.25, 0.75, True)}) WHERE cluster_id >= 0) ORDER BY k, cluster_id LIMIT 300",
    "hardest_only": f"SELECT pool_idx FROM ({_preset(0, 0.25, True)}) ORDER BY pass_rate, {_key(42, 'pool_idx')}, pool_idx LIMIT 300",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS preset, pool_idx FROM ({q})" for k, q in _PICKS.items()))
def preset_selections(spark, folder):
    """The named selections at a size of 300."""
    from dataclasses import replace

    rows = scored(spark, folder, *_COLS).where(_quality())
    return R.unions([R.select(rows, replace(how, total=300)).select(F.lit(name).alias("preset"), "pool_idx") for name, how in R.PRESETS.items()])


@query(
    """WITH p AS (SELECT id, 'amc' AS g, row_number() OVER (ORDER BY md5('5|' || id), id) AS shot FROM amc) SELECT a.id AS question, p.id AS example, CAST(p.shot AS BIGINT) AS shot FROM amc a JOIN p ON p.shot <= 3"""
)
def few_shot_examples(spark, folder):
    """Three examples for each question, drawn by seed."""
    a = table(spark, folder, "amc", "id").withColumn("g", F.lit("amc"))
    return R.few_shot(a.withColumnRenamed("id", "question"), "question", a.withColumnRenamed("id", "example"), "example", "g", 3, 5).withColumn("shot", F.col("shot").cast("bigint"))


@query(
    """SELECT coalesce(a.pool_idx, b.pool_idx) AS pool_idx, a.flagged AS before, b.flagged AS after FROM (SELECT pool_idx, flagged FROM audit_pool) a FULL JOIN
    (SELECT pool_idx, flag_repetition OR flag_malformed AS flagged FROM audit_pool WHERE domain IS NOT NULL) b ON a.pool_idx = b.pool_idx WHERE a.flagged IS DISTINCT FROM b.flagged"""
)
def changed_verdicts(spark, folder):
    """Rows whose flag changes under another rule."""
    d = table(spark, folder, "audit_pool", "pool_idx", "domain", "flagged", "flag_repetition", "flag_malformed")
    other = d.where("domain IS NOT NULL").select("pool_idx", (F.col("flag_repetition") | F.col("flag_malformed")).alias("flagged"))
    return R.verdict_changes(d, other, ["pool_idx"], "flagged")


@query("SELECT vec_id, chr(CAST(64 + list_position(list_slice(embedding, 1, 4), list_max(list_slice(embedding, 1, 4))) AS INTEGER)) AS letter FROM embeddings")
def chosen_letters(spark, folder):
    """The letter of the highest of four scores."""
    return table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", M.letter_of(F.slice("embedding", 1, 4)).alias("letter"))


@query("SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / len(embedding)), 9) AS perplexity FROM embeddings")
def perplexities(spark, folder):
    """Perplexity of a sequence of log-probabilities (here: negative magnitudes of a vector) with every label used."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    logp = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    labels = F.array_repeat(F.lit(1), F.size("embedding") + 1)
    return e.select("vec_id", F.round(M.perplexity(logp, labels), 9).alias("perplexity"))


_AB = "CASE WHEN t * 2 < 120 THEN 120 WHEN s * 2 < 120 THEN 120 - s ELSE floor(120 * (t / (s + t))) END"


@query(
    f"""WITH l AS (SELECT id, length(problem) AS s, length(CAST(answer AS VARCHAR)) AS a, length(url) AS b, greatest(length(CAST(answer AS VARCHAR)), length(url)) AS t FROM amc), k AS (SELECT *, least({_AB}, t) AS keep FROM l)
    SELECT id, CAST(least(greatest(120 - keep, 0), s) + least(a, keep) AS INTEGER) AS n_chosen, CAST(least(greatest(120 - keep, 0), s) + least(b, keep) AS INTEGER) AS n_rejected, CAST(least(a, keep) AS INTEGER) AS n_chosen_labels FROM k"""
)
def encoded_preferences(spark, folder):
    """Prompt, chosen and rejected answer in one budget of 120."""
    a = table(spark, folder, "amc", "id", "problem", "answer", "url")
    e = a.select("id", S.encode_preference(S.words_as_ids(F.col("problem")), S.words_as_ids(F.col("answer").cast("string")), S.words_as_ids(F.col("url")), 120).alias("e"))
    return e.select("id", F.size("e.chosen_ids").alias("n_chosen"), F.size("e.rejected_ids").alias("n_rejected"), M.labelled(F.col("e.chosen_labels")).alias("n_chosen_labels"))


@query("SELECT round(sum(CASE WHEN length(r1_answer) > 0 THEN length(r1_answer) ELSE 0 END) / sum(length(prompt) + length(r1_answer)), 9) AS ratio, round(3e-4 * sqrt(4096 * 8 * (sum(CASE WHEN length(r1_answer) > 0 THEN length(r1_answer) ELSE 0 END) / sum(length(prompt) + length(r1_answer))) / 4000000), 9) AS rate FROM audit_pool WHERE r1_answer IS NOT NULL AND prompt IS NOT NULL")
def suggested_rate(spark, folder):
    """The share of labelled tokens and the learning rate it suggests."""
    a = table(spark, folder, "audit_pool", "prompt", "r1_answer").where("r1_answer IS NOT NULL AND prompt IS NOT NULL")
    ratio = F.sum(F.length("r1_answer")) / F.sum(F.length("prompt") + F.length("r1_answer"))
    r = a.agg(ratio.alias("r"))
    return r.select(F.round("r", 9).alias("ratio"), F.round(M.learning_rate(F.col("r"), 4096, 8), 9).alias("rate"))
