"""Queries of the text and grading functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.functions import udfs as U
from curata.plans.registry import query
from curata.sources import table

# The classes of curata.functions.text in the oracle's spelling.
_S = T.SPACES
_NORM = f"trim(regexp_replace(lower(%s), '{_S}', ' ', 'g'))"
_TOK = f"regexp_extract_all(lower(%s), '{T.TOKEN}')"
_TAIL = "list_extract(string_split(output, '%s'), -1)"


def pool(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "audit_pool", *columns)


@query(f"SELECT pool_idx, {_NORM % 'prompt'} AS norm, substr(sha1({_NORM % 'prompt'}), 1, 16) AS hash16, CAST(len({_TOK % 'prompt'}) AS INTEGER) AS n_tokens FROM audit_pool")
def prompt_hashes(spark, folder):
    """Prompts normalised without NFKC, their hashes and numbers of tokens; ``normal_prompts`` applies it."""
    p = F.col("prompt")
    return pool(spark, folder, "pool_idx", "prompt").select("pool_idx", T.normal_prompt(p).alias("norm"), T.prompt_hash(p).alias("hash16"), F.size(T.tokens(p)).alias("n_tokens"))


@query()
def normal_prompts(spark, folder):
    """Normal prompts with NFKC, their hashes and numbers of tokens: upstream's F2 to F4."""
    d = pool(spark, folder, "pool_idx", "prompt").withColumn("norm", U.normal_prompt("prompt"))
    return d.select("pool_idx", "norm", F.substring(F.sha1("norm"), 1, 16).alias("hash16"), F.size(T.tokens(F.col("norm"))).alias("n_tokens"))


@query(
    f"""SELECT pool_idx, CASE WHEN contains(output, '</think>') THEN length({_TAIL % '</think>'}) ELSE 0 END AS final_chars,
    CAST(len(string_split(output, '<think>')) - 1 AS INTEGER) AS opens, CAST(len(string_split(output, '</think>')) - 1 AS INTEGER) AS closes,
    CAST(len(regexp_extract_all(output, '{T.CJK}')) AS INTEGER) AS cjk FROM audit_pool WHERE output IS NOT NULL"""
)
def final_sections(spark, folder):
    """Final sections and counts of tags and Chinese characters."""
    t = F.col("output")
    return pool(spark, folder, "pool_idx", "output").where(t.isNotNull()).select(
        "pool_idx", F.length(T.final_section(t)).cast("bigint").alias("final_chars"), T.occurrences(t, "<think>").alias("opens"), T.occurrences(t, "</think>").alias("closes"), T.count_matches(t, T.CJK).cast("int").alias("cjk")
    )


_DEPTH = """, c AS (SELECT pool_idx, tail, unnest(string_split(tail, '')) AS ch, unnest(range(1, len(string_split(tail, '')) + 1)) AS i FROM t),
    d AS (SELECT pool_idx, i, sum(CASE WHEN ch = '{' THEN 1 WHEN ch = '}' THEN -1 ELSE 0 END) OVER (PARTITION BY pool_idx ORDER BY i) AS depth FROM c),
    e AS (SELECT pool_idx, min(i) AS stop FROM d WHERE depth = 0 GROUP BY pool_idx)"""


@query(
    "WITH t AS (SELECT pool_idx, '{' || list_extract(string_split(output, '\\boxed{'), -1) AS tail FROM audit_pool WHERE contains(output, '\\boxed{'))"
    + _DEPTH
    + " SELECT a.pool_idx, CASE WHEN output IS NULL THEN NULL ELSE e.stop IS NOT NULL END AS balanced FROM audit_pool a LEFT JOIN e USING (pool_idx)"
)
def boxes_balanced(spark, folder):
    """Whether the last box is closed."""
    return pool(spark, folder, "pool_idx", "output").select("pool_idx", T.last_boxed_balanced(F.col("output")).alias("balanced"))


@query(
    "WITH t AS (SELECT pool_idx, list_extract(string_split(output, 'boxed'), -1) AS tail FROM audit_pool WHERE contains(output, 'boxed'))"
    + _DEPTH
    + r""", f AS (SELECT t.pool_idx, CASE WHEN substr(tail, 1, 1) = '{' THEN CASE WHEN stop IS NOT NULL THEN substr(tail, 2, CAST(stop AS BIGINT) - 2) ELSE substr(tail, 2) END
      ELSE trim(list_extract(string_split(tail, '$'), 1)) END AS raw FROM t LEFT JOIN e USING (pool_idx))
    SELECT a.pool_idx, CASE WHEN a.output IS NULL THEN NULL WHEN f.raw IS NULL THEN '' ELSE
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\n\s*', '', 'g'), '^:', ''), '\.$', ''), '/$', '') END AS answer
    FROM audit_pool a LEFT JOIN f USING (pool_idx)"""
)
def boxed_answers(spark, folder):
    """The content of the last box."""
    return pool(spark, folder, "pool_idx", "output").select("pool_idx", T.boxed_answer(F.col("output")).alias("answer"))


_KIND = r"""CASE WHEN trim(coalesce(r1_answer, '')) = '' THEN 'none'
    WHEN regexp_matches(trim(r1_answer), '^\(?[A-E]\)?\.?$') THEN 'mc'
    WHEN regexp_matches(regexp_replace(trim(r1_answer), '[\s,$%]|\\!', '', 'g'), '^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$') THEN 'numeric'
    WHEN len(regexp_extract_all(regexp_replace(trim(r1_answer), '\\[a-zA-Z]+', ' ', 'g'), '[A-Za-z]{3,}')) >= 3 THEN 'text' ELSE 'expression' END"""


@query(f"SELECT pool_idx, {_KIND} AS kind, coalesce(regexp_matches(substr(prompt, 1, 300), '{T.PROOF}'), FALSE) OR ({_KIND}) = 'text' AS proof FROM audit_pool")
def answer_kinds(spark, folder):
    """Kinds of answers, and prompts that ask for a proof."""
    kind = T.answer_kind(F.col("r1_answer"))
    return pool(spark, folder, "pool_idx", "r1_answer", "prompt").select("pool_idx", kind.alias("kind"), T.proof_like(F.col("prompt"), kind).alias("proof"))


_LINES = "list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 30)"
_REPEAT = f"CAST(coalesce(list_max(list_transform(list_distinct({_LINES}), lambda x: len(list_filter({_LINES}, lambda y: y = x)))), 0) AS INTEGER)"


@query(
    f"""WITH b AS (SELECT pool_idx, {_REPEAT} AS r, len(string_split(output, '<think>')) - 1 AS o, len(string_split(output, '</think>')) - 1 AS c,
      len(regexp_extract_all(prompt, '{T.CJK}')) AS pc, len(regexp_extract_all(output, '{T.CJK}')) AS oc FROM audit_pool),
    f AS (SELECT pool_idx, r AS max_line_repeat, coalesce(r >= 25, FALSE) AS flag_repetition, coalesce(pc = 0 AND oc >= 20, FALSE) AS flag_lang_mix, coalesce(o <> 1 OR c > 1, TRUE) AS flag_malformed FROM b)
    SELECT *, flag_repetition OR flag_lang_mix OR flag_malformed AS flagged FROM f"""
)
def quality_flags(spark, folder):
    """Upstream's quality flags without the compression of the tail; ``audit_flags`` has it."""
    df = pool(spark, folder, "pool_idx", "prompt", "output").withColumn("max_line_repeat", T.max_line_repeat(F.col("output")))
    return df.select("pool_idx", "max_line_repeat", *(c.alias(k) for k, c in T.quality_flags(F.col("prompt"), F.col("output"), F.col("max_line_repeat")).items()))


@query()
def audit_flags(spark, folder):
    """Upstream's quality flags, recomputed: repetition by repeated lines or by the compression of the tail."""
    df = pool(spark, folder, "pool_idx", "prompt", "output").withColumn("r", U.repetition("output"))
    flags = T.quality_flags(F.col("prompt"), F.col("output"), F.col("r.max_line_repeat"), F.col("r.looping"))
    return df.select("pool_idx", "r.tail_zlib_ratio", "r.max_line_repeat", *(c.alias(k) for k, c in flags.items()))


@query()
def tail_ratios(spark, folder):
    """Compressibility of the outputs' ends."""
    return pool(spark, folder, "pool_idx", "output").select("pool_idx", U.tail_ratio("output").alias("tail_zlib_ratio"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)<think>\n?.*?</think>\s*', '', 'g'), '^\n+', '') AS plain FROM documents")
def thoughts_removed(spark, folder):
    """Documents without their think parts."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", T.without_thought(F.col("text")).alias("plain"))


@query(
    r"""SELECT pool_idx, coalesce(list_extract(regexp_extract_all(upper(r1_answer), '\b(A|B|C|D|E)\b', 1), -1), regexp_replace(trim(r1_answer), '\.$', '')) AS letter FROM audit_pool WHERE r1_answer IS NOT NULL"""
)
def choice_letters(spark, folder):
    """The chosen letter of multiple-choice answers."""
    return pool(spark, folder, "pool_idx", "r1_answer").where("r1_answer IS NOT NULL").select("pool_idx", T.choice_letter(F.col("r1_answer")).alias("letter"))


_NUM = r"CASE WHEN trim(replace(%s, ',', '')) LIKE '%%%%' AND right(trim(replace(%s, ',', '')), 1) = '%%' THEN TRY_CAST(regexp_replace(trim(replace(%s, ',', '')), '\\?%%$', '') AS DOUBLE) / 100 ELSE TRY_CAST(trim(replace(%s, ',', '')) AS DOUBLE) END"


@query(
    """WITH n AS (SELECT g.rep_pool_idx, a.r1_answer, unnest(g.answers) AS answer, unnest(range(len(g.answers))) AS k FROM (SELECT DISTINCT * FROM generations) g JOIN audit_pool a ON a.pool_idx = g.rep_pool_idx WHERE len(g.answers) > 0),
    v AS (SELECT *, """
    + _NUM % (("r1_answer",) * 4)
    + " AS x, "
    + _NUM % (("answer",) * 4)
    + """ AS y FROM n) SELECT rep_pool_idx, CAST(k AS INTEGER) AS k, x, y, abs(x - y) <= greatest(1e-9 * greatest(abs(x), abs(y)), 1e-4) AS equal FROM v WHERE x IS NOT NULL AND y IS NOT NULL"""
)
def numeric_grades(spark, folder):
    """Sampled answers against the pool's answer as numbers within a tolerance."""
    g = table(spark, folder, "generations").distinct().select("rep_pool_idx", F.posexplode("answers").alias("k", "answer"))
    d = g.join(pool(spark, folder, "pool_idx", "r1_answer"), F.col("pool_idx") == F.col("rep_pool_idx"))
    d = d.withColumn("x", T.number(F.col("r1_answer"))).withColumn("y", T.number(F.col("answer"))).where("x IS NOT NULL AND y IS NOT NULL")
    return d.select("rep_pool_idx", "k", "x", "y", T.numbers_equal(F.col("x"), F.col("y")).alias("equal"))


@query()
def symbolic_grades(spark, folder):
    """Sampled answers graded by the full cascade; each distinct pair of answers once, then joined back."""
    g = table(spark, folder, "generations").distinct().select("rep_pool_idx", F.posexplode("answers").alias("k", "answer"))
    d = g.join(pool(spark, folder, "pool_idx", "r1_answer"), F.col("pool_idx") == F.col("rep_pool_idx"))
    d = d.select("rep_pool_idx", "k", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("r1_answer", F.lit("")).alias("gold"))
    pairs = d.select("answer", "gold").distinct().withColumn("right", U.answers_equal("answer", "gold"))
    return d.join(pairs, ["answer", "gold"]).select("rep_pool_idx", "k", "answer", "right")


@query()
def answer_similarity(spark, folder):
    """BLEU and ROUGE of each test item's question against its problem."""
    return table(spark, folder, "amc", "id", "problem", "question").select("id", U.similarity("question", "problem").alias("s")).select("id", "s.*")


@query(
    r"""SELECT id, 'Question: ' || trim(coalesce(question, problem)) || chr(10) || 'Answer:' AS prompt, CASE WHEN answer = round(answer) THEN CAST(CAST(answer AS BIGINT) AS VARCHAR) ELSE CAST(answer AS VARCHAR) END AS gold FROM amc"""
)
def item_prompts(spark, folder):
    """Test items as prompts, question or problem first, and their gold answers without a trailing zero."""
    q = F.trim(F.coalesce("question", "problem"))
    gold = F.when(F.col("answer") == F.round("answer"), F.col("answer").cast("bigint").cast("string")).otherwise(F.col("answer").cast("string"))
    return table(spark, folder, "amc").select("id", F.concat(F.lit("Question: "), q, F.lit("\nAnswer:")).alias("prompt"), gold.alias("gold"))
