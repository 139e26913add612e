"""Queries of conversations, templates, token sequences, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators import dialogue as D
from curata.operators import sequences as S
from curata.operators import tools
from curata.plans.registry import query
from curata.sources import readers, table
from curata.streaming import streams

_PARTS = "SELECT pool_idx, record::JSON->>'$.instruction' AS i, coalesce(record::JSON->>'$.input', '') AS q, coalesce(record::JSON->>'$.system', '') AS s, output AS o FROM pool_raw JOIN audit_pool USING (pool_idx)"


def records(spark, folder) -> DataFrame:
    schema = "instruction string, input string, system string"
    r = table(spark, folder, "pool_raw", "pool_idx", "record").select("pool_idx", F.from_json("record", schema).alias("r"))
    r = r.join(table(spark, folder, "audit_pool", "pool_idx", "output"), "pool_idx")
    return r.select("pool_idx", F.col("r.instruction").alias("i"), F.coalesce("r.input", F.lit("")).alias("q"), F.coalesce("r.system", F.lit("")).alias("s"), F.col("output").alias("o"))


def aligned(spark, folder) -> DataFrame:
    return records(spark, folder).select("pool_idx", *(c.alias(k) for k, c in D.align_instruction(F.col("i"), F.col("q"), F.col("o"), F.col("s")).items()))


_QUERY = "CASE WHEN i <> '' AND q <> '' THEN i || chr(10) || q WHEN i <> '' THEN i ELSE q END"


@query(f"SELECT pool_idx, {_QUERY} AS prompt, CAST(1 AS INTEGER) AS n_prompt, CAST(CASE WHEN o IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_response, o AS response, s AS system, o IS NOT NULL AS valid FROM ({_PARTS})")
def instruction_alignment(spark, folder):
    """Instruction records as prompt and response turns."""
    a = aligned(spark, folder)
    return a.select("pool_idx", F.col("_prompt")[0]["content"].alias("prompt"), F.size("_prompt").alias("n_prompt"), F.size("_response").alias("n_response"), F.try_element_at("_response", F.lit(1))["content"].alias("response"), F.col("_system").alias("system"), D.valid(F.col("_prompt"), F.col("_response")).alias("valid"))


@query(
    f"""SELECT pool_idx, pool_idx % 5 = 0 AS broken, CAST(CASE WHEN pool_idx % 5 = 0 THEN 0 WHEN pool_idx % 2 = 0 THEN 3 ELSE 1 END AS INTEGER) AS n_prompt, CASE WHEN pool_idx % 5 = 0 THEN NULL ELSE coalesce(o, '') END AS response, CASE WHEN s <> '' THEN s ELSE '' END AS system FROM ({_PARTS})"""
)
def chat_alignment(spark, folder):
    """Chat records built of the pool: lifted system turns, alternation, broken ones (every fifth ends on the user) emptied."""
    r = records(spark, folder)
    t = lambda role, c: F.struct(F.lit(role).alias("from"), c.alias("value"))
    lead = F.when(F.col("s") != "", F.array(t("system", F.col("s")))).otherwise(F.array().cast("array<struct<from:string,value:string>>"))
    more = F.when(F.col("pool_idx") % 2 == 0, F.array(t("human", F.col("i")), t("gpt", F.lit("Yes?")))).otherwise(F.array().cast("array<struct<from:string,value:string>>"))
    end = F.when(F.col("pool_idx") % 5 == 0, F.array(t("human", F.col("q")))).otherwise(F.array(t("human", F.col("q")), t("gpt", F.coalesce("o", F.lit("")))))
    m = r.select("pool_idx", F.concat(lead, more, end).alias("m"))
    a = m.select("pool_idx", *(c.alias(k) for k, c in D.align_chat(F.col("m"), "from", "value").items()))
    return a.select("pool_idx", "broken", F.size("_prompt").alias("n_prompt"), F.try_element_at("_response", F.lit(1))["content"].alias("response"), F.col("_system").alias("system"))


@query(
    f"""SELECT pool_idx, CASE WHEN s <> '' THEN '<|im_start|>system' || chr(10) || s || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || {_QUERY} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS source,
    o || '<|im_end|>' || chr(10) AS target FROM ({_PARTS}) WHERE o IS NOT NULL"""
)
def chat_templates(spark, folder):
    """Records written in a chat format, as source and target texts."""
    a = aligned(spark, folder).where(F.size("_response") > 0)
    pairs = D.encoded_pairs(F.concat("_prompt", "_response"), F.col("_system"), D.TEMPLATES["chatml"])
    return a.select("pool_idx", F.explode(pairs).alias("p")).select("pool_idx", "p.source", "p.target")


@query("SELECT a.pool_idx, CASE WHEN s.pass_rate >= 0.5 THEN [a.r1_answer, ''] ELSE ['', a.r1_answer] END AS pair FROM audit_pool a JOIN (SELECT DISTINCT * FROM pool_scores) s USING (pool_idx) WHERE s.pass_rate IS NOT NULL AND a.r1_answer IS NOT NULL")
def preference_pairs(spark, folder):
    """Rated answers as chosen and rejected sides."""
    s = table(spark, folder, "pool_scores").distinct().where("pass_rate IS NOT NULL").select("pool_idx", "pass_rate")
    a = table(spark, folder, "audit_pool", "pool_idx", "r1_answer").where("r1_answer IS NOT NULL")
    return a.join(s, "pool_idx").select("pool_idx", D.preference(F.col("r1_answer"), F.col("pass_rate") >= 0.5).alias("pair"))


@query("SELECT pool_idx, batch, coalesce(lag(r1_answer) OVER w, last_value(r1_answer) OVER (PARTITION BY batch ORDER BY pool_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS mismatched FROM (SELECT pool_idx, r1_answer, pool_idx // 1000 AS batch FROM audit_pool WHERE r1_answer IS NOT NULL) WINDOW w AS (PARTITION BY batch ORDER BY pool_idx)")
def mismatched_pairs(spark, folder):
    """Answers paired with the answer before them in their batch of 1000 keys, the first with the last."""
    a = table(spark, folder, "audit_pool", "pool_idx", "r1_answer").where("r1_answer IS NOT NULL").withColumn("batch", F.floor(F.col("pool_idx") / 1000))
    return S.shifted_pairs(a, "batch", "pool_idx", "r1_answer").select("pool_idx", "batch", "mismatched")


_BUDGET = """CASE WHEN t * 2 < {c} THEN {c} WHEN s * 2 < {c} THEN {c} - s ELSE CAST(floor({c} * (t / (s + t))) AS BIGINT) END"""


@query(
    f"""SELECT pool_idx, CAST(least(greatest(800 - keep, 0), s) AS INTEGER) AS source_kept, CAST(keep AS INTEGER) AS target_kept FROM (SELECT *, least({_BUDGET.format(c=800)}, t) AS keep FROM (SELECT pool_idx, length(prompt) AS s, length(output) AS t FROM audit_pool WHERE length(output) > 0))"""
)
def length_budgets(spark, folder):
    """Characters kept of prompt and output within a cutoff of 800."""
    a = table(spark, folder, "audit_pool", "pool_idx", "prompt", "output").where(F.length("output") > 0)
    s, t = S.length_budget(F.length("prompt"), F.length("output"), 800)
    return a.select("pool_idx", s.alias("source_kept"), t.alias("target_kept"))


def _pairs(spark, folder) -> DataFrame:
    a = table(spark, folder, "audit_pool", "pool_idx", "prompt", "r1_answer").where("r1_answer IS NOT NULL AND r1_answer <> '' AND prompt IS NOT NULL")
    one = F.struct(S.words_as_ids(F.col("prompt")).alias("source"), S.words_as_ids(F.col("r1_answer")).alias("target"))
    return a.select("pool_idx", F.array(one, one).alias("turns"))


@query(
    """WITH p AS (SELECT pool_idx, length(prompt) AS s, length(r1_answer) AS t FROM audit_pool WHERE r1_answer IS NOT NULL AND r1_answer <> '' AND prompt IS NOT NULL),
    a AS (SELECT *, CASE WHEN t * 2 < 200 THEN 200 WHEN s * 2 < 200 THEN 200 - s ELSE floor(200 * (t / (s + t))) END AS m FROM p),
    b AS (SELECT *, least(m, t) AS k1, least(greatest(200 - least(m, t), 0), s) AS s1 FROM a), c AS (SELECT *, 200 - s1 - k1 AS left_ FROM b),
    d AS (SELECT *, CASE WHEN left_ <= 0 THEN 0 ELSE least(CASE WHEN t * 2 < left_ THEN left_ WHEN s * 2 < left_ THEN left_ - s ELSE floor(left_ * (t / (s + t))) END, t) END AS k2 FROM c)
    SELECT pool_idx, CAST(s1 + k1 + CASE WHEN left_ <= 0 THEN 0 ELSE k2 + least(greatest(left_ - k2, 0), s) END AS INTEGER) AS n_ids, CAST(k1 + k2 AS INTEGER) AS n_labels FROM d"""
)
def encoded_turns(spark, folder):
    """Two turns under a running budget of 200: ids, and labels on the answers only."""
    e = _pairs(spark, folder).select("pool_idx", S.encode_turns(F.col("turns"), 200).alias("e"))
    return e.select("pool_idx", F.size("e.input_ids").alias("n_ids"), F.size(F.filter("e.labels", lambda x: x != S.IGNORE)).alias("n_labels"))


@query()
def packed_batches(spark, folder):
    """Answers packed greedily by batches of 1000 keys into sequences of 64."""
    a = table(spark, folder, "audit_pool", "pool_idx", "r1_answer").where("r1_answer IS NOT NULL AND r1_answer <> ''").select("pool_idx", S.words_as_ids(F.col("r1_answer")).alias("ids"))
    return S.pack_batches(a, "pool_idx", "ids", 64).select("batch_id", "pack_id", "n_sequences", "tokens", "keys")


@query()
def packed_pairs(spark, folder):
    """Prompts and outputs of the whole pool within a budget of 4096, packed by batches of 1000 keys into sequences of 4096."""
    a = table(spark, folder, "audit_pool", "pool_idx", "prompt", "output").where("prompt IS NOT NULL AND output IS NOT NULL")
    return S.pack_turns(a, "pool_idx", "prompt", "output", 4096)


@query(
    """WITH s AS (SELECT id, id // 1000 AS b, problem || chr(1) AS t FROM amc WHERE problem IS NOT NULL), j AS (SELECT b, string_agg(t, '' ORDER BY id) AS t FROM s GROUP BY b),
    k AS (SELECT b, t, unnest(range(length(t) // 512)) AS block_id FROM j) SELECT b AS batch_id, CAST(block_id AS BIGINT) AS block_id, list_transform(string_split(substr(t, CAST(block_id * 512 + 1 AS BIGINT), 512), ''), lambda c: unicode(c)) AS ids FROM k"""
)
def pretraining_blocks(spark, folder):
    """Problems joined with an end sign and cut into blocks of 512; the rest of a batch is dropped."""
    a = table(spark, folder, "amc", "id", "problem").where("problem IS NOT NULL").select("id", S.words_as_ids(F.col("problem")).alias("ids"))
    return S.blocks(a, "id", "ids", 512, 1)


@query()
def document_blocks(spark, folder):
    """All documents joined with an end sign by batches of 1000 keys and cut into blocks of 2048; the rest of a batch is dropped."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    return S.text_blocks(d, "doc_id", "text", 2048, 1)


@query(
    "SELECT id, CAST(id // 16 AS BIGINT) AS batch, CAST(length(problem) AS INTEGER) AS n, CAST(ceil(max(length(problem)) OVER (PARTITION BY id // 16) / 8) * 8 AS INTEGER) AS width FROM amc WHERE problem IS NOT NULL"
)
def padded_batches(spark, folder):
    """Batches of 16 padded to a multiple of 8; the mask tells the length back."""
    a = table(spark, folder, "amc", "id", "problem").where("problem IS NOT NULL").select("id", F.floor(F.col("id") / 16).alias("batch"), S.words_as_ids(F.col("problem")).alias("ids"))
    c = S.collated(a.withColumn("labels", F.col("ids")), "batch", "ids", "labels")
    return c.select("id", "batch", F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("n"), F.size("ids").alias("width"))


@query("SELECT o_orderkey, list(n ORDER BY k, n) AS lengths, CAST(sum(n) AS INTEGER) AS total FROM (SELECT l_orderkey AS o_orderkey, l_linenumber AS k, CAST(l_quantity AS INTEGER) % 5 + 1 AS n FROM lineitem) GROUP BY o_orderkey")
def unpadded_lengths(spark, folder):
    """Segment lengths read back from index masks; the masks are made of line quantities."""
    li = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    parts = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("int") % 5 + 1).alias("n")))).alias("p"))
    mask = F.flatten(F.transform("p", lambda x, i: F.array_repeat(i + 1, x["n"])))
    d = parts.select("o_orderkey", F.concat(mask, F.array(F.lit(0), F.lit(0))).alias("mask")).select("o_orderkey", S.segment_lengths(F.col("mask")).alias("lengths"))
    return d.select("o_orderkey", "lengths", F.element_at(S.cumulative(F.col("lengths")), -1).alias("total"))


@query("SELECT 'Question: ' || problem || chr(10) || 'A. ' || CAST(answer AS VARCHAR) || chr(10) || 'B. ' || CAST(answer + 1 AS VARCHAR) || chr(10) || 'Answer:' AS prompt, id FROM amc")
def choice_prompts(spark, folder):
    """Items as multiple-choice questions."""
    q = F.concat(F.lit("Question: "), F.col("problem"))
    return table(spark, folder, "amc").select(D.choice_question(q, [F.col("answer").cast("string"), (F.col("answer") + 1).cast("string")], None).alias("prompt"), "id")


@query("SELECT id, CAST(1 + count(*) FILTER (WHERE h < h0) AS INTEGER) AS gold_place FROM (SELECT id, md5('42|' || id || '|' || i) AS h, md5('42|' || id || '|0') AS h0 FROM amc, range(4) r(i)) GROUP BY id")
def shuffled_choices(spark, folder):
    """Where the gold option lands among four in an order by hash."""
    opts = F.array(*(F.lit(x) for x in "wxyz"))
    s = table(spark, folder, "amc", "id").select("id", F.posexplode(D.shuffled_options(opts, F.col("id"), 42)).alias("k", "o"))
    return s.where("o.gold").select("id", (F.col("k") + 1).alias("gold_place"))


@query()
def tool_calls(spark, folder):
    """Tool calls found in texts; every third test item's text is wrapped as a call, the others are ordinary content."""
    a = table(spark, folder, "amc", "id", "url")
    call = F.concat(F.lit('<tool_call>\n{"name": "open", "arguments": {"url": "'), "url", F.lit('"}}\n</tool_call>'))
    return a.select("id", tools.extract_calls("qwen")(F.when(F.col("id") % 3 == 0, call).otherwise(F.col("url"))).alias("calls"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+: ')) AS INTEGER) AS turns FROM documents WHERE text IS NOT NULL")
def dialogue_turns(spark, folder):
    """Named turns of documents: a generator of rows, counted."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    t = readers.transcript_turns(d, "doc_id", "text")
    return d.select("doc_id").join(t.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("turns"))


@query("WITH w AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events) SELECT event_type, day, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events) WHERE day + INTERVAL 1 DAY <= (SELECT mark FROM w) GROUP BY event_type, day")
def streamed_windows(spark, folder):
    """Daily counts and sums of a stream of events: the windows that a watermark of two days has closed at the end of the input."""
    out = streams.windowed(streams.source(spark, f"{folder}/events.parquet"), "ts", "event_type", "value", "1 day", "2 days")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events), f AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM f) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT mark FROM w)")
def streamed_sessions(spark, folder):
    """Sessions of a stream with gaps of an hour: those that a watermark of two days has closed at the end of the input."""
    out = streams.sessions(streams.source(spark, f"{folder}/events.parquet"), "ts", "user_id", "1 hour", "2 days")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def streamed_progress(spark, folder):
    """Progress of an append-only log: resumable, each file once."""
    return streams.latest(spark, f"{folder}/events.parquet", "event_type", "event_id")


@query("SELECT event_type, steps, total, round(100 * steps / total, 2) AS percentage, elapsed, round(elapsed / steps * (total - steps), 3) AS remaining, round(tokens / elapsed, 6) AS throughput FROM (SELECT event_type, max(event_id) AS steps, max(event_id) + 1000 AS total, epoch(max(ts)) - epoch(min(ts)) AS elapsed, sum(value) AS tokens FROM events GROUP BY event_type) WHERE steps > 0 AND elapsed > 0")
def training_progress(spark, folder):
    """Steps, percentage, elapsed and remaining time and throughput of append-only training logs, read as a stream."""
    s = streams.source(spark, f"{folder}/events.parquet").withColumn("of", F.col("event_id") + 1000)
    p = streams.progress(s, "event_type", "event_id", "of", "ts", "value").where("steps > 0 AND elapsed > 0")
    return p.select("event_type", "steps", "total", "percentage", "elapsed", F.round("remaining", 3).alias("remaining"), F.round("throughput", 6).alias("throughput"))


@query("SELECT user_id, session_start, n FROM (SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s)")
def sessions(spark, folder):
    """Sessions of users with gaps of an hour."""
    e = table(spark, folder, "events", "user_id", "ts")
    s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")
