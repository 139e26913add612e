"""The queries of the training-data problems; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import budget, copies, language, leak, mixture, oracle, packing, pairs, repeats, toxic
from curata.llm.common import source_key
from curata.plans.lineage import cut
from curata.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def _pool_and_items(spark: SparkSession, folder: str) -> tuple:
    return table(spark, folder, "audit_pool", "pool_idx", "output"), table(spark, folder, "amc", "id", "problem"), "pool_idx", "output", "id", "problem"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(pool_idx, item_id): outputs that hold half of a test item; its words are runs of a-z and 0-9."""
    return leak.matches(*_pool_and_items(spark, folder), ascii_only=True).select("pool_idx", "item_id")


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every maximal verbatim match of an output and a test item, words of any script, whatever part of the item it is."""
    return leak.passages(*_pool_and_items(spark, folder))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and sources of the corpus without the outputs that hold a test item."""
    return leak.without_leaks(table(spark, folder, "audit_pool", "pool_idx", "source"), leak.matches(*_pool_and_items(spark, folder)), "pool_idx")


#: What TESTDATA compares of a record; ``index`` isn't.
_COMPARED = ("instruction", "input", "system", "extra_info.category", "extra_info.source")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(keep_pool_idx, copy_pool_idx): records that repeat another."""
    return copies.copies(table(spark, folder, "pool_raw", "pool_idx", "record"), "pool_idx", "record", _COMPARED).select(F.col("keep").alias("keep_pool_idx"), F.col("copy").alias("copy_pool_idx"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(keep_pool_idx, n_copies): one row for each distinct record."""
    _, kept = copies.groups(table(spark, folder, "pool_raw", "pool_idx", "record"), "pool_idx", "record", ignored=("extra_info.index",))
    return kept.select(F.col("keep").alias("keep_pool_idx"), F.col("n").alias("n_copies"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "audit_pool", "pool_idx", "output", "lang")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(pool_idx, lang): the languages of outputs whose label is absent, wrong or not the only one."""
    df = _labelled(spark, folder)
    model = language.train(df, "pool_idx", "output", "lang")
    return language.present(df, model, "pool_idx", "output", "lang", True).select("pool_idx", "lang")


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Each output's languages with confidence and share of its words."""
    df = _labelled(spark, folder)
    return language.present(df, language.train(df, "pool_idx", "output", "lang"), "pool_idx", "output", "lang", False)


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each output's segments of one language, with confidence."""
    df = _labelled(spark, folder)
    return language.segments(df, language.train(df, "pool_idx", "output", "lang"), "pool_idx", "output", "lang")


def _repeats(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "audit_pool", "pool_idx", "output", "source")
    return repeats.verdicts(df.withColumn("source", source_key(F.col("source"))), "pool_idx", "output", "source")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(pool_idx): outputs of which at least a third repeats."""
    return _repeats(spark, folder).where("fails").select("pool_idx")


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Each output's share of repeated content beside its source's shrunk rate and verdict."""
    return _repeats(spark, folder)


def p4_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with their raw and shrunk rates of repetitive outputs."""
    df = table(spark, folder, "audit_pool", "pool_idx", "output", "source")
    rates = repeats.host_rates(cut(repeats.text_rule(df.withColumn("source", source_key(F.col("source"))), "pool_idx", "output", "source")))
    return rates.select("host", "n", "n_failed", *(F.round(c, 9).alias(c) for c in ("rate", "shrunk_rate")), "bad_host", F.round("threshold", 9).alias("threshold"))


def p5_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each row's prompt and output, with the keys of the budget."""
    df = table(spark, folder, "audit_pool", "pool_idx", "source", "lang", "domain", "prompt", "output")
    return budget.counted(df, "pool_idx", ("prompt", "output"))


def p5_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of prompts and outputs by source, language and domain."""
    return budget.totals(p5_tokens(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(pool_idx, defect): defective pairs with the kind of defect."""
    df = table(spark, folder, "audit_pool", "pool_idx", "prompt", "output", "lang", "truncated")
    return pairs.defective(df, pairs.train(df, "pool_idx", "output", "lang", "truncated"), "pool_idx", "prompt", "output")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's containers in each plan."""
    return packing.packed(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "pack_plans"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and filled share of each plan."""
    return packing.fill(p7_packed(spark, folder))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixture.mixed(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual token share of each source."""
    return mixture.shares(p8_mix(spark, folder), table(spark, folder, "mix_targets"))


def _toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    labels = table(spark, folder, "doc_labels")
    seen, verdict = toxic.read(docs), toxic.verdicts(labels)
    tallies = toxic.tallied(seen, verdict)
    return toxic.scores(docs, toxic.train(docs, labels, tallies), seen, toxic.said(tallies, toxic.shares(verdict)), tallies)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, category): documents with abuse, hate or sexual content."""
    return toxic.found(_toxic(spark, folder))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's score for each kind."""
    return _toxic(spark, folder)


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by source."""
    return toxic.rates(_toxic(spark, folder))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_matches, p1_clean, p2_found, p2_groups, p3_found, p3_languages, p3_segments, p4_found, p4_shares, p4_hosts, p5_tokens, p5_budget, p6_found, p7_packed, p7_fill, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}
#: Queries that SQL can state. The others are held against brute force, exact round trips and held-out rows in the tests.
ORACLE: dict[str, str] = oracle.ORACLE
