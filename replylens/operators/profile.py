"""Brand profiles and label diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..schemas import require_columns
from .ranking import SEED, sample_per_group

SAMPLE_PER_COMPANY = 2000


def per_conversation(raw: DataFrame) -> DataFrame:
    """(company, conversation_id, replied, turns); parts of one conversation add up."""
    require_columns(raw, "company", "conversation_id", "conversation")
    facts = raw.select(
        "company", "conversation_id",
        X.has_support_reply(F.col("conversation")).alias("replied"),
        X.turn_count(F.col("conversation")).cast("bigint").alias("turns"),
    )
    if "part" not in raw.columns:
        return facts
    return facts.groupBy("company", "conversation_id").agg(
        F.bool_or("replied").alias("replied"), F.sum("turns").alias("turns")
    )


def volume(raw: DataFrame, companies: Sequence[str] | None = None) -> DataFrame:
    """Conversations, share with a reply (%) and mean turns per company; listed
    companies without rows do not appear. One aggregation for all companies."""
    if companies is not None:
        raw = raw.where(F.col("company").isin(*companies))
    return per_conversation(raw).groupBy(F.col("company").alias("brand")).agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.round(F.avg(F.col("replied").cast("int")) * 100, 1).alias("pct_with_support_reply"),
        F.round(F.avg("turns"), 2).alias("avg_turns"),
    )


def vocabulary_diversity(
    raw: DataFrame, companies: Sequence[str] | None = None,
    n: int = SAMPLE_PER_COMPANY, seed: int = SEED,
) -> DataFrame:
    """Distinct words / words over a seeded sample of conversations per company.

    Ids alone are ranked; texts join afterwards. Words are counted per (company, word)
    before the distinct count, so frequent words cost one row per task.
    """
    if companies is not None:
        raw = raw.where(F.col("company").isin(*companies))
    ids = raw.select("company", "conversation_id").distinct()
    chosen = sample_per_group(ids, "company", "conversation_id", n, seed)
    words = (
        raw.join(chosen, ["company", "conversation_id"], "left_semi")
        .select("company", F.explode_outer(X.split_words(F.lower("conversation"))).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("company", "word").agg(F.count(F.lit(1)).alias("uses"))
    )
    return words.groupBy(F.col("company").alias("brand")).agg(
        F.round(F.count(F.lit(1)) / F.greatest(F.sum("uses"), F.lit(1)), 4).alias("vocab_diversity")
    )


def word_sketches(raw: DataFrame, companies: Sequence[str] | None = None, lg_k: int = 14) -> DataFrame:
    """(brand, words, sketch) over all conversations: the number of words and a sketch of
    the distinct ones. Sketches of parts of a table, such as days, merge with
    ``merge_sketches``; texts are read once and nothing but sketches is shuffled."""
    if companies is not None:
        raw = raw.where(F.col("company").isin(*companies))
    words = raw.select(
        "company", F.explode_outer(X.split_words(F.lower("conversation"))).alias("word")
    ).where(F.col("word").isNotNull())
    return words.groupBy(F.col("company").alias("brand")).agg(
        F.count(F.lit(1)).alias("words"), F.hll_sketch_agg("word", lg_k).alias("sketch")
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several parts as one per brand."""
    return sketches.groupBy("brand").agg(
        F.sum("words").alias("words"), F.hll_union_agg("sketch").alias("sketch")
    )


def sketched_diversity(sketches: DataFrame) -> DataFrame:
    """(brand, words, distinct_words, vocab_diversity) as estimated. With the default size
    the standard error of the distinct words is below 1 %."""
    distinct = F.hll_sketch_estimate("sketch")
    return sketches.select(
        "brand", "words", distinct.alias("distinct_words"),
        F.round(distinct / F.greatest("words", F.lit(1)), 4).alias("vocab_diversity"),
    )


def brand_profile(
    raw: DataFrame, companies: Sequence[str] | None = None, n: int = SAMPLE_PER_COMPANY
) -> DataFrame:
    """The brand table, largest first."""
    diversity = vocabulary_diversity(raw, companies, n)
    return (
        volume(raw, companies).join(diversity, "brand", "left")
        .withColumn("vocab_diversity", F.coalesce("vocab_diversity", F.lit(0.0)))
        .orderBy(F.desc("n_conversations"), "brand")
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def multi_rule_share(messages: DataFrame) -> DataFrame:
    """How many messages match more than one intent rule."""
    many = F.size(R.all_matches(F.col("customer_msg"), R.INTENT_RULES)) > 1
    return messages.select(many.alias("many")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("many").alias("multi_match"),
        F.avg(F.col("many").cast("int")).alias("share"),
    )


def multi_rule_examples(messages: DataFrame, id_col: str = "pair_id", n: int = 8) -> DataFrame:
    hits = R.all_matches(F.col("customer_msg"), R.INTENT_RULES)
    return (
        messages.withColumn("hits", hits).where(F.size("hits") > 1)
        .select(id_col, X.preview(F.col("customer_msg")).alias("preview"), "hits")
        .orderBy(id_col).limit(n)
    )


def word_count_profile(messages: DataFrame, short: int = 5) -> DataFrame:
    """Distribution of word counts. Exact quantiles come from the counts per length,
    a table as small as the number of different lengths."""
    lengths = messages.groupBy(X.word_count(F.col("customer_msg")).alias("words")).agg(
        F.count(F.lit(1)).alias("n")
    )
    quantiles = F.percentile("words", [0.25, 0.5, 0.75], F.col("n"))
    return lengths.agg(
        F.sum("n").alias("n"), F.min("words").alias("min_words"),
        quantiles.alias("q"), F.max("words").alias("max_words"),
        F.sum(F.when(F.col("words") <= short, F.col("n")).otherwise(0)).alias("short"),
    ).select(
        "n", "min_words", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("p75"), "max_words", "short",
        (F.col("short") / F.greatest(F.col("n"), F.lit(1))).alias("short_share"),
    )


def duplicate_messages(messages: DataFrame) -> DataFrame:
    """Rows beyond the first of every normalised message."""
    keys = messages.groupBy(X.duplicate_key(F.col("customer_msg")).alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )
