"""Leakage-free pools, stratified splits and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import first_per_conversation
from .ranking import SEED, seeded_key, seeded_rank

EVAL, DEV, RETRIEVAL = "eval", "dev", "retrieval"
MAX_EVAL, MAX_DEV = 250, 400
EVAL_SHARE, DEV_SHARE = 0.08, 0.1


def choose_conversations(
    pairs: DataFrame,
    seed: int = SEED,
    max_eval: int = MAX_EVAL,
    max_dev: int = MAX_DEV,
) -> DataFrame:
    """(conversation_id, pool) of the eval and dev conversations.

    A distributed top-n in seeded order; the result has at most max_eval + max_dev
    rows, whatever the size of ``pairs``.
    """
    ids = pairs.select("conversation_id").distinct()
    total = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_eval = F.least(F.lit(max_eval), F.floor(total * F.lit(EVAL_SHARE)))
    n_dev = F.least(F.lit(max_dev), F.floor(total * F.lit(DEV_SHARE)))
    first = (
        ids.withColumn("key", seeded_key(F.col("conversation_id"), seed))
        .orderBy("key", "conversation_id")
        .limit(max_eval + max_dev)
    )
    # at most max_eval + max_dev rows reach this window
    place = F.row_number().over(Window.orderBy("key", "conversation_id"))
    pool = F.when(F.col("place") <= n_eval, F.lit(EVAL)).when(
        F.col("place") <= n_eval + n_dev, F.lit(DEV)
    )
    return (
        first.withColumn("place", place)
        .withColumn("pool", pool)
        .where(F.col("pool").isNotNull())
        .select("conversation_id", "pool")
    )


def assign_pools(pairs: DataFrame, **options: int) -> DataFrame:
    """Add ``pool``. Splitting by conversation keeps all pairs of a conversation in
    one pool. The chosen ids are few by construction, hence the broadcast."""
    chosen = F.broadcast(choose_conversations(pairs, **options))
    return pairs.join(chosen, "conversation_id", "left").withColumn(
        "pool", F.coalesce("pool", F.lit(RETRIEVAL))
    ).select(*pairs.columns, "pool")


def in_conversations(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return pairs.join(ids.select("conversation_id"), "conversation_id", "left_semi").select(
        *pairs.columns
    )


def not_in_conversations(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return pairs.join(ids.select("conversation_id"), "conversation_id", "left_anti").select(
        *pairs.columns
    )


def eval_pool(pooled: DataFrame) -> DataFrame:
    """The eval pool keeps one pair per conversation."""
    return first_per_conversation(pooled.where(F.col("pool") == EVAL).drop("pool"))


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``split`` (train / test) with the same test share in every label. Ranks
    come from one range sort, so a dominant label is not one task's work."""
    ranked = seeded_rank(df, id_col, by=[label], seed=seed, rank="__r", total="__n")
    in_test = F.col("__r") <= F.round(F.col("__n") * F.lit(test_share))
    return ranked.withColumn(
        "split", F.when(in_test, F.lit("test")).otherwise(F.lit("train"))
    ).drop("__r", "__n")


def with_prefix_share(
    df: DataFrame, id_col: str, shares: Sequence[float], seed: int = SEED
) -> DataFrame:
    """Add ``prefix_share``: the smallest listed share whose prefix of the seeded
    order holds the row. Prefixes are nested: share s is ``prefix_share <= s``."""
    ranked = seeded_rank(df, id_col, seed=seed, rank="__r", total="__n")
    level: Column = F.lit(None).cast("double")
    for share in sorted(shares, reverse=True):
        inside = F.col("__r") <= F.floor(F.col("__n") * F.lit(float(share)))
        level = F.when(inside, F.lit(float(share))).otherwise(level)
    return ranked.withColumn("prefix_share", level).drop("__r", "__n")


def shared_conversations(pooled: DataFrame) -> DataFrame:
    """Leakage check: per pool pair, conversations that occur in both (should be 0)."""
    spread = (
        pooled.select("conversation_id", "pool").distinct()
        .groupBy("conversation_id").agg(F.array_sort(F.collect_set("pool")).alias("pools"))
    )
    checks = [(EVAL, DEV), (EVAL, RETRIEVAL), (DEV, RETRIEVAL)]
    both = [
        F.count_if(F.array_contains("pools", a) & F.array_contains("pools", b)) for a, b in checks
    ]
    counts = spread.agg(
        F.array(*[
            F.struct(F.lit(a).alias("pool_a"), F.lit(b).alias("pool_b"), n.alias("shared"))
            for (a, b), n in zip(checks, both)
        ]).alias("rows")
    )
    return counts.select(F.inline("rows"))


def shared_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Ids that occur in both tables."""
    return left.select(column).intersect(right.select(column))


def leaked_texts(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Rows of ``left`` whose text key also occurs in ``right``."""
    keys = right.select(key.alias("text_key")).distinct()
    return left.withColumn("text_key", key).join(keys, "text_key", "left_semi")
