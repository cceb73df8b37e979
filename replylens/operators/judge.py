"""Heuristic checks of drafted replies against their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

GROUNDED_OVERLAP = 0.25


def judge_replies(scored: DataFrame) -> DataFrame:
    """Add overlap_score, grounded_score, length_ok and unsupported_claims to rows
    with draft_reply and evidence. A missing or empty reply scores zero."""
    reply, empty = F.col("draft_reply"), F.array().cast("array<string>")
    evidence = F.array_join(F.transform("evidence", lambda e: e["support_reply"]), " ")
    present = F.coalesce(F.length(reply) > 0, F.lit(False))
    return (
        scored.withColumn("evidence_text", F.lower(evidence))
        .withColumn(
            "overlap_score",
            F.when(present, X.overlap_score(reply, F.col("evidence_text"))).otherwise(0.0),
        )
        .withColumn(
            "grounded_score",
            F.when(F.col("overlap_score") > GROUNDED_OVERLAP, 1).otherwise(0),
        )
        .withColumn("length_ok", present & X.reply_length_ok(reply))
        .withColumn(
            "unsupported_claims",
            F.when(present, X.unsupported_claims(reply, F.col("evidence_text"))).otherwise(empty),
        )
        .drop("evidence_text")
    )


def judge_summary(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.lit("heuristic").alias("judge_method"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("grounded_score"), F.lit(0)).alias("grounded_count"),
        F.count_if("length_ok").alias("length_ok_count"),
        F.count_if(F.size("unsupported_claims") > 0).alias("replies_with_unsupported_claims"),
    )
