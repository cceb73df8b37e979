"""Three systems on one golden set, and the nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import metrics as M

SYSTEMS = ("baseline_trivial", "baseline_simple", "system_full")


def three_systems(golden: DataFrame, full: DataFrame, majority: Column) -> DataFrame:
    """(pair_id, system, intent_label, should_escalate, pred_intent, pred_escalate).

    The baselines are expressions over the golden rows, so the three predictions of a
    message are built side by side and unfolded, not scored in three passes.
    """
    keyword = D.keyword_baseline(golden.drop("escalation_reason")).select(
        "pair_id", "intent_label", "should_escalate",
        F.col("intent").alias("kw_intent"), F.col("escalate").alias("kw_escalate"),
    )
    joined = keyword.withColumn("majority", majority).join(
        full.select("pair_id", F.col("intent").alias("full_intent"),
                    F.col("escalate").alias("full_escalate")), "pair_id")

    def system(name: str, intent: Column, escalate: Column) -> Column:
        return F.struct(
            F.lit(name).alias("system"), intent.alias("pred_intent"),
            escalate.alias("pred_escalate"),
        )

    rows = F.array(
        system(SYSTEMS[0], F.col("majority"), F.lit(False)),
        system(SYSTEMS[1], F.col("kw_intent"), F.col("kw_escalate")),
        system(SYSTEMS[2], F.col("full_intent"), F.col("full_escalate")),
    )
    return joined.select("pair_id", "intent_label", "should_escalate", F.inline(rows))


def system_metrics(predictions: DataFrame) -> DataFrame:
    """One row per system: intent accuracy and F1s, escalation metrics."""
    counts = M.label_counts(predictions, "intent_label", "pred_intent", ("system",))
    intents = M.summary(counts, ("system",)).select(
        "system", "n", F.col("accuracy").alias("intent_accuracy"),
        F.col("macro_f1").alias("intent_macro_f1"),
        F.col("weighted_f1").alias("intent_weighted_f1"),
    )
    escalation = M.escalation_metrics(
        predictions, "should_escalate", "pred_escalate", ("system",)
    )
    return intents.join(escalation, "system")


def nested_report(predictions: DataFrame) -> DataFrame:
    """system_metrics plus per-class F1 as a map and the confusion matrix as nested
    arrays, rounded to 4 digits, one row per system. Sizes depend on the classes."""
    by = ("system",)
    counts = M.label_counts(predictions, "intent_label", "pred_intent", by)
    per_class = M.class_report(counts, by).groupBy("system").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("label", F.round("f1", 4).alias("f1"))))
        ).alias("intent_per_class_f1")
    )
    row = F.array_sort(F.collect_list(F.struct("pred_label", "n")))
    lines = M.confusion_matrix(counts, by).groupBy("system", "true_label").agg(
        F.transform(row, lambda c: c["n"]).alias("cells")
    )
    ordered = F.array_sort(F.collect_list(F.struct("true_label", "cells")))
    matrix = lines.groupBy("system").agg(ordered.alias("m")).select(
        "system",
        F.struct(
            F.col("m.true_label").alias("labels"), F.col("m.cells").alias("matrix")
        ).alias("intent_confusion_matrix"),
    )
    flat = system_metrics(predictions)
    rounded = [
        F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in flat.dtypes
    ]
    return flat.select(*rounded).join(per_class, "system").join(matrix, "system")
