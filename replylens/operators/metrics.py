"""Classification and escalation metrics from one pass over the predictions.

Rows are first reduced to counts per (system, true, predicted); every metric is then
arithmetic on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranking import running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def label_counts(
    df: DataFrame, true: str, pred: str, by: tuple[str, ...] = (), copies: str | None = None
) -> DataFrame:
    """Counts per (true, predicted); ``copies`` names a column with the number of
    identical rows a row stands for."""
    n = F.sum(copies) if copies else F.count(F.lit(1))
    return df.groupBy(
        *by, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")
    ).agg(n.alias("n"))


def label_union(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Labels that occur as true or predicted, per group."""
    true = counts.select(*by, F.col("true_label").alias("label"))
    pred = counts.select(*by, F.col("pred_label").alias("label"))
    return true.union(pred).distinct()


def confusion_matrix(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(true_label, pred_label, n) with zero cells, over the label union. The cells
    are spelled out from each group's label list, whose length is the class count."""
    key = list(by) or [F.lit(1).alias("__all")]
    labels = label_union(counts, by).groupBy(*key).agg(F.collect_set("label").alias("labels"))
    cells = labels.select(*by, "labels", F.explode("labels").alias("true_label")).select(
        *by, "true_label", F.explode("labels").alias("pred_label")
    )
    return cells.join(counts, [*by, "true_label", "pred_label"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def class_report(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label of the union."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    zero = F.lit(0)
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("true_label").alias("label"), hit.alias("tp"),
                    F.col("n").alias("true_n"), zero.cast("bigint").alias("pred_n"),
                ),
                F.struct(
                    F.col("pred_label").alias("label"), zero.cast("bigint").alias("tp"),
                    zero.cast("bigint").alias("true_n"), F.col("n").alias("pred_n"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    totals = sides.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("true_n").alias("support"), F.sum("pred_n").alias("predicted")
    )
    return totals.select(
        *by, "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def summary(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy, macro-F1 (mean over the label union) and weighted F1."""
    report = class_report(counts, by)
    right = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    accuracy = counts.groupBy(*by).agg(
        F.sum("n").alias("n"), _ratio(right, F.sum("n")).alias("accuracy")
    )
    f1 = report.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    if by:
        return accuracy.join(f1, list(by))
    one = F.lit(1).alias("__one")
    return accuracy.select("*", one).join(f1.select("*", one), "__one").drop("__one")


def escalation_metrics(
    df: DataFrame, true: str, pred: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """Escalation as the positive class, plus the two error rates that matter: gold
    escalates but the system does not, and the reverse."""
    t, p = F.col(true), F.col(pred)
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = F.lit(1)
    return counts.select(
        *by,
        _ratio(tp, tp + fp).alias("escalation_precision"),
        _ratio(tp, tp + fn).alias("escalation_recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("escalation_f1"),
        fn.alias("false_auto_handle_count"),
        (fn / F.greatest(tp + fn, one)).alias("false_auto_handle_rate"),
        fp.alias("false_escalation_count"),
        (fp / F.greatest(fp + tn, one)).alias("false_escalation_rate"),
    )


def cohen_kappa(counts: DataFrame, weights: str | None = None) -> DataFrame:
    """Agreement of two raters from (true_label, pred_label, n) counts; ``weights`` may
    be ``linear`` or ``quadratic`` for numeric scores."""
    total = counts.agg(F.sum("n").cast("double").alias("n")).scalar()
    a = counts.groupBy("true_label").agg(F.sum("n").alias("na"))
    b = counts.groupBy("pred_label").agg(F.sum("n").alias("nb"))
    cells = confusion_matrix(counts).join(a, "true_label", "left").join(b, "pred_label", "left")
    if weights is None:
        cost = F.when(F.col("true_label") == F.col("pred_label"), 0.0).otherwise(1.0)
    else:
        gap = F.abs(F.col("true_label").cast("double") - F.col("pred_label").cast("double"))
        cost = gap * gap if weights == "quadratic" else gap
    chance = F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0)) / total
    sums = cells.agg(
        F.sum("n").alias("n"), F.sum(cost * F.col("n")).alias("seen"),
        F.sum(cost * chance).alias("expected"),
    )
    kappa = F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(
        1.0 - F.col("seen") / F.col("expected")
    )
    return sums.select("n", kappa.alias("kappa"))


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rank correlation with average ranks on ties, on scales of any length. Rows are
    counted per pair of scores; a score's average rank follows from the rows before it.
    Rows without one of the scores take no part."""
    scored = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    counts = stage(
        scored.groupBy(F.col(left).alias("a"), F.col(right).alias("b")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "score_pairs",
    )
    total = counts.agg(F.sum("n").cast("double").alias("n")).scalar()

    def ranks(column: str, name: str) -> DataFrame:
        sizes = counts.groupBy(column).agg(F.sum("n").alias("size"))
        placed = running_totals(sizes, [column], "size")
        # measured from the mean rank, so that sums of squares stay exact enough
        rank = F.col("before") + (F.col("size") + 1) / 2.0 - (total + 1.0) / 2.0
        return placed.select(column, rank.alias(name))

    ranked = counts.join(ranks("a", "ra"), "a").join(ranks("b", "rb"), "b")
    n, ra, rb = F.col("n"), F.col("ra"), F.col("rb")
    sums = ranked.agg(
        F.sum("n").alias("n"), F.sum(n * ra * ra).alias("saa"), F.sum(n * rb * rb).alias("sbb"),
        F.sum(n * ra * rb).alias("sab"),
    )
    spread = F.sqrt("saa") * F.sqrt("sbb")
    return sums.select("n", _ratio(F.col("sab"), spread).alias("spearman"))
