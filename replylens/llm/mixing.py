"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of all words by weight, at most ``MAX_COPIES`` times its own
size; what a full source cannot take is shared out again. Inside a source the same
rule spreads its target over length classes, so the expected number of copies of a
document depends on its class. Whole copies are certain. The fractional rest is an
inclusion probability: documents are ranked by their random odds divided by their
inclusion odds, and the first ones that fill the rest of the target are taken.

Every decision is a function of (source, size, doc_id) and of small tables with one
row per source and class, so rows are never gathered by source: the cut is found from
a histogram over ranks, and only the one histogram bin that holds it is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

MAX_COPIES = 3
WEIGHTS = (5, 2, 1)
BINS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def length_class(size: Column) -> Column:
    """Bit length of the size: 0 for empty documents, 10 for 512 to 1,023 words."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double"))) + 1).otherwise(0).cast("int")


def class_preference(size_class: Column) -> Column:
    """How much a length class is wanted: middling lengths more than the extremes."""
    return F.lit(1.0) / (1.0 + F.abs(size_class - 10) / 8.0)


def _share(rows: DataFrame, by: list[str], total: Column, cap: str, want: str) -> DataFrame:
    """Adds ``share``: ``total`` split over the rows of each group by ``want``, none
    above ``cap``, the excess shared again by ``want`` until none is above.

    With rows in the order of cap / want, the level is fixed by the first row whose cap
    is not reached when all rows before it are full.
    """
    group = Window.partitionBy(*by)
    before = group.orderBy("_ratio", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    upto_end = group.orderBy("_ratio", "_tie").rowsBetween(0, Window.unboundedFollowing)
    rows = (
        rows.withColumn("_ratio", F.col(cap) / F.col(want))
        .withColumn("_tie", F.monotonically_increasing_id())
        .withColumn("_full", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("_open", F.sum(want).over(upto_end))
        .withColumn("_level", (total - F.col("_full")) / F.col("_open"))
        .withColumn(
            "_level",
            F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_tie", "_level")))
            .over(group)
            .getField("_level"),
        )
    )
    share = F.least(F.col(cap), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col(want))
    return rows.withColumn("share", share).drop("_ratio", "_tie", "_full", "_open", "_level")


def _rank(doc_id: Column, fraction: Column, seed: int) -> Column:
    """Pareto rank q / (1 + q) for q = odds of a uniform number / odds of inclusion."""
    bits = F.xxhash64(F.lit(seed), doc_id).bitwiseAND(F.lit((1 << 52) - 1))
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    q = (u / (1.0 - u)) / (fraction / (1.0 - fraction))
    return F.when(fraction > 0, q / (1.0 + q)).otherwise(F.lit(1.0))


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """From rows (doc_id, source, size): one row per source and length class with
    source_size, target, whole copies, inclusion fraction and the cut of the source."""
    per_class = stage(
        sizes.groupBy("source", length_class(F.col("size")).alias("size_class")).agg(
            F.sum("size").cast("double").alias("class_size")
        ),
        "class_sizes",
    )
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"),
    )
    sources = (
        per_class.groupBy("source")
        .agg(F.sum("class_size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", MAX_COPIES * F.col("source_size"))
        .withColumn("everything", F.sum("source_size").over(Window.partitionBy()))
    )
    sources = _share(sources, [], F.col("everything"), "cap", "weight").select(
        "source", "weight", "source_size", F.col("share").alias("target")
    )
    classes = per_class.where("class_size > 0").join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    )
    classes = (
        classes.withColumn("cap", MAX_COPIES * F.col("class_size"))
        .withColumn("want", class_preference(F.col("size_class")) * F.col("class_size"))
    )
    classes = _share(classes, ["source"], F.col("target"), "cap", "want")
    copies = F.col("share") / F.col("class_size")
    whole = F.least(F.floor(copies + 1e-9), F.lit(MAX_COPIES))
    classes = stage(
        classes.withColumn("whole", whole.cast("int"))
        .withColumn("fraction", F.greatest(copies - whole, F.lit(0.0)))
        .withColumn(
            "rest",
            F.greatest(
                F.col("target")
                - F.sum(whole * F.col("class_size")).over(Window.partitionBy("source")),
                F.lit(0.0),
            ),
        )
        .select(
            "source", "size_class", "weight", "source_size", "target", "whole", "fraction", "rest"
        ),
        "classes",
    )
    ranked = _with_classes(sizes.where("size > 0"), classes).select(
        "source",
        "size",
        "rest",
        _id(F.col("doc_id")).alias("id"),
        "fraction",
        _rank(F.col("doc_id"), F.col("fraction"), seed).alias("rank"),
    ).where("fraction > 0")
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.max("rest").alias("rest"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut_bins = stage(
        bins.withColumn("filled", F.sum("bin_size").over(up_to) - F.col("bin_size"))
        .where("filled <= rest")
        .groupBy("source")
        .agg(F.max("bin").alias("cut_bin"), F.max("filled").alias("filled"))
        .withColumnRenamed("source", "_source"),
        "cut_bins",
    )
    in_bin = ranked.join(
        cut_bins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("cut_bin"))
    )
    order = Window.partitionBy("source").orderBy("rank", "id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    # up to the document whose middle still lies inside the rest
    cut = (
        in_bin.withColumn("end", F.col("filled") + F.sum("size").over(order))
        .withColumn("taken", F.col("end") - F.col("size") / 2.0 <= F.col("rest"))
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("taken"), F.struct("rank", "id"))).alias("cut"),
            F.max(F.when(F.col("taken"), F.col("end"))).alias("end"),
            F.first("cut_bin").alias("cut_bin"),
            F.first("filled").alias("filled"),
        )
        .select(
            F.col("source").alias("_source"),
            F.coalesce(
                "cut",
                F.struct(
                    (F.col("cut_bin") / float(BINS)).alias("rank"),
                    F.lit(-(1 << 63)).cast("bigint").alias("id"),
                ),
            ).alias("cut"),
            F.coalesce("end", "filled").alias("end"),
        )
    )
    cut = stage(cut, "cuts")
    # one document more or less per source closes the gap that is left
    gap = F.col("rest") - F.col("end")
    change = F.when(_below_cut(), -F.col("size")).otherwise(F.col("size"))
    closing = (
        ranked.join(cut, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("miss", F.abs(gap - change))
        .where(F.col("miss") < F.abs(gap))
        .groupBy("source")
        .agg(F.min(F.struct("miss", "id")).getField("id").alias("closing_id"))
        .withColumnRenamed("source", "_source3")
    )
    return stage(
        classes.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
        .join(closing, F.col("source").eqNullSafe(F.col("_source3")), "left")
        .select(
            "source", "size_class", "weight", "source_size", "target", "whole", "fraction",
            "cut", "closing_id",
        ),
        "mixing_plan",
    )


def _below_cut() -> Column:
    return F.struct(F.col("rank"), F.col("id")) <= F.col("cut")


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    classes = classes.withColumnsRenamed({"source": "_source2", "size_class": "_class2"})
    return rows.join(
        classes,
        F.col("source").eqNullSafe(F.col("_source2"))
        & (length_class(F.col("size")) == F.col("_class2")),
        "left",
    ).drop("_source2", "_class2")


def planned_copies(rows: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """``rows`` (with doc_id, source, size) plus source_size, target, inclusion and
    copies, by the plan."""
    id_, rank = _id(F.col("doc_id")), _rank(F.col("doc_id"), F.col("fraction"), seed)
    below = (F.col("fraction") > 0) & (F.struct(rank.alias("rank"), id_.alias("id")) <= F.col("cut"))
    below = F.coalesce(below, F.lit(False))
    closing = F.coalesce((F.col("fraction") > 0) & (id_ == F.col("closing_id")), F.lit(False))
    copies = F.coalesce(F.col("whole"), F.lit(0)) + (below != closing).cast("int")
    return _with_classes(rows, plan).withColumn("copies", copies)


def mix_sizes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(staged rows doc_id, source, size; staged plan)."""
    sizes = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
        ),
        "sizes",
    )
    return sizes, mixing_plan(sizes, weights, seed)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    Sources by code point, null last, take the weights in turn. Sizes are words; a null
    or empty text has size 0 and is never taken. Rows that repeat a doc_id and size in a
    source share one decision. With no words at all every target is 0; an empty table
    gives no rows. Results depend on the rows and the seed only.
    """
    sizes, plan = mix_sizes(docs, weights=weights, seed=seed)
    totals = plan.groupBy("source").agg(
        F.max("source_size").alias("source_size_"), F.max("target").alias("target_")
    ).withColumnRenamed("source", "_source4")
    return (
        planned_copies(sizes, plan, seed)
        .join(totals, F.col("source").eqNullSafe(F.col("_source4")), "left")
        .select(
            "doc_id",
            "source",
            "size",
            F.coalesce(F.col("source_size_"), F.lit(0.0)).cast("bigint").alias("source_size"),
            F.coalesce(F.col("target_"), F.lit(0.0)).alias("target"),
            "copies",
            (F.col("size") * F.col("copies")).cast("bigint").alias("taken"),
        )
    )


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 1
) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, columns unchanged.

    The text is read twice and never shuffled when the plan is small.
    """
    _, plan = mix_sizes(docs, weights=weights, seed=seed)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
    )
    return (
        planned_copies(rows, plan, seed)
        .where("copies > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
        .select("_row.*")
    )
