"""Seeded order, exact ranks and samples without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SEED = 42


def seeded_key(id_col: Column, seed: int = SEED) -> Column:
    """Pseudo-random but reproducible sort key of a row id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(seeded_key(F.col(id_col), seed), id_col)


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows in seeded order: a distributed top-n, not a full sort."""
    return seeded_shuffle(df, id_col, seed).limit(n)


def running_totals(
    df: DataFrame, order: Sequence[Column | str], amount: str | None = None, before: str = "before"
) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before it in ``order`` (without
    ``amount``: their number). A range sort, written once, and one start per partition.

    Partitions of a range sort follow each other, so a row's sum is that of its partition
    so far plus all of the partitions before. Only the starts pass a single task, one row
    per shuffle partition. Rows that tie in ``order`` follow each other in some order. The
    sort looks at a sample of ``df`` first, so ``df`` should be a stored table.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the partition above 33 bits of the row's place in it
    placed = stage(spread.withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("__id", 33)
    if amount is None:
        size, so_far = F.count(F.lit(1)), F.col("__id").bitwiseAND((1 << 33) - 1)
    else:
        size = F.sum(amount)
        inside = Window.partitionBy(part).orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
        so_far = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("__part")).agg(size.alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    return (
        placed.withColumn("__so_far", so_far)
        .join(F.broadcast(starts), part == F.col("__part"))
        .withColumn(before, F.col("__start") + F.col("__so_far"))
        .drop("__id", "__part", "__start", "__so_far")
    )


def positions(
    df: DataFrame, order: Sequence[Column | str], position: str = "position"
) -> DataFrame:
    """``df`` with its 0-based position in ``order``; see ``running_totals``."""
    return running_totals(df, order, None, position)


def ranks(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Exact 1-based rank over ``order`` (within ``by``).

    All groups share one range sort, so a group of any size is spread over many tasks: a
    rank is a position less the position where its group starts. Rows are computed once
    and written twice, so ``df`` should hold few columns. ``total`` optionally names a
    column with the group's row count.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    present = [F.col(c).isNull() for c in by]
    sorted_rows = positions(stage(df, "keys"), [*by, *order], "__position")
    group = F.struct(F.lit(0), *keys, *present)  # null is a group of its own
    first = sorted_rows.groupBy(group.alias("__group")).agg(
        F.min("__position").alias("__first"), F.count(F.lit(1)).alias("__total")
    )
    ranked = sorted_rows.join(first, group == F.col("__group")).withColumn(
        rank, F.col("__position") - F.col("__first") + 1
    )
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop("__position", "__group", "__first", "__total")


def seeded_rank(
    df: DataFrame,
    id_col: str,
    by: Sequence[str] = (),
    seed: int = SEED,
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Rank in seeded order."""
    keyed = df.withColumn("__key", seeded_key(F.col(id_col), seed))
    return ranks(keyed, ["__key", id_col], by, rank, total).drop("__key")


def dense_ids(df: DataFrame, order: str, id_format: str) -> DataFrame:
    """Add ``row_id``: the row's 0-based position by a unique ``order`` column, printed
    with ``id_format`` (for example ``sp_%06d``)."""
    return positions(stage(df, "keys"), [order], "__position").withColumn(
        "row_id", F.format_string(id_format, F.col("__position"))
    ).drop("__position")


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per group. Spark applies the limit before the shuffle as
    well, so a hot group sends at most ``n`` rows per task."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def sample_per_group(
    df: DataFrame, by: str, id_col: str, n: int, seed: int = SEED, salts: int = 64
) -> DataFrame:
    """``n`` rows per group in seeded order (large ``n``). Each salt keeps its own
    first ``n``; the group's first ``n`` are then chosen from at most n * salts."""
    keyed = df.withColumn("__key", seeded_key(F.col(id_col), seed)).withColumn(
        "__salt", F.pmod(F.xxhash64("__key"), F.lit(salts))
    )
    order = [F.col("__key"), F.col(id_col)]
    first = top_per_group(keyed, [by, "__salt"], order, n, "__rn")
    return top_per_group(first, [by], order, n, "__rn").drop("__key", "__salt", "__rn")
