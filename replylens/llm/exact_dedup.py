"""Exact de-duplication by a tree merge of sorted digest runs.

Each partition of the input forms one run: its digests in order, one entry per
digest. Rounds of the tree then merge the runs of ``FAN_IN`` neighbours. In a round
the merging runs are exchanged by digest range, so every round uses all tasks and no
task sees more than ``FAN_IN`` entries of one digest, however many copies there are.
After the last round one entry per digest is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

FAN_IN = 8
_KEY = ("grp", "digest", "proof")
_RANK = ("neg_chars", "keep_id", "keep_pos")


def normalised(text: Column) -> Column:
    """The text without 0x20 and 0x09-0x0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of equal entries, with their summed count. Rows come sorted by key and
    rank; two entries are equal when the digest and the second hash agree."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # fields differ in whether they say "not null"
        batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
        if held is not None:
            table = pa.Table.from_batches([held, batch]).combine_chunks()
            batch = table.to_batches()[0]
        n = batch.num_rows
        fresh = np.ones(n, bool)
        if n > 1:
            same = np.ones(n - 1, bool)
            for name in _KEY:
                column = batch.column(name)
                same &= pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(
                    zero_copy_only=False
                )
            fresh[1:] = ~same
        at = np.flatnonzero(fresh)
        sums = np.add.reduceat(batch.column("n").to_numpy(), at)
        kept = batch.take(pa.array(at)).set_column(
            batch.schema.get_field_index("n"), "n", pa.array(sums)
        )
        if kept.num_rows > 1:
            yield kept.slice(0, kept.num_rows - 1)
        held = kept.slice(kept.num_rows - 1)
    if held is not None:
        yield held


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged: one narrow row per document with its digest, its run and its place."""
    clean = normalised(F.col(text))
    return stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("chars"),
            F.unhex(F.sha2(clean, 256)).alias("digest"),
            F.xxhash64(clean).alias("proof"),
            F.spark_partition_id().cast("bigint").alias("run"),
            F.monotonically_increasing_id().alias("pos"),
        ),
        "digests",
    )


def merge_runs(rows: DataFrame) -> DataFrame:
    """One entry per digest: (digest, proof, keep_id, keep_pos, n), by the tree."""
    order = [*_KEY, *_RANK]
    level = rows.select(
        F.col("run").alias("grp"),
        "digest",
        "proof",
        (-F.col("chars")).alias("neg_chars"),
        F.col("doc_id").alias("keep_id"),
        F.col("pos").alias("keep_pos"),
        F.lit(1).cast("bigint").alias("n"),
    )
    level = level.sortWithinPartitions(*order).mapInArrow(_merge, level.schema)
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        runs = -(-runs // FAN_IN)
        level = level.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("bigint"))
        level = (
            level.repartition("grp", F.substring("digest", 1, 2))
            .sortWithinPartitions(*order)
            .mapInArrow(_merge, level.schema)
        )
        if runs == 1:
            return level.drop("grp", "neg_chars")


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after white space (0x20, 0x09-0x0D) is deleted.
    The row with the most code points in its original text stays, then the smallest
    doc_id; of rows that repeat a doc_id with an equal text exactly one is ``kept``.
    Null texts count as empty and so form one group; a null doc_id sorts before all
    others. An empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    rows = digests(docs, doc_id, text)
    winners = stage(merge_runs(rows), "winners")
    return rows.join(winners, ["digest", "proof"]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("pos") == F.col("keep_pos")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and nothing added.

    Of rows repeating one doc_id and text, one stays (which one is open where other
    columns differ).
    """
    kept = exact_duplicates(docs, doc_id, text).where("kept").select(
        _row_key(F.col("doc_id"), F.col("text_sha256")).alias("_key")
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        _row_key(F.col(doc_id), F.sha2(normalised(F.col(text)), 256)).alias("_key"),
    )
    # numbering repeated rows reuses the partitions and the order of the join
    place = Window.partitionBy("_key").orderBy(F.length(F.col(f"_row.`{text}`")).desc_nulls_last())
    return (
        whole.join(kept, "_key", "left_semi")
        .withColumn("_place", F.row_number().over(place))
        .where("_place = 1")
        .select("_row.*")
    )


def _row_key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", sha, F.coalesce(doc_id.cast("string"), F.lit("null")))
