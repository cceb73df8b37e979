"""Removing long byte strings that occur more than once, by names of growing length.

Prefix doubling names every position by the text that follows it and sorts pairs of
names to name twice the length, until names are unique or long enough. Positions here
leave as early as they can:

1. 64 bytes: of every ``length``-byte string only its anchor is named, the position of
   the smallest 64-byte hash inside (about one position in seventy). Equal strings have
   equal anchors, so where an anchor's name is unique nothing repeats.
2. Runs: neighbouring strings with one anchor form a run of up to 137. Runs that agree
   as a whole settle all their strings with one row.
3. ``length`` bytes: what is left, mostly the edges of repeated passages, is named string
   by string, from the pair of names at its start and at an offset that ends with it.

Each level is a sort (shuffle) of names in Spark; equal names meet, unique ones go.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage
from .arrays import RollingHash, mix, slices, text_bytes

ANCHOR_BYTES = 64
SLICE = 1 << 20
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(
    data: np.ndarray, offsets: np.ndarray, length: int
) -> tuple[RollingHash, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start, count, anchor name, run name): neighbouring ``length``-byte strings
    with one anchor. Strings do not cross the rows that ``offsets`` bound."""
    hashes = RollingHash(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return hashes, none, none, none, none
    names = hashes.windows(ANCHOR_BYTES)
    keyed = (names & ~_LOW) | np.arange(len(names), dtype=np.uint64)
    anchor = (sliding_minimum(keyed, length - ANCHOR_BYTES + 1) & _LOW).astype(np.int64)
    change = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(change[: len(anchor)]))
    if not len(at):
        return hashes, none, none, none, none
    a = anchor[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    start, count = at[first], np.diff(np.append(first, len(at)))
    whole = hashes.of(start, start + count - 1 + length)
    # the anchor's place in the run is part of the name, though equal runs agree on it
    return hashes, start, count, names[a[first]].view(np.int64), whole.view(np.int64)


def string_names(hashes: RollingHash, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length`` bytes from each position: a pair of names of the largest
    power of two below, at the start and at the offset where it ends with the string."""
    half = 1 << ((length - 1).bit_length() - 1)
    left, right = hashes.of(at, at + half), hashes.of(at + length - half, at + length)
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right).view(np.int64)


def removed_spans(
    n_bytes: int, starts: np.ndarray, counts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of bytes covered by the strings from ``starts``
    on, ``counts`` each."""
    change = np.zeros(n_bytes + 2, np.int32)
    np.add.at(change, starts + 1, 1)
    np.add.at(change, np.minimum(starts + counts - 1 + length, n_bytes) + 1, -1)
    inside = np.cumsum(change) > 0
    edge = np.diff(inside.astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _finish(text: bytes, starts, counts, length: int) -> tuple[int, int, str]:
    """(bytes removed, spans, digest of the rest)."""
    begin, end = removed_spans(len(text), np.asarray(starts, np.int64), np.asarray(counts, np.int64), length)
    digest, last = hashlib.sha256(), 0
    for b, e in zip(begin.tolist(), end.tolist()):
        digest.update(text[last:b])
        last = e
    digest.update(text[last:])
    return int((end - begin).sum()), len(begin), digest.hexdigest()


def _positions(found: list[tuple[int, int]]) -> np.ndarray:
    """Starts of the strings of runs (start, count)."""
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(s, s + c) for s, c in found)])


def _free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects their handles; ask for it between the
    large steps, whose results are staged tables."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)  # references from Python to the JVM are dropped by a thread
        spark.sparkContext._jvm.System.gc()


#: a run has fewer strings than this, so one number can hold its start and count
_COUNT = 1 << 12


def _run_rows(rows: DataFrame, length: int, located: bool) -> DataFrame:
    """The anchor of every run; when ``located`` also its name (whole), its document
    (mark) and place (start and count in one number)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            data, offsets = text_bytes(part.column("text"))
            _, start, count, anchor, whole = runs(data, offsets, length)
            columns = {"anchor": pa.array(anchor)}
            if located:
                row = np.searchsorted(offsets, start, "right") - 1
                columns |= {
                    "whole": pa.array(whole),
                    "mark": part.column("mark").take(pa.array(row)),
                    "place": pa.array((start - offsets[row]) * _COUNT + count),
                }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "anchor bigint" + (", whole bigint, mark bigint, place bigint" if located else "")
    return rows.mapInArrow(run, schema)


def _settle(rows: DataFrame, kind, length: int) -> DataFrame:
    """From text and the runs that matter: documents that are done, and the others with
    their text, settled runs and the names of their open strings."""
    id_type = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            out: dict[str, list] = {name: [] for name in fields}
            texts = part.column("text").to_pylist()
            ids = part.column("doc_id").to_pylist()
            for doc_id, text, found in zip(ids, texts, part.column("found").to_pylist()):
                text = (text or "").encode()
                said = [(*divmod(e >> 2, _COUNT), e & 2, e & 1) for e in found or ()]
                done = [(s, c) for s, c, is_settled, _ in said if is_settled]
                unsettled = [(s, c) for s, c, is_settled, _ in said if not is_settled]
                standing = [(s, c) for s, c, is_settled, is_first in said if is_settled and is_first]
                starts, counts = [s for s, _ in done], [c for _, c in done]
                removed = spans = digest = body = names = None
                if unsettled:
                    body = text
                else:
                    removed, spans, digest = _finish(text, starts, counts, length)
                if unsettled or standing:
                    at = _positions(unsettled + standing)
                    names = string_names(RollingHash(np.frombuffer(text, np.uint8)), at, length)
                places = [s * _COUNT + c for s, c in unsettled]
                n_open = sum(c for _, c in unsettled)
                values = (doc_id, len(text), removed, spans, digest, body, starts, counts, places, n_open, names)
                for name, value in zip(fields, values):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[name], kind_) for name, kind_ in fields.items()], list(fields)
            )

    longs = pa.list_(pa.int64())
    fields = {
        "doc_id": id_type, "n_bytes": pa.int64(), "n_removed": pa.int64(),
        "n_spans": pa.int64(), "kept_sha256": pa.string(), "body": pa.binary(),
        "starts": longs, "counts": longs, "places": longs, "n_open": pa.int64(), "names": longs,
    }
    return rows.mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "kept_sha256 string, body binary, starts array<bigint>, counts array<bigint>, "
        "places array<bigint>, n_open bigint, names array<bigint>",
    )


def _finish_open(rows: DataFrame, kind, length: int) -> DataFrame:
    id_type = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body", SLICE):
            results = []
            lists = [part.column(x).to_pylist() for x in ("body", "starts", "counts", "places", "more")]
            for body, starts, counts, places, more in zip(*lists):
                at = _positions([divmod(p, _COUNT) for p in places])[np.array(more or [], int)]
                results.append(_finish(body, starts + at.tolist(), counts + [1] * len(at), length))
            removed, spans, digest = zip(*results)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(id_type),
                    part.column("n_bytes"),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(digest, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    )


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty. Every byte covered by a ``length``-byte
    string that also starts at another position of any document (the same one included)
    goes; occurrences may overlap, none is spared, and strings are judged on the input.
    n_spans counts the maximal removed runs of bytes, kept_sha256 digests what is left.
    Rows repeating a doc_id or a whole text count as different places; rows are told
    apart by 64-bit hashes of doc_id and text, strings by 64-bit names. Texts shorter than
    ``length`` stay whole. Other columns are ignored; an empty table gives no rows.
    ``length`` is 64 to 4,096.
    """
    if not ANCHOR_BYTES <= length <= _COUNT:
        raise ValueError(f"length must be {ANCHOR_BYTES} to {_COUNT}")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "mark", F.xxhash64("doc_id", "text")
    )
    kind = rows.schema["doc_id"].dataType
    # anchors whose name repeats
    anchors = stage(
        _run_rows(rows, length, False)
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("anchor"),
        "anchors",
    )
    _free_shuffles(spark)
    located = stage(_run_rows(rows, length, True).join(anchors, "anchor"), "repeated")
    _free_shuffles(spark)
    # runs that occur as a whole elsewhere are settled; one of them stands for all where
    # other runs have the same anchor
    groups = stage(
        located.groupBy("anchor", "whole").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("mark", "place")).alias("first")
        ),
        "run_groups",
    )
    mixed = stage(
        groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("names")).where("names > 1").select("anchor"),
        "mixed_anchors",
    )
    groups = stage(
        groups.join(mixed.withColumn("mixed", F.lit(True)), "anchor", "left").select(
            "anchor", "whole", (F.col("n") > 1).alias("settled"),
            F.when(F.col("mixed"), F.col("first")).alias("first"),
        ),
        "judged_groups",
    )
    # a run that is neither settled nor mixed cannot be: its anchor repeats
    # equal rows say the same of one mark: what they say is merged before the shuffle, and
    # a mark's entries are as many as its text has runs, however often the row comes
    is_first = F.coalesce(F.struct("mark", "place") == F.col("first"), F.lit(False))
    entry = F.col("place") * 4 + F.col("settled").cast("int") * 2 + is_first.cast("int")
    found = (
        located.join(groups, ["anchor", "whole"])
        .select("mark", entry.alias("entry"))
        .groupBy("mark")
        .agg(F.collect_set("entry").alias("found"))
    )
    settled = _settle(rows.join(found, "mark", "left").select("doc_id", "text", "found"), kind, length)
    settled = stage(settled.withColumn("row", F.monotonically_increasing_id()), "settled")
    _free_shuffles(spark)
    strings = settled.where("names is not null").select(
        "row", "n_open", F.posexplode("names").alias("nth", "name")
    )
    repeated = stage(
        strings.groupBy("name")
        .agg(F.sum(F.when(F.col("nth") >= F.col("n_open"), 2).otherwise(1)).alias("n"))
        .where("n > 1")
        .select("name"),
        "repeated_strings",
    )
    _free_shuffles(spark)
    more = (
        strings.where("nth < n_open")
        .select("row", "nth", "name")
        .join(repeated, "name")
        .groupBy("row")
        .agg(F.collect_list("nth").alias("more"))
    )
    open_ = settled.where("body is not null").join(more, "row", "left").select(
        "doc_id", "n_bytes", "body", "starts", "counts", "places", "more"
    )
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return settled.where("body is null").select(columns).union(_finish_open(open_, kind, length))
