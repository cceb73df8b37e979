"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into phrases, each one byte longer than a phrase seen before
(LZ78). Texts that would help compress each other share many phrases, so the set of
phrase hashes stands for the text, and a signature of minimum hashes stands for the
set: one hash function deals the phrases to ``BINS`` bins, each bin keeps its minimum,
and an empty bin borrows from the next one that is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import RollingHash, slices

BINS = 128
_BIN_SHIFT = np.uint64(64 - 7)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: chance that two unequal 8-bit minima agree
_CHANCE = 1.0 / 256


def phrase_ends(data: bytes) -> list[int]:
    """Where the phrases of ``data`` end (the last byte of each). A tail that repeats an
    earlier phrase adds none."""
    children: dict[int, int] = {}
    get = children.get
    ends: list[int] = []
    add = ends.append
    node, fresh = 0, 256
    for i, byte in enumerate(data):
        key = node + byte
        node = get(key, 0)
        if not node:
            children[key] = fresh
            fresh += 256
            add(i)
    return ends


def signatures(texts: list[bytes]) -> np.ndarray:
    """(len(texts), BINS) minima of 8 bits; all zero for an empty text, never else."""
    out = np.zeros((len(texts), BINS), np.uint8)
    ends = [np.array(phrase_ends(t), np.int64) for t in texts]
    counts = np.array([len(e) for e in ends])
    if not counts.sum():
        return out
    base = np.cumsum([0, *(len(t) for t in texts)])
    start = np.concatenate([b + np.concatenate([[0], e[:-1] + 1]) for b, e in zip(base, ends) if len(e)])
    end = np.concatenate([b + e + 1 for b, e in zip(base, ends) if len(e)])
    hashes = RollingHash(np.frombuffer(b"".join(texts), np.uint8)).of(start, end)
    row = np.repeat(np.arange(len(texts)), counts)
    minima = np.full(len(texts) * BINS, _TOP)
    np.minimum.at(minima, row * BINS + (hashes >> _BIN_SHIFT).astype(np.int64), hashes)
    minima = minima.reshape(-1, BINS)
    for k in np.flatnonzero(counts):
        empty = minima[k] == _TOP
        if empty.any():
            full = np.flatnonzero(~empty)
            bins = np.flatnonzero(empty)
            lender = full[np.searchsorted(full, bins) % len(full)]
            distance = ((lender - bins) % BINS).astype(np.uint64)
            minima[k, bins] = minima[k, lender] + distance * np.uint64(0x9E3779B97F4A7C15)
    low = (minima >> np.uint64(8)) ^ (minima >> np.uint64(33))
    out[:] = low.astype(np.uint8)
    out[counts > 0, 0] |= (~out[counts > 0].any(1)).astype(np.uint8)
    return out * (counts > 0)[:, None].astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common phrases, 0 to 1. Two empty texts are alike (1), an
    empty and another text are not (0)."""
    agree = ((a == b).mean(-1) - _CHANCE) / (1 - _CHANCE)
    nothing_a, nothing_b = ~a.any(-1), ~b.any(-1)
    return np.where(
        nothing_a | nothing_b, (nothing_a & nothing_b).astype(float), np.clip(agree, 0.0, 1.0)
    )


def as_text(signature: np.ndarray) -> str:
    return signature.tobytes().hex()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex). Null counts as empty; equal
    texts have equal fingerprints; other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            prints = [as_text(s) for s in signatures(texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


# --- each document against its successor in descending order of doc_id ---------------

#: ranges of ids that the documents are dealt to; a range is read in order by one task
BLOCKS = 2000
ROWS_PER_BLOCK = 64
_LOWEST = -(1 << 63)


def _in_blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, last, doc_id, text): ranges of doc_id, numbered from the largest ids
    down. Each range also holds the row that follows its end (``last``), which for the
    lowest range is the very first row. Only ids are looked at to find the ranges; the
    driver holds one id per range."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST).cast("bigint"))
    rows = docs.select(key.alias("key"), (-key.cast("double")).alias("place"), "doc_id", "text")
    steps = [i / BLOCKS for i in range(1, BLOCKS)]
    about = rows.agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("place", steps, 10 * BLOCKS).alias("cuts")
    ).first()
    wanted = max(1, min(BLOCKS, about["n"] // ROWS_PER_BLOCK))
    cuts = np.unique(np.array(about["cuts"] or [], float)[BLOCKS // wanted - 1 :: BLOCKS // wanted])
    splits = [-float("inf"), *cuts.tolist(), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="block").transform(rows)
    else:
        rows = rows.withColumn("block", F.lit(0.0))
    rows = rows.withColumn("block", F.col("block").cast("int"))
    firsts = sorted(rows.groupBy("block").agg(F.max("key").alias("key")).collect())
    before = [(f["key"], firsts[i - 1]["block"]) for i, f in enumerate(firsts)]
    before = docs.sparkSession.createDataFrame(before, "key bigint, before int")
    targets = F.array(
        F.struct("block", F.lit(False).alias("last")),
        F.struct(F.col("before").alias("block"), F.lit(True).alias("last")),
    )
    # one small row per range: at most BLOCKS of them
    dealt = rows.join(F.broadcast(before), "key", "left").withColumn(
        "target", F.explode(F.filter(targets, lambda t: t["block"].isNotNull()))
    )
    return dealt.select("target.block", "target.last", "doc_id", "text", "key")


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against an edited form of itself and against its successor.

    The successor is the next row by descending doc_id, after the last the first (rows
    repeating an id by text; a single row follows itself). Edited: the last
    floor(n_chars / 2) code points give way to the first as many (or all) of the
    successor. One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty, a null doc_id
    comes last; other columns are ignored; an empty table gives no rows. Ids are integers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        last: list[bool] = []
        for part in slices(batches):
            ids += part.column("doc_id").to_pylist()
            texts += [t or "" for t in part.column("text").to_pylist()]
            last += part.column("last").to_pylist()
            mine = [k for k in range(len(ids) - 1) if not last[k]]
            edited = []
            for k in mine:
                own, half = texts[k], len(texts[k]) // 2
                edited.append((own[: len(own) - half] + texts[k + 1][:half]).encode())
            prints = signatures([t.encode() for t in texts])
            edited_prints = signatures(edited)
            here = prints[mine]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in mine], id_type),
                    pa.array([len(texts[k]) for k in mine], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                    pa.array([as_text(s) for s in here], pa.string()),
                    pa.array([as_text(s) for s in edited_prints], pa.string()),
                    pa.array(likeness(here, edited_prints)),
                    pa.array(likeness(here, prints[[k + 1 for k in mine]])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                 "near_edited", "near_next"],
            )
            ids, texts, last = ids[-1:], texts[-1:], last[-1:]

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    rows = (
        _in_blocks(picked)
        .repartition("block")
        .sortWithinPartitions("block", "last", F.desc("key"), "text")
        .drop("key")
    )
    return rows.mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
