"""Token ids packed into fixed-length rows by best-fit decreasing.

A task encodes its documents and packs them in windows of about ``WINDOW_TOKENS``. In a
window the segments are taken longest first, each into the open row with the least
capacity that still holds it; a segment tree over capacities finds that row. Documents
longer than a row are cut into full rows and a rest, so nothing is lost. Windows bound a
task's memory; each ends with few rows that are not full. Which documents share a row
depends on the partitions of the input; what a document's pieces say does not.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage
from .arrays import slices
from .bpe import read_ranks

WINDOW_TOKENS = 1 << 20


class CapacityTree:
    """Multiset of capacities 0 to ``largest`` with search for the least one at or above
    a bound. Inner nodes count what is below them."""

    def __init__(self, largest: int):
        self._leaves = 1 << largest.bit_length()
        self._count = [0] * (2 * self._leaves)

    def add(self, capacity: int, change: int = 1) -> None:
        node = capacity + self._leaves
        while node:
            self._count[node] += change
            node >>= 1

    def least_at_least(self, bound: int) -> int:
        """-1 when there is none."""
        count, node = self._count, bound + self._leaves
        if node >= 2 * self._leaves:
            return -1
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self._leaves:
                node = 2 * node + (not count[2 * node])
        return node - self._leaves


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into ``sizes`` (each at most ``length``), every index once."""
    tree = CapacityTree(length)
    rows: list[list[int]] = []
    free: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        capacity = tree.least_at_least(sizes[i])
        if capacity < 0:
            row, capacity = len(rows), length
            rows.append([])
        else:
            row = free[capacity].pop()
            tree.add(capacity, -1)
        rows[row].append(i)
        left = capacity - sizes[i]
        if left:
            free.setdefault(left, []).append(row)
            tree.add(left)
    return rows


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions of a row: from 0 at every segment start, 0 in the padding."""
    out = np.zeros(length, np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out


def pack_documents(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    eos_id: int,
    length: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    positions: bool = False,
) -> DataFrame:
    """One row per packed row: ids (``length`` little-endian numbers of 2 or 4 bytes, by
    the size of the vocabulary, padded with ``eos_id``), n_tokens, cu_seqlens (0 and the
    end of every segment), doc_ids, doc_rows and pieces (which part of which document a
    segment is), and with ``positions`` position_ids (2-byte numbers up to a length of
    65,536).

    Every document ends with ``eos_id``; a null or empty text is that one token. Positions
    restart at 0 with every segment. Repeated rows are packed as often as they come, told
    apart by doc_rows, a number of its own for every input row. Extra columns are ignored,
    an empty table gives no rows. Another layout of the input packs other rows together.
    """
    held = docs.sparkSession.sparkContext.broadcast(
        {"ranks": read_ranks(rank_path), "pattern": pattern}
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    place = "<u2" if length <= 1 << 16 else "<u4"

    def pack(segments: list[tuple], dtype) -> pa.RecordBatch:
        packed = best_fit_decreasing([len(s[3]) for s in segments], length)
        out: dict[str, list] = {name: [] for name in names}
        for members in packed:
            row = np.full(length, eos_id, dtype)
            ends = np.cumsum([0, *(len(segments[i][3]) for i in members)]).tolist()
            for i, a, b in zip(members, ends[:-1], ends[1:]):
                row[a:b] = segments[i][3]
            out["ids"].append(row.tobytes())
            out["n_tokens"].append(ends[-1])
            out["cu_seqlens"].append(ends)
            out["doc_ids"].append([segments[i][0] for i in members])
            out["doc_rows"].append([segments[i][1] for i in members])
            out["pieces"].append([segments[i][2] for i in members])
            if positions:
                out["position_ids"].append(position_ids(ends, length).astype(place).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in names.items()], list(names))

    names = {
        "ids": pa.binary(), "n_tokens": pa.int64(), "cu_seqlens": pa.list_(pa.int32()),
        "doc_ids": pa.list_(id_type), "doc_rows": pa.list_(pa.int64()), "pieces": pa.list_(pa.int32()),
    }
    schema = (
        f"ids binary, n_tokens bigint, cu_seqlens array<int>, doc_ids array<{kind.simpleString()}>, "
        "doc_rows array<bigint>, pieces array<int>"
    )
    if positions:
        names["position_ids"] = pa.binary()
        schema += ", position_ids binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        if "encoding" not in known:
            ranks = {
                base64.b64decode(t): int(r)
                for t, r in (line.split() for line in known["ranks"].splitlines() if line)
            }
            known["encoding"] = tiktoken.Encoding(
                "ranks", pat_str=known["pattern"], mergeable_ranks=ranks, special_tokens={}
            )
            known["width"] = np.dtype("<u2" if max(*ranks.values(), eos_id) < 1 << 16 else "<u4")
        encode, dtype = known["encoding"].encode_ordinary, known["width"]
        segments, held_tokens = [], 0
        for part in slices(batches):
            lists = (part.column(x).to_pylist() for x in ("doc_id", "row", "text"))
            for name, number, said in zip(*lists):
                tokens = np.array([*encode(said or ""), eos_id], dtype)
                for piece, at in enumerate(range(0, len(tokens), length)):
                    segments.append((name, number, piece, tokens[at : at + length]))
                held_tokens += len(tokens)
                if held_tokens >= WINDOW_TOKENS:
                    yield pack(segments, dtype)
                    segments, held_tokens = [], 0
        if segments:
            yield pack(segments, dtype)

    return rows.mapInArrow(run, schema)


def unpack_documents(packed: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, ids) of every packed document, its pieces joined in order: one row per
    row that was packed, repeated and null doc_ids included. No packed rows, no rows."""
    kind = packed.schema["doc_ids"].dataType.elementType
    id_type, dtype = to_arrow_type(kind), np.dtype(f"<u{width}")
    parts = ["ids", "cu_seqlens", "doc_ids", "doc_rows", "pieces"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, ends, *lists in zip(*(batch.column(x).to_pylist() for x in parts)):
                ids = np.frombuffer(raw, dtype)
                for name, number, piece, a, b in zip(*lists, ends[:-1], ends[1:]):
                    out.append((name, number, piece, ids[a:b].tolist()))
            columns = zip(*out) if out else ([], [], [], [])
            kinds = (id_type, pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds)], ["doc_id", "row", "piece", "ids"]
            )

    pieces = packed.select(*parts).mapInArrow(
        run, f"doc_id {kind.simpleString()}, row bigint, piece int, ids array<int>"
    )
    joined = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    return (
        pieces.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.flatten(joined.getField("ids")).alias("ids"))
        .select("doc_id", "ids")
    )


def write_packed(packed: DataFrame, path: str | None = None) -> DataFrame:
    """Write the packed rows as Parquet files (ids and position resets as rows of a fixed
    number of bytes, cumulative lengths as lists) and return the written table. Without
    ``path`` the files are a stage table; an existing ``path`` is an error."""
    if path is None:
        return stage(packed, "packed")
    packed.write.parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)
