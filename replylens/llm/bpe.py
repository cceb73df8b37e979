"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are cut by the tokenizer's pattern. The distinct pieces that a worker has not met
yet are sorted into buckets by length and laid out as padded matrices of token ids. In
each round every row merges its leftmost pair of minimum rank, ranks come from a hashed
pair table, rows without a pair leave, and the others close up by one column. Pieces
longer than ``MATRIX_BYTES`` are merged with a heap in the same order, which takes
n log n steps where the matrix would take n rounds.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices

MATRIX_BYTES = 256
MATRIX_CELLS = 1 << 21
#: pieces a worker remembers; when full it forgets them all
MEMORY = 200_000
MEMORY_CHARS = 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> bytes:
    """The rank file as bytes: lines of base64 token and rank."""
    with open(path, "rb") as file:
        return file.read()


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of the joined token."""

    def __init__(self, pairs: np.ndarray, ids: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, _EMPTY)
        self._ids = np.full(1 << bits, _NONE)
        slot = ((pairs * _SPREAD) >> self._shift).astype(np.int64)
        while len(pairs):
            free = self._keys[slot] == _EMPTY
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            placed = np.zeros(len(slot), bool)
            placed[first] = True
            placed &= free
            self._keys[slot[placed]], self._ids[slot[placed]] = pairs[placed], ids[placed]
            pairs, ids, slot = pairs[~placed], ids[~placed], (slot[~placed] + 1) & self._mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joined ids, ``_NONE`` where a pair is none. Ids are also the ranks."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((keys * _SPREAD) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == keys, self._ids[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ids[slot[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out

    def rank(self, left: int, right: int) -> int:
        return int(self.ranks(np.array([left]), np.array([right]))[0])


class ByteBPE:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in rank_file.splitlines() if line)
        }
        self._find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        pairs: list[tuple[int, int, int]] = []
        get = ranks.get
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        table = np.array(pairs, np.uint64).reshape(-1, 3)
        self._pairs = PairTable(
            (table[:, 0] << np.uint64(32)) | table[:, 1], table[:, 2].astype(np.int32)
        )
        self._byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._names = [str(i) for i in range(len(self.tokens))]
        self._memory: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for row in np.flatnonzero(sizes > MATRIX_BYTES):
            out[row] = self._by_heap(pieces[row])
        upper = 1
        while upper <= MATRIX_BYTES:
            rows = np.flatnonzero((sizes > upper // 2) & (sizes <= upper))
            step = max(1, MATRIX_CELLS // upper)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                self._by_matrix([pieces[r] for r in part], part, upper, out)
            upper *= 2
        return out

    def _by_matrix(
        self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[tuple[int, ...]]
    ) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self._byte_ids[raw.reshape(-1, width)]
        length = np.array([len(p) for p in pieces])
        while len(rows):
            columns = ids.shape[1]
            if columns > 1:
                ranks = self._pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel())
                ranks = ranks.reshape(len(rows), columns - 1)
                ranks[np.arange(columns - 1) >= (length - 1)[:, None]] = _NONE
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                done = best == _NONE
            else:
                done = np.ones(len(rows), bool)
            for k in np.flatnonzero(done):
                out[rows[k]] = tuple(ids[k, : length[k]].tolist())
            if done.all():
                return
            ids, rows, length, at, best = (x[~done] for x in (ids, rows, length, at, best))
            ids[np.arange(len(rows)), at] = best
            keep = np.arange(columns - 1)
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)
            length = length - 1

    def _by_heap(self, piece: bytes) -> tuple[int, ...]:
        """The same merges, lowest rank first and leftmost among equals."""
        ids = self._byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self._pairs.ranks(ids[:-1], ids[1:])
        at = np.flatnonzero(first != _NONE)
        heap = list(zip(first[at].tolist(), at.tolist(), ids[at].tolist(), ids[at + 1].tolist()))
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def offer(i: int, j: int) -> None:
            pair = ids[i], ids[j]
            rank = known.get(pair)
            if rank is None:
                rank = known[pair] = self._pairs.rank(*pair)
            if rank != _NONE:
                heapq.heappush(heap, (rank, i, *pair))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return tuple(x for x in ids if x >= 0)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        cut = [self._find(text) if text else [] for text in texts]
        memory = self._memory
        fresh = [p for p in set().union(*cut) if p not in memory]
        coded = dict(zip(fresh, self.encode_pieces([p.encode() for p in fresh])))
        if len(memory) + len(coded) > MEMORY:
            for pieces in cut:
                coded.update((p, memory[p]) for p in pieces if p in memory)
            memory.clear()
        else:
            memory.update((p, ids) for p, ids in coded.items() if len(p) <= MEMORY_CHARS)
        get = memory.get
        out = []
        for pieces in cut:
            try:
                out.append(list(chain.from_iterable(map(memory.__getitem__, pieces))))
            except KeyError:
                out.append(
                    list(chain.from_iterable(get(p) or coded[p] for p in pieces))
                )
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """(of the ids as decimals joined by a space, of the decoded bytes): sha256."""
        decimals = " ".join(map(self._names.__getitem__, ids)).encode()
        return hashlib.sha256(decimals).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


class _Shared:
    """An encoder built on the executor from broadcast bytes. It is kept beside them, so
    a worker builds it once, with the pieces it remembers."""

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str):
        self._held = spark.sparkContext.broadcast({"ranks": read_ranks(rank_path)})
        self._pattern = pattern

    def load(self) -> ByteBPE:
        held = self._held.value
        if "encoder" not in held:
            held["encoder"] = ByteBPE(held["ranks"], self._pattern)
        return held["encoder"]


def shared_encoder(spark: SparkSession, rank_path: str, pattern: str) -> _Shared:
    """A handle whose ``load()`` gives the encoder inside a task. The rank file is read
    once, by the driver; its size is that of the vocabulary."""
    return _Shared(spark, rank_path, pattern)


def encode_documents(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
) -> DataFrame:
    """One row per input row: doc_id and the chosen outputs, out of n_tokens, ids
    (array of int), ids_sha256 and decoded_sha256 (of what the ids decode to).

    A null text counts as empty: no tokens, digests of the empty string. Repeated rows
    are encoded alike, extra columns are ignored, an empty table gives no rows.
    """
    kinds = {
        "n_tokens": ("bigint", pa.int64()),
        "ids": ("array<int>", pa.list_(pa.int32())),
        "ids_sha256": ("string", pa.string()),
        "decoded_sha256": ("string", pa.string()),
    }
    encoder = shared_encoder(docs.sparkSession, rank_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder.load()
        for part in slices(batches):
            ids = bpe.encode(part.column("text").to_pylist())
            made: dict[str, list] = {"n_tokens": [len(x) for x in ids], "ids": ids}
            if {"ids_sha256", "decoded_sha256"} & set(outputs):
                made["ids_sha256"], made["decoded_sha256"] = zip(*map(bpe.digests, ids))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(made[x], kinds[x][1]) for x in outputs)],
                ["doc_id", *outputs],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{x} {kinds[x][0]}" for x in outputs)])
    return rows.mapInArrow(run, schema)


def decode_documents(
    rows: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text. Bytes that
    are no UTF-8 (ids cut out of a text) become U+FFFD."""
    encoder = shared_encoder(rows.sparkSession, rank_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder.load()
        for batch in batches:
            texts = [
                bpe.decode(x or ()).decode(errors="replace")
                for x in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    picked = rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, text string")
