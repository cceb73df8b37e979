"""Removal of lines that many documents share, found with Bloom filters.

1. Hashes of all long lines, one per task and line, go to segments of the hash range. A
   segment adds them to a filter of hashes seen once and, where that one knows a hash
   already, to a filter of hashes seen twice. Only the second is kept, folded in half for
   as long as it stays sparse.
2. Lines that the second filter knows are suspected repeats. Only they are shuffled, as
   128-bit digests with their document, and counted exactly; no repeated line is missed,
   and a false alarm of the filters costs a row and changes nothing.
3. Digests in enough documents go back to the texts, each with the document that keeps it.

Line hashes are four bytes each when they are shuffled; texts are shuffled only where the
table of repeated lines is beyond the bound of a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .arrays import IS_SPACE, LOWER, SLICE_BYTES, RollingHash, mix, slices, text_bytes

MIN_CHARS, MIN_DOCS = 40, 5
#: lines per segment for which its filters are sized
SEGMENT_LINES = 1 << 21
#: a filter has 16 bits for each of them
_SEGMENT_BITS = 1 << 25
_MIN_BITS = 1 << 10
_PROBES = 4
#: bytes of filters, and of repeated lines, that a task may hold
BROADCAST_BYTES = 128 << 20
#: shares of a line that very many documents hold, where lines are joined by digest
_SALTS = 64
_BLANKS = bytes(np.flatnonzero(IS_SPACE).astype(np.uint8))


@dataclass(frozen=True)
class Lines:
    """The lines of some texts, in order."""

    data: np.ndarray  # bytes of all texts
    row: np.ndarray  # text of each line
    start: np.ndarray  # its bytes, line break excluded
    end: np.ndarray
    long: np.ndarray  # places of lines whose key has enough code points
    key_start: np.ndarray  # of the long lines: bytes of the key before lower-casing
    key_end: np.ndarray
    hash: np.ndarray

    def digest(self, i: int) -> bytes:
        key = self.data[self.key_start[i] : self.key_end[i]].tobytes().lower()
        return hashlib.blake2b(key, digest_size=16).digest()


def _long_keys(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, min_chars: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, key start, key end, hash) of the long ones of neighbouring lines."""
    base, part = int(start[0]), data[start[0] : end[-1]]
    # the nearest byte that is no blank, at or after (before) every place
    places = np.arange(len(part) + 1, dtype=np.int32)
    solid = np.append(~IS_SPACE[part], True)
    after = np.minimum.accumulate(np.where(solid, places, len(part))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid[:-1], places[:-1] + 1, 0), dtype=np.int32)
    a, b = start - base, end - base
    first = np.minimum(after[a], b)
    last = np.maximum(np.where(b > a, before[np.maximum(b - 1, 0)], a), first) if len(part) else first
    points = np.zeros(len(part) + 1, np.int32)
    np.cumsum((part & 0xC0) != 0x80, out=points[1:])
    long = np.flatnonzero(points[last] - points[first] >= min_chars)
    if not len(long):
        return long, long, long, np.zeros(0, np.uint64)
    first, last = first[long], last[long]
    hashes = RollingHash(LOWER[part]).of(first, last)
    return long, first + base, last + base, hashes


def _long_key(line: bytes, min_chars: int) -> tuple[int, int, int] | None:
    """(key start, key end, hash) of one line that is too long for array work."""
    first = len(line) - len(line.lstrip(_BLANKS))
    key = line.strip(_BLANKS)
    if len(key.decode(errors="replace")) < min_chars:
        return None
    if len(key) <= SLICE_BYTES:  # hashed as where the same key stands in a shorter line
        part = np.frombuffer(key, np.uint8)
        value = int(RollingHash(LOWER[part]).of(np.array([0]), np.array([len(part)]))[0])
    else:
        value = int.from_bytes(hashlib.blake2b(key.lower(), digest_size=8).digest(), "little")
    return first, first + len(key), value


def split_lines(column: pa.Array, min_chars: int) -> Lines:
    """Lines end at ``\\n``; a null or empty text is one empty line. Temporary arrays cover
    about ``SLICE_BYTES`` of text at a time, also inside one long text."""
    data, offsets = text_bytes(column)
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([offsets[1:], breaks]))
    inside = np.searchsorted(breaks, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(inside) + 1)
    found: list[tuple] = []
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + SLICE_BYTES, "right"))
        if j <= i:  # a line of its own
            key = _long_key(data[start[i] : end[i]].tobytes(), min_chars)
            if key:
                a, b, value = key
                found.append(
                    (np.array([i]), start[i : i + 1] + a, start[i : i + 1] + b,
                     np.array([value], np.uint64))
                )
            i += 1
            continue
        long, a, b, hashes = _long_keys(data, start[i:j], end[i:j], min_chars)
        found.append((long + i, a, b, hashes))
        i = j
    none = np.zeros(0, np.int64)
    parts = [np.concatenate(x) for x in zip(*found)] if found else [none] * 3 + [
        np.zeros(0, np.uint64)
    ]
    return Lines(data, row, start, end, *parts)


# ---------------------------------------------------------------------- filters


def _probes(names: np.ndarray, bits: int) -> np.ndarray:
    """(names, _PROBES) places in a filter of ``bits`` bits, a power of two. Half the size
    gives the same places modulo half, so that folded filters stay right."""
    h = mix(names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = mix(h) | np.uint64(1)
    at = h[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)
    return at & np.uint64(bits - 1)


class Bloom:
    """A set of 32-bit names that may hold more than was added, never less."""

    def __init__(self, data: np.ndarray):
        self.data = data

    @classmethod
    def empty(cls, bits: int = _SEGMENT_BITS) -> Bloom:
        return cls(np.zeros(bits // 8, np.uint8))

    def knows(self, names: np.ndarray) -> np.ndarray:
        at = _probes(names, len(self.data) * 8)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)

    def add(self, names: np.ndarray) -> None:
        at = _probes(names, len(self.data) * 8).ravel()
        np.bitwise_or.at(
            self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        )

    def folded(self) -> Bloom:
        """Halved for as long as at most a quarter of the bits is set."""
        data = self.data
        while len(data) * 8 > _MIN_BITS:
            half = data[: len(data) // 2] | data[len(data) // 2 :]
            if 4 * int(np.bitwise_count(half).sum()) > len(half) * 8:
                break
            data = half
        return Bloom(data)


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The upper half of a hash names its segment, the lower half the line in it."""
    return ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def _name(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.uint32)


def _document_hashes(lines: Lines) -> np.ndarray:
    """Hashes of the long lines, one per document and line."""
    if not len(lines.hash):
        return lines.hash
    row = lines.row[lines.long]
    order = np.lexsort((lines.hash, row))
    h, r = lines.hash[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))
    return h[new]


#: hashes that a task holds before it sends them on
_HELD = 1 << 20


def line_hashes(docs: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """(segment, once, twice): names of the lines that a run of documents holds in one or
    in several documents, as packed 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            unique, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            at = _segment(unique, segments).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
            rows = [
                (int(at[a]), _name(unique[a:b][n[a:b] == 1]), _name(unique[a:b][n[a:b] > 1]))
                for a, b in zip(cuts[:-1], cuts[1:])
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                ],
                ["segment", "once", "twice"],
            )

        held: list[np.ndarray] = []
        for part in slices(batches):
            hashes = _document_hashes(split_lines(part.column("text"), min_chars))
            if len(hashes):
                held.append(hashes)
            if sum(map(len, held)) >= _HELD:
                yield send()
        if held:
            yield send()

    return docs.select("text").mapInArrow(run, "segment bigint, once binary, twice binary")


def repeat_filters(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """(filters, segments): staged rows (segment, bits) of lines seen in two documents."""
    # a line of so many code points and its break take at least as many bytes
    fits = F.floor((F.octet_length("text") + 1) / (min_chars + 1))
    n_lines = docs.agg(F.coalesce(F.sum(fits), F.lit(0)).cast("bigint")).first()[0]
    segments = max(1, -(-n_lines // SEGMENT_LINES))

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, any_twice = Bloom.empty(), Bloom.empty(), False
        for batch in batches:
            for single, repeated in zip(batch.column("once"), batch.column("twice")):
                names = np.frombuffer(single.as_py(), np.uint32)
                seen = names[once.knows(names)]
                again = np.concatenate([seen, np.frombuffer(repeated.as_py(), np.uint32)])
                once.add(names)
                once.add(again)
                if len(again):
                    twice.add(again)
                    any_twice = True
        if any_twice:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()], pa.int64()),
                 pa.array([twice.folded().data.tobytes()], pa.binary())],
                ["segment", "bits"],
            )

    filters = (
        line_hashes(docs, segments, min_chars)
        .groupBy("segment")
        .applyInArrow(build, "segment bigint, bits binary")
    )
    return stage(filters, "line_filters"), segments


def _suspected(filters: dict[int, np.ndarray] | None, segments: int, hashes: np.ndarray) -> np.ndarray:
    """Whether the filters know each hash; without filters everything is suspected."""
    if filters is None:
        return np.ones(len(hashes), bool)
    known, segment = np.zeros(len(hashes), bool), _segment(hashes, segments)
    for s in np.unique(segment):
        if int(s) in filters:
            mine = segment == s
            known[mine] = Bloom(filters[int(s)]).knows(_name(hashes[mine]))
    return known


# ---------------------------------------------------------------------- repeated lines


def repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(digest, hash, keeper): staged, one row per line key in at least ``min_docs`` rows of
    ``docs``, with the largest doc_id that holds it (null if none has an id)."""
    filters, segments = repeat_filters(docs, min_chars)
    size = filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    held = None
    if size <= broadcast_bytes:  # proven by the sum; beyond it all long lines are counted
        held = docs.sparkSession.sparkContext.broadcast(
            {r["segment"]: bytes(r["bits"]) for r in filters.collect()}
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        if held is not None:
            bits = {s: np.frombuffer(b, np.uint8) for s, b in held.value.items()}
        for part in slices(batches):
            lines = split_lines(part.column("text"), min_chars)
            rows = lines.row[lines.long]
            found: set[tuple[int, bytes]] = set()
            hashes: dict[bytes, int] = {}
            for i in np.flatnonzero(_suspected(bits, segments, lines.hash)):
                digest = lines.digest(i)
                found.add((int(rows[i]), digest))
                hashes[digest] = int(lines.hash[i].astype(np.int64))
            if not found:
                continue
            at, digests = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(digests, pa.binary()),
                    pa.array([hashes[d] for d in digests], pa.int64()),
                ],
                ["doc_id", "digest", "hash"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    suspects = rows.mapInArrow(run, f"doc_id {kind}, digest binary, hash bigint")
    # one row per document and line, so a line of very many documents adds up before the shuffle
    counted = suspects.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"), F.min("hash").alias("hash")
    )
    return stage(
        counted.where(F.col("n") >= min_docs).select("digest", "hash", "keeper"), "repeated_lines"
    )


@dataclass(frozen=True)
class _Repeats:
    """Repeated lines of a bounded number, sorted by hash."""

    hash: np.ndarray
    digest: np.ndarray  # 16 bytes each
    keeper: pa.Array

    @classmethod
    def of(cls, table: pa.Table) -> _Repeats:
        table = table.sort_by("hash").combine_chunks()
        digests = b"".join(table.column("digest").to_pylist())
        return cls(
            table.column("hash").to_numpy(),
            np.frombuffer(digests, np.uint8).reshape(-1, 16),
            table.column("keeper").combine_chunks(),
        )

    def place(self, hash_: int, digest: bytes) -> int:
        """Place of a line, -1 if it is none of the repeated ones."""
        i = int(np.searchsorted(self.hash, hash_))
        while i < len(self.hash) and self.hash[i] == hash_:
            if self.digest[i].tobytes() == digest:
                return i
            i += 1
        return -1


def _cut(lines: Lines, dropped: np.ndarray, n_rows: int) -> tuple[np.ndarray, dict[int, bytes]]:
    """(dropped lines per row, new text of the rows that lose any)."""
    counts = np.bincount(lines.row[dropped], minlength=n_rows)
    gone = np.zeros(len(lines.row), bool)
    gone[dropped] = True
    bounds = np.searchsorted(lines.row, np.arange(n_rows + 1))
    texts = {}
    for row in np.flatnonzero(counts):
        kept = [
            lines.data[lines.start[i] : lines.end[i]].tobytes()
            for i in range(bounds[row], bounds[row + 1])
            if not gone[i]
        ]
        texts[int(row)] = b"\n".join(kept)
    return counts, texts


def _clean(
    docs: DataFrame, min_chars: int, min_docs: int, broadcast_bytes: int
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) as ``doc`` with the text cut, beside
    n_lines and n_dropped."""
    repeats = repeated_lines(docs, min_chars, min_docs, broadcast_bytes)
    n_repeats = repeats.count()
    packed = docs.select(F.struct("*").alias("doc"))
    named = packed.select("doc", "doc.doc_id", "doc.text")
    # a digest, a hash and an id; ids are counted by their printed length
    id_bytes = F.coalesce(F.octet_length(F.col("keeper").cast("string")), F.lit(0)) + 8
    size = repeats.agg(F.coalesce(F.sum(id_bytes + 24), F.lit(0))).first()[0]
    held = None
    if size <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast(repeats.toArrow())
        with_lists = named.select("*", F.lit(None).cast("array<binary>").alias("drop"))
    else:
        with_lists = _drop_lists(named, docs, repeats, min_chars)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Repeats.of(held.value) if held is not None and n_repeats else None
        for part in slices(batches):
            lines = split_lines(part.column("text"), min_chars)
            rows = lines.row[lines.long]
            ids = part.column("doc_id")
            dropped = []
            if held is None:
                lists = [set(x or ()) for x in part.column("drop").to_pylist()]
                dropped = [
                    lines.long[i] for i, row in enumerate(rows)
                    if lists[row] and lines.digest(i) in lists[row]
                ]
            elif known is not None:
                signed = lines.hash.astype(np.int64)
                at = np.minimum(np.searchsorted(known.hash, signed), len(known.hash) - 1)
                for i in np.flatnonzero(known.hash[at] == signed):
                    place = known.place(signed[i], lines.digest(i))
                    if place >= 0 and known.keeper[place].as_py() != ids[int(rows[i])].as_py():
                        dropped.append(lines.long[i])
            counts, texts = _cut(lines, np.array(dropped, np.int64), part.num_rows)
            doc = part.column("doc")
            fields = doc.flatten()
            names = [f.name for f in doc.type]
            where = names.index("text")
            if texts:
                old = fields[where].to_pylist()
                for row, text in texts.items():
                    old[row] = text.decode()
                fields[where] = pa.array(old, fields[where].type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.StructArray.from_arrays(fields, fields=list(doc.type)),
                    pa.array(np.bincount(lines.row, minlength=part.num_rows), pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                ["doc", "n_lines", "n_dropped"],
            )

    schema = T.StructType(
        [packed.schema["doc"], *(T.StructField(x, T.LongType()) for x in ("n_lines", "n_dropped"))]
    )
    return with_lists.mapInArrow(run, schema)


def _drop_lists(
    named: DataFrame, docs: DataFrame, repeats: DataFrame, min_chars: int
) -> DataFrame:
    """``named`` with the digests that each document loses, where the repeated lines are too
    many to be sent to all tasks. A line's documents are dealt over shares, so that one in
    very many of them is not one task's work."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines = split_lines(part.column("text"), min_chars)
            rows = lines.row[lines.long]
            found = sorted({(int(r), lines.digest(i)) for i, r in enumerate(rows)})
            if found:
                at, digests = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at, pa.int64())),
                     pa.array(digests, pa.binary())],
                    ["doc_id", "digest"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).alias("salt")
    each = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<bigint>")).alias("salt")
    held = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest binary")
    lists = (
        held.select("*", salt)
        .join(repeats.select("digest", "keeper", each), ["digest", "salt"])
        .where(~F.col("keeper").eqNullSafe(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.collect_set("digest").alias("drop"))
        .withColumnRenamed("doc_id", "loser")
    )
    return named.join(lists, F.col("doc_id").eqNullSafe(F.col("loser")), "left").drop("loser")


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with the same columns, their texts without repeated lines.

    A line's key is the line without leading and trailing 0x20, 0x09-0x0D, A-Z lower-cased.
    Keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold lose all
    their lines, except in the rows of the largest doc_id that holds them. The other lines
    stay, joined by line breaks.

    Equal rows are separate documents. Rows without doc_id count as documents and lose the
    line, unless no holder has an id: then all of them keep it. Null, empty and blank texts
    stay as they are, as does every text that loses nothing; extra columns are carried
    whatever their names; an empty table gives no rows. A text is handled about 2 MB at a
    time, a line as a whole.
    """
    return _clean(docs, min_chars, min_docs, broadcast_bytes).select("doc.*")


def line_report(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): lines before dropping, lines dropped, and the text
    that ``drop_repeated_lines`` leaves, the empty one for null."""
    cleaned = _clean(docs.select("doc_id", "text"), min_chars, min_docs, broadcast_bytes)
    return cleaned.select(
        "doc.doc_id", "n_lines", "n_dropped", F.coalesce("doc.text", F.lit("")).alias("text")
    )
