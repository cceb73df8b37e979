"""Hard negatives for contrastive training, with bounds along a spanning tree of anchors.

Vectors are whole numbers (a component is floor(256 x)), so scores are exact inner
products. Anchors come in blocks, each with a minimum spanning tree of its own. If a
candidate's score lies in [lo, hi] at an anchor, it lies in [lo - e |x|, hi + e |x|] at a
neighbour in the tree, where e is the length of the edge and |x| the candidate's norm. A
block therefore scores its root against all candidates and goes down the tree: a child
scores only those candidates whose interval meets the window of scores it looks for.

Two passes over a grid of tiles (a share of the candidates, some blocks of anchors):

1. positives: the window is whatever can still enter an anchor's first ``n_positives``
   among the rows of its label;
2. negatives: the windows follow from the scores of the anchor's positives.

A tile is bounded in both directions, whatever the size of the table and however uneven
its labels. It returns what is best inside it; the best of all tiles are the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SCALE, CLASSES, RELABEL_EVERY, ANCHOR_EVERY = 256, 10, 7, 100
#: rows of a tile on either side, anchors of a block, candidates looked at together
TILE_CANDIDATES, TILE_BLOCKS, BLOCK_ANCHORS, CHUNK = 8192, 32, 512, 1024
#: scaled components beyond this count as not finite: their scores could leave 64 bits
_LIMIT = float(1 << 24)
#: rounding of bounds stays below one half while scores are below this
_FLOAT_EXACT = float(1 << 50)


def integer_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: v holds floor(256 x) as integers.

    Rows with a null id, label or vector, or with a component that is null, not finite or
    of 65,536 or more in size, take no part. Where the id is divisible by 7, the label
    becomes (label + 1) % 10.
    """
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    usable = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < _LIMIT / SCALE),
    )
    shifted = F.when(
        F.col(vec_id) % RELABEL_EVERY == 0, (F.col(label) + 1) % CLASSES
    ).otherwise(F.col(label))
    present = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    return rows.where(present & usable).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), shifted.cast("bigint").alias("label"),
        scaled.cast("array<int>").alias("v"),
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers as a matrix; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _width(column: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(column)).as_py() or 0


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, edge length, depth) of a minimum spanning tree rooted at row 0 (Prim)."""
    n = len(vectors)
    parent, edge, depth = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32)
    x = vectors.astype(np.float64)
    norms = np.einsum("ij,ij->i", x, x)
    left = np.full(n, np.inf)
    nearest = np.zeros(n, np.int32)
    outside = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        outside[at] = False
        squares = norms + norms[at] - 2.0 * (x @ x[at])
        closer = outside & (squares < left)
        left[closer], nearest[closer] = squares[closer], at
        at = int(np.argmin(np.where(outside, left, np.inf)))
        parent[at] = nearest[at]
        difference = x[at] - x[nearest[at]]
        edge[at] = np.sqrt(difference @ difference)
        depth[at] = depth[nearest[at]] + 1
    return parent, edge, depth


def anchor_blocks(vectors: DataFrame) -> DataFrame:
    """(block, anchor_id, label, v, parent, edge, depth): one row per block of anchors,
    each column an array over its anchors. Staged."""
    anchors = vectors.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ANCHORS), F.lit(1))
    blocks = anchors.agg(n_blocks).first()[0]
    dealt = anchors.withColumn(
        # equal rows are dealt by a random number, which changes the tree and not the result
        "block", F.pmod(F.xxhash64("vec_id", "label", "v", F.floor(F.rand(17) * 64)), F.lit(blocks))
    )

    def plant(key: tuple, rows: pa.Table) -> pa.Table:
        # the row of the middle vector is a shallower root than any other row
        v = _matrix(rows.column("v"), _width(rows.column("v")))
        middle = v.mean(axis=0) if len(v) else v
        order = np.argsort(((v - middle) ** 2).sum(axis=1), kind="stable")
        rows, v = rows.take(pa.array(order)), v[order]
        parent, edge, depth = spanning_tree(v)

        def whole(values) -> pa.Array:
            return pa.array([values])

        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int64()),
                "anchor_id": whole(rows.column("vec_id").to_pylist()),
                "label": whole(rows.column("label").to_pylist()),
                "v": pa.array([v.tolist()], pa.list_(pa.list_(pa.int32()))),
                "parent": pa.array([parent.tolist()], pa.list_(pa.int32())),
                "edge": pa.array([edge.tolist()], pa.list_(pa.float64())),
                "depth": pa.array([depth.tolist()], pa.list_(pa.int32())),
            }
        )

    schema = (
        "block bigint, anchor_id array<bigint>, label array<bigint>, v array<array<int>>, "
        "parent array<int>, edge array<double>, depth array<int>"
    )
    return stage(dealt.groupBy("block").applyInArrow(plant, schema), "anchor_blocks")


@dataclass
class _Block:
    """A block of anchors inside a tile."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, row: dict, width: int) -> _Block:
        v = np.zeros((len(row["anchor_id"]), width), np.int32)
        for i, values in enumerate(row["v"]):
            v[i, : len(values)] = values
        depth = np.array(row["depth"], np.int64)
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        return cls(
            row["block"], np.array(row["anchor_id"], np.int64), np.array(row["label"], np.int64),
            v, np.array(row["parent"], np.int64), np.array(row["edge"]), levels,
        )


@dataclass
class _Candidates:
    """The candidates of a tile in ascending vec_id, so that of equal scores the first
    stands first."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, width: int) -> _Candidates:
        table = table.sort_by("vec_id")
        v = _matrix(table.column("v"), width)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
        return cls(
            table.column("vec_id").to_numpy(), table.column("label").to_numpy(), v, norm
        )


class _Window:
    """Which scores each anchor of a block still looks for, and what it has found."""

    def __init__(self, block: _Block, keep: int):
        self.block, self.keep = block, keep
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)  # slot, score, candidate

    def low(self, anchors: np.ndarray) -> np.ndarray: ...

    def high(self, anchors: np.ndarray) -> np.ndarray: ...

    def fits(self, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray: ...

    def take(self, anchor: np.ndarray, score: np.ndarray, candidate: np.ndarray) -> None: ...

    def _merge(self, slot: np.ndarray, score: np.ndarray, candidate: np.ndarray) -> None:
        """Keep the first ``keep`` of every slot: higher scores, then earlier candidates."""
        slot, score, candidate = (
            np.concatenate(x) for x in zip(self.found, (slot, score, candidate))
        )
        order = np.lexsort((candidate, -score, slot))
        slot, score, candidate = slot[order], score[order], candidate[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = rank < self.keep
        self.found = (slot[first], score[first], candidate[first])


class _Positives(_Window):
    """The first rows of the anchor's own label. The window's lower end is the score that
    an anchor's last place holds so far; later candidates must beat it."""

    def __init__(self, block: _Block, keep: int):
        super().__init__(block, keep)
        self._low = np.full(len(block.ids), -np.inf)

    def low(self, anchors):
        return self._low[anchors]

    def high(self, anchors):
        return np.full(len(anchors), np.inf)

    def fits(self, anchors, labels, ids):
        b = self.block
        return (b.labels[anchors, None] == labels) & (b.ids[anchors, None] != ids)

    def take(self, anchor, score, candidate):
        self._merge(anchor, score, candidate)
        slot, scores, _ = self.found
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True)) if len(slot) else slot
        full = last[np.bincount(slot, minlength=len(self._low))[slot[last]] == self.keep]
        self._low[slot[full]] = scores[full] + 1


class _Negatives(_Window):
    """The first rows of other labels in the window of each positive."""

    def __init__(self, block: _Block, keep: int, anchor: np.ndarray, score: np.ndarray):
        super().__init__(block, keep)
        order = np.argsort(anchor, kind="stable")
        self._anchor, top = anchor[order], score[order]
        # 80 p <= 100 s <= 100 p in whole numbers
        self._from, self._to = -((-4 * top) // 5), top
        self._slots = np.searchsorted(self._anchor, np.arange(len(block.ids) + 1))
        n = len(block.ids)
        self._low, self._high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(self._low, self._anchor, self._from.astype(float))
        np.maximum.at(self._high, self._anchor, self._to.astype(float))

    def low(self, anchors):
        return self._low[anchors]

    def high(self, anchors):
        return self._high[anchors]

    def fits(self, anchors, labels, ids):
        return self.block.labels[anchors, None] != labels

    def take(self, anchor, score, candidate):
        each = self._slots[anchor + 1] - self._slots[anchor]
        row = np.repeat(np.arange(len(anchor)), each)
        slot = np.repeat(self._slots[anchor], each) + (
            np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        )
        s = score[row]
        inside = (self._from[slot] <= s) & (s <= self._to[slot])
        self._merge(slot[inside], s[inside], candidate[row[inside]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, score, candidate), each pair once however many windows it is in."""
        slot, score, candidate = self.found
        whole = np.stack([self._anchor[slot], candidate, score], axis=1)
        anchor, candidate, score = np.unique(whole, axis=0).T if len(whole) else whole.T
        return anchor, score, candidate


def _search(window: _Window, candidates: _Candidates) -> None:
    """Give ``window`` every score it may look for, going down the tree of its block."""
    block = window.block
    reach = float(np.sqrt(np.einsum("ij,ij->i", block.v, block.v, dtype=np.float64)).max(initial=0))
    reach *= float(candidates.norm.max(initial=0))
    # partial sums stay below the product of the norms, so these types are exact
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < _FLOAT_EXACT else np.int64
    anchors = block.v.astype(kind)
    prune = kind is not np.int64
    for at in range(0, len(candidates.ids), CHUNK):
        part = slice(at, at + CHUNK)
        x, norm = candidates.v[part].astype(kind), candidates.norm[part]
        ids, labels = candidates.ids[part], candidates.labels[part]
        places = lo = hi = None  # of the level above
        for level, members in enumerate(block.levels):
            if level == 0 or not prune:
                look = np.ones((len(members), len(ids)), bool)
                new_lo = new_hi = np.zeros(look.shape)
            else:
                above = np.searchsorted(places, block.parent[members])
                slack = block.edge[members, None] * norm + 0.5
                new_lo, new_hi = lo[above] - slack, hi[above] + slack
                low, high = window.low(members)[:, None], window.high(members)[:, None]
                look = (new_hi >= low) & (new_lo <= high)
            rows, columns = np.nonzero(look)
            if 8 * len(rows) > look.size:
                exact = anchors[members] @ x.T
                scores = exact[rows, columns]
            else:
                scores = _paired(anchors[members], x, rows, columns)
            if prune:
                new_lo, new_hi = new_lo.copy(), new_hi.copy()
                new_lo[rows, columns] = new_hi[rows, columns] = scores
                places, lo, hi = members, new_lo, new_hi
            low, high = window.low(members), window.high(members)
            good = window.fits(members, labels, ids)[rows, columns]
            good &= (scores >= low[rows]) & (scores <= high[rows])
            rows, columns, scores = rows[good], columns[good], scores[good]
            if len(rows):
                window.take(members[rows], scores.astype(np.int64), columns + at)


def _paired(a: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), a.dtype)
    for at in range(0, len(rows), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", a[rows[part]], x[columns[part]])
    return out


def _tiles(vectors: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Candidates and blocks of anchors, dealt to the tiles where they meet."""
    n_rows, n_blocks = vectors.count(), blocks.count()
    shares = max(1, -(-n_rows // TILE_CANDIDATES))
    bands = max(1, -(-n_blocks // TILE_BLOCKS))
    candidates = vectors.select(
        "vec_id", "label", "v",
        # equal rows are dealt by a random number, so no share holds very many of them
        F.pmod(F.xxhash64("vec_id", "v", F.floor(F.rand(11) * 4096)), F.lit(shares)).alias("share"),
        F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"),
    )
    anchors = blocks.select(
        "*", (F.col("block") % bands).cast("int").alias("band"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")).alias("share"),
    )
    return candidates, anchors, ["share", "band"]


_PAIRS = "block bigint, place int, anchor_id bigint, other_id bigint, score bigint"
_PAIR_NAMES = ["block", "place", "anchor_id", "other_id", "score"]


def _tile(
    candidates: pa.Table, anchors: pa.Table,
    search: Callable[[dict, _Block, _Candidates], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> pa.Table:
    """All (anchor, score, candidate) that ``search`` finds in a tile, block by block."""
    rows = anchors.to_pylist()
    width = _width(candidates.column("v"))
    width = max([width, *(len(v) for r in rows for v in r["v"])])
    mine = _Candidates.of(candidates, width)
    tables = []
    for row in rows if len(mine.ids) else []:
        block = _Block.of(row, width)
        anchor, score, candidate = search(row, block, mine)
        tables.append(
            pa.table(
                [
                    pa.array(np.full(len(anchor), block.number, np.int64)),
                    pa.array(anchor.astype(np.int32)), pa.array(block.ids[anchor]),
                    pa.array(mine.ids[candidate]), pa.array(score),
                ],
                names=_PAIR_NAMES,
            )
        )
    empty = pa.schema(
        [("block", pa.int64()), ("place", pa.int32()), ("anchor_id", pa.int64()),
         ("other_id", pa.int64()), ("score", pa.int64())]
    )
    return pa.concat_tables(tables) if tables else empty.empty_table()


def _ranked(pairs: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The first ``keep`` of every group, which Spark also cuts before the shuffle."""
    window = Window.partitionBy(*by).orderBy(F.col("score").desc(), "other_id")
    return pairs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, n_positives: int = 5, n_negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` is a table of ``integer_vectors``. Anchors are the rows whose id is
    divisible by 100. The positives of an anchor are its first ``n_positives`` rows of the
    same label, the negatives of a pair the first ``n_negatives`` rows of other labels that
    score between 80 % and 100 % of the positive; higher scores come first, equal ones by
    id. Rows with the anchor's own id are never its positives. Rows that repeat are rows of
    their own, as candidates and as anchors. An anchor without positives or without
    negatives in a window has no rows there; empty tables give none. Vectors of several
    lengths count as filled up with zeros.
    """
    vectors = stage(vectors, "integer_vectors")
    blocks = anchor_blocks(vectors)
    candidates, anchors, tile = _tiles(vectors, blocks)

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        def search(row: dict, block: _Block, mine: _Candidates):
            window = _Positives(block, n_positives)
            _search(window, mine)
            slot, score, candidate = window.found
            return slot, score, candidate

        return _tile(left, right, search)

    found = candidates.groupBy(*tile).cogroup(anchors.groupBy(*tile)).applyInArrow(
        positives_of, _PAIRS
    )
    positives = stage(_ranked(found, ["block", "place"], n_positives), "positives")

    # a block's windows: five an anchor at most
    windows = positives.groupBy("block").agg(
        F.collect_list(F.struct("place", "score")).alias("windows")
    )
    candidates, anchors, tile = _tiles(vectors, blocks.join(windows, "block"))

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        def search(row: dict, block: _Block, mine: _Candidates):
            at = np.array([w["place"] for w in row["windows"]], np.int64)
            score = np.array([w["score"] for w in row["windows"]], np.int64)
            window = _Negatives(block, n_negatives, at, score)
            _search(window, mine)
            return window.pairs()

        return _tile(left, right, search)

    negatives = candidates.groupBy(*tile).cogroup(anchors.groupBy(*tile)).applyInArrow(
        negatives_of, _PAIRS
    )
    p = positives.select(
        "block", "place", F.col("rank").alias("window"), F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    pairs = negatives.join(p, ["block", "place"]).where(
        (80 * F.col("positive_score") <= 100 * F.col("score"))
        & (F.col("score") <= F.col("positive_score"))
    )
    return _ranked(pairs, ["block", "place", "window"], n_negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
