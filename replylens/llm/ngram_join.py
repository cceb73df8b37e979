"""N-gram Jaccard join of documents with signature trees.

Documents with equal shingle sets are one class. Classes are routed to blocks by
minimum hashes of their sets: ``bands`` keys of ``rows`` minima each, chosen so that two
sets at the threshold share no key with a chance of at most ``MISS`` (less above it).
Classes that keys connect form a block; large blocks are cut into units. In a unit the
sets are the leaves of a signature tree: every node holds the OR of the token bitmaps
below it and the range of their sizes. A dual traversal of the tree with itself drops a
pair of nodes when no two sets below them can overlap enough, and what is left is
verified on the sets themselves. Pairs that are already connected are skipped, so a
group of near copies costs about as many verifications as it has members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .arrays import mix, slices, word_hashes
from .components import components

MISS = 1e-9
#: pairs verified before connected ones are sorted out again
RECHECK = 256
#: ids that a task may hold to pick the texts it needs; beyond it texts are joined
BROADCAST_IDS = 1 << 20
UNIT = 256
LEAF, FANOUT = 8, 4
#: bitmap words of the pairs looked at together
PAIR_WORDS = 1 << 17
_LOWEST = -(1 << 63)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def routing(percent: int) -> tuple[int, int]:
    """(bands, minima per band) for a threshold."""
    rows = 6 if percent >= 90 else 5 if percent >= 80 else 4 if percent >= 65 else 3
    return ceil(log(MISS) / log(1 - (percent / 100) ** rows)), rows


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of ``k`` words of each text, sorted. A text
    with fewer words has its whole sequence as one shingle, one without words none."""
    hashes, bounds = word_hashes(column)
    counts = np.diff(bounds)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        rolled = mix(rolled * _STEPS[0] + hashes[i : i + len(rolled)] + _STEPS[1])
    sets = []
    for at, n in zip(bounds[:-1].tolist(), counts.tolist()):
        if n >= k:
            sets.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            value = np.array([n], np.uint64)
            for h in hashes[at : at + n]:
                value = mix(value * _STEPS[0] + h + _STEPS[2])
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return joined, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def set_digests(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify a set; zeros for an empty one."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    if len(some):
        for i in range(2):
            out[i, some] = np.add.reduceat(mix(tokens ^ _STEPS[i]), bounds[some])
    return out[0].view(np.int64), out[1].view(np.int64)


def routing_keys(
    tokens: np.ndarray, bounds: np.ndarray, bands: int, rows: int
) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have tokens, their keys of shape (., bands))."""
    some = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(some), bands), np.uint64)
    if not len(some):
        return some, keys
    draw = np.random.Generator(np.random.PCG64(5))
    low = (tokens >> np.uint64(32)).astype(np.uint32)
    first = bounds[some]
    for band in range(bands):
        key = np.full(len(some), band + 1, np.uint64)
        for _ in range(rows):
            a, b = draw.integers(0, 1 << 32, 2, dtype=np.uint32)
            values = low * (a | np.uint32(1))
            values ^= b
            key = mix(key * _STEPS[0] + np.minimum.reduceat(values, first))
        keys[:, band] = key
    return some, keys


class SignatureTree:
    """Sets in order of size under nodes with OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bitmaps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in enumerate(sets):
            at = s & np.uint64(bits - 1)
            np.bitwise_or.at(
                bitmaps[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            )
        self.spare = self.sizes - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        self.bitmaps = bitmaps
        #: levels from the root's children down to the leaves' parents; each level has
        #: bitmaps, smallest, largest size, most spare tokens and the span of rows or nodes
        self.levels: list[tuple[np.ndarray, ...]] = []
        level = (bitmaps, self.sizes, self.sizes, self.spare)
        width = LEAF
        while len(level[0]) > 1 or not self.levels:
            at = np.arange(0, len(level[0]), width)
            level = (
                np.bitwise_or.reduceat(level[0], at),
                np.minimum.reduceat(level[1], at),
                np.maximum.reduceat(level[2], at),
                np.maximum.reduceat(level[3], at),
            )
            ends = np.append(at[1:], len(self.levels[-1][0]) if self.levels else len(sets))
            self.levels.append((*level, at, ends))
            width = FANOUT


def bitmap_bits(largest: int) -> int:
    """Sixteen bits per token of the largest set, a power of two from 256 to 131,072."""
    return 1 << min(17, max(8, int(largest * 16 - 1).bit_length()))


def _needed(a, b, percent: int):
    """Least overlap of two sets of these sizes at the threshold."""
    return percent * (a + b) / (100 + percent) - 1e-9


def candidate_pairs(
    left: SignatureTree, right: SignatureTree, percent: int, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs (i, j, bound on the overlap) that may reach the threshold, by dual
    traversal. ``same``: both are one tree, and pairs come once (i < j)."""
    depth_l, depth_r = len(left.levels) - 1, len(right.levels) - 1
    step = max(1, PAIR_WORDS // left.bitmaps.shape[1])
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64), depth_l, depth_r)]
    while stack:
        i, j, dl, dr = stack.pop()
        bits_l, low_l, high_l, spare_l, at_l, end_l = left.levels[dl]
        bits_r, low_r, high_r, spare_r, at_r, end_r = right.levels[dr]
        fits = (100 * high_l[i] >= percent * low_r[j]) & (100 * high_r[j] >= percent * low_l[i])
        i, j = i[fits], j[fits]
        most = np.bitwise_count(bits_l[i] & bits_r[j]).sum(1) + np.minimum(spare_l[i], spare_r[j])
        keep = most >= _needed(low_l[i], low_r[j], percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        down_l, down_r = dl >= dr, dr >= dl
        a, b = _children(i, j, at_l, end_l, at_r, end_r, down_l, down_r)
        if same and dl == dr:
            once = a <= b
            a, b = a[once], b[once]
        dl, dr = dl - down_l, dr - down_r
        if dl < 0 and dr < 0:
            for at in range(0, len(a), step):
                span = slice(at, at + step)
                yield from _leaf_pairs(left, right, a[span], b[span], percent, same)
        else:
            for at in range(0, len(a), step):
                stack.append((a[at : at + step], b[at : at + step], dl, dr))


def _children(i, j, at_l, end_l, at_r, end_r, down_l: bool, down_r: bool):
    n_l = end_l[i] - at_l[i] if down_l else np.ones(len(i), np.int64)
    n_r = end_r[j] - at_r[j] if down_r else np.ones(len(j), np.int64)
    total = n_l * n_r
    pair = np.repeat(np.arange(len(i)), total)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
    a = (at_l[i][pair] if down_l else i[pair]) + (nth // n_r[pair] if down_l else 0)
    b = (at_r[j][pair] if down_r else j[pair]) + (nth % n_r[pair] if down_r else 0)
    return a, b


def _leaf_pairs(left, right, a, b, percent, same):
    if same:
        once = a < b
        a, b = a[once], b[once]
    size_a, size_b = left.sizes[a], right.sizes[b]
    fits = (100 * size_a >= percent * size_b) & (100 * size_b >= percent * size_a)
    a, b, size_a, size_b = a[fits], b[fits], size_a[fits], size_b[fits]
    if not len(a):
        return
    bits_a, bits_b = left.bitmaps[a], right.bitmaps[b]
    most = np.minimum(
        size_a - np.bitwise_count(bits_a & ~bits_b).sum(1).astype(np.int64),
        size_b - np.bitwise_count(bits_b & ~bits_a).sum(1).astype(np.int64),
    )
    keep = most >= _needed(size_a, size_b, percent)
    if keep.any():
        yield a[keep], b[keep], most[keep]


class _Links:
    """Union-find over the nodes of a unit; collects the links that joined two parts."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def verify(self, left, right, tree_l, tree_r, percent: int, same: bool) -> None:
        """left, right: (nodes, parts they are known to be in, sets), in tree order."""
        for a, b, most in candidate_pairs(tree_l, tree_r, percent, same):
            order = np.argsort(-most, kind="stable")
            a, b = a[order], b[order]
            while len(a):
                # most pairs of a group of near copies are connected by now
                roots_l = np.array([self.root(p) for p in left[1]])
                roots_r = np.array([self.root(p) for p in right[1]])
                apart = roots_l[a] != roots_r[b]
                a, b = a[apart], b[apart]
                for i, j in zip(a[:RECHECK].tolist(), b[:RECHECK].tolist()):
                    one, two = self.root(left[1][i]), self.root(right[1][j])
                    if one == two:
                        continue
                    s, t = left[2][i], right[2][j]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        self.parent[max(one, two)] = min(one, two)
                        self.found.append((left[0][i], right[0][j]))
                a, b = a[RECHECK:], b[RECHECK:]


def join_unit(residents, guests: Iterable, percent: int, inside: bool) -> list[tuple[int, int]]:
    """Links among residents (when ``inside``) and between guests and residents; of links
    that close a circle some are left out. Both hold (node, part, set) rows."""
    links = _Links()
    rows = sorted(residents, key=lambda r: len(r[2]))
    if not rows:
        return []
    left = tuple(zip(*rows))
    bits = bitmap_bits(len(rows[-1][2]))
    tree = SignatureTree(left[2], bits)
    if inside:
        links.verify(left, left, tree, tree, percent, True)
    for chunk in guests:
        chunk = sorted(chunk, key=lambda r: len(r[2]))
        right = tuple(zip(*chunk))
        links.verify(left, right, tree, SignatureTree(right[2], bits), percent, False)
    return links.found


# --- on Spark --------------------------------------------------------------------------


def _profile(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Staged: (pos, doc_id, mark, n, d1, d2, keys) per row of (doc_id, text, mark); keys is
    null for empty sets."""
    bands, rows = routing(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            tokens, bounds = shingle_sets(part.column("text"), k)
            d1, d2 = set_digests(tokens, bounds)
            some, keys = routing_keys(tokens, bounds, bands, rows)
            ends = np.zeros(part.num_rows + 1, np.int32)
            ends[some + 1] = bands
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum(ends).astype(np.int32)), pa.array(keys.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("mark"),
                    pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2), lists,
                ],
                ["doc_id", "mark", "n", "d1", "d2", "keys"],
            )

    rows_ = docs.mapInArrow(
        run,
        "doc_id bigint, mark bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>",
    )
    return stage(rows_.withColumn("pos", F.monotonically_increasing_id()), "profiles")


def _members(classes: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(node, block, band, salt, salts): where each class of a block has its unit."""
    band = F.floor(F.log(F.col("n").cast("double")) / -log(percent / 100)).cast("int")
    # the smallest class of a block has no label of its own
    first = blocks.select(F.col("label").alias("block"), F.col("label").alias("node")).distinct()
    placed = blocks.select(F.col("label").alias("block"), "node").union(first)
    placed = placed.join(classes.select("node", "n", "d1", "d2", "rep_mark"), "node")
    placed = stage(placed.withColumn("band", band), "placed")
    total = stage(placed.groupBy("block").agg(F.count(F.lit(1)).alias("total")), "block_sizes")
    large = total.where(F.col("total") > UNIT)
    salts = stage(
        placed.join(large, "block")
        .groupBy("block", "band")
        .agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("salts")),
        "salts",
    )
    return stage(
        placed.join(salts, ["block", "band"], "left").select(
            "node", "block", "n", "d1", "d2", "rep_mark",
            F.when(F.col("salts").isNull(), -1).otherwise(F.col("band")).alias("band"),
            F.coalesce("salts", F.lit(0)).alias("salts"),
            F.when(F.col("salts").isNull(), 0)
            .otherwise(F.pmod(F.xxhash64("node"), F.col("salts"))).cast("int").alias("salt"),
        ),
        "members",
    )


def _run_units(
    docs: DataFrame, rows: DataFrame, k: int, percent: int, inside: bool
) -> DataFrame:
    """Staged links (u, v) found in units. ``rows``: node, part, d1, d2, rep_mark, block,
    band, salt, guest; a row says that a class takes part in a unit."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # units of one block lie on neighbouring tasks, so a large block spreads evenly
    task = F.pmod(F.xxhash64("block", "band") + F.col("salt"), F.lit(tasks)).cast("int")
    texts = docs.select(F.col("mark").alias("rep_mark"), "text")
    ids = stage(rows.select("rep_mark").distinct(), "unit_ids")
    if ids.count() <= BROADCAST_IDS:
        # texts that no unit needs stay where they are
        texts = texts.join(F.broadcast(ids), "rep_mark", "left_semi")
    # one text per mark: rows of one id, or without ids, do not meet each other's classes,
    # and equal rows meet their class once
    texts = texts.groupBy("rep_mark").agg(F.first("text").alias("text"))
    joined = (
        rows.join(texts, "rep_mark")
        .select("node", "part", "d1", "d2", "block", "band", "salt", "guest", "text", task.alias("task"))
        .repartitionById(tasks, F.col("task"))
        .sortWithinPartitions("block", "band", "salt", "guest")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit_rows():
            for part in slices(batches):
                tokens, bounds = shingle_sets(part.column("text"), k)
                d1, d2 = set_digests(tokens, bounds)
                # marks are 64-bit hashes; a text of another set is not the one
                right = (d1 == part.column("d1").to_numpy()) & (d2 == part.column("d2").to_numpy())
                names = ("node", "part", "block", "band", "salt", "guest")
                lists = [part.column(x).to_pylist() for x in names]
                for r in np.flatnonzero(right).tolist():
                    node, own, *unit, guest = (x[r] for x in lists)
                    yield tuple(unit), guest, (node, own, tokens[bounds[r] : bounds[r + 1]])

        def links():
            for _, group in groupby(unit_rows(), key=lambda x: x[0]):
                held, first = {}, None
                for _, guest, row in group:
                    if guest:
                        first = row
                        break
                    held[row[0]] = row
                later = (row for _, _, row in group)
                visitors = chain([first], later) if first else iter(())
                yield from join_unit(held.values(), _chunks(visitors, held), percent, inside)

        found = links()
        while pairs := list(islice(found, 1 << 16)):
            u, v = zip(*pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]
            )

    return stage(joined.mapInArrow(run, "u bigint, v bigint"), "links")


def _chunks(rows: Iterator, held: dict) -> Iterator[list]:
    while chunk := list(islice(rows, UNIT)):
        if fresh := [r for r in chunk if r[0] not in held]:
            yield fresh


def link_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct
    shingles of ``k`` words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased); component_id is the
    smallest doc_id that links reach. A text without words (null, empty, blank) has an
    empty set and links with nothing: it is its own component. Rows with equal sets are
    one class and share a component, repeated doc_ids included. Other columns are ignored
    and an empty table gives no rows. doc_id is an integer; a null one is taken as the
    smallest number for reaching, and comes back null.
    """
    docs = docs.select(_number(F.col(doc_id)).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    out = _linked_profiles(docs, k, percent)
    none = F.lit(_LOWEST).cast("bigint")
    return out.select(
        F.nullif("doc_id", none).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif("component_id", none).alias("component_id"),
    )


def _number(doc_id: Column) -> Column:
    """doc_id as a number, the lowest for null."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(_LOWEST).cast("bigint"))


def _linked_profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, component_id) per row of (doc_id, text, mark); no id is null, and
    mark is a hash of both."""
    profiles = _profile(docs, k, percent)
    classes = stage(
        profiles.where("n > 0").groupBy("n", "d1", "d2").agg(
            F.min("pos").alias("node"),
            F.min(F.struct("doc_id", "mark")).alias("rep"),
            F.min("keys").alias("keys"),
        ).select(
            "n", "d1", "d2", "node", "keys",
            F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"),
        ),
        "classes",
    )
    labels = components(_links(docs.select("mark", "text"), classes, k, percent))
    named = classes.select("n", "d1", "d2", "node", "rep_id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    named = stage(named.drop("node"), "named")
    least = stage(named.groupBy("label").agg(F.min("rep_id").alias("component_id")), "least")
    parts = stage(named.join(least, "label").select("n", "d1", "d2", "component_id"), "parts")
    return profiles.join(parts, ["n", "d1", "d2"], "left").select(
        "doc_id",
        "mark",
        "n",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def _links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between classes that connect what all links connect."""
    routes = classes.select("node", F.explode("keys").alias("key"))
    hubs = stage(
        routes.groupBy("key")
        .agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .drop("size"),
        "hubs",
    )
    stars = stage(
        routes.join(hubs, "key").where("node <> hub").select("hub", "node").distinct(), "stars"
    )
    blocks = components(stars.select(F.col("hub").alias("u"), F.col("node").alias("v")))
    members = _members(classes, blocks, percent)
    unit = ["block", "band", "salt"]
    own = members.select("node", F.col("node").alias("part"), "d1", "d2", "rep_mark", *unit, F.lit(False).alias("guest"))
    # the smallest hub of each class in a large block visits its unit
    visits = (
        stars.groupBy("node").agg(F.min("hub").alias("hub"))
        .join(members.where("salts > 0").select("node", *unit), "node")
        .select(F.col("hub").alias("node"), *unit)
        .distinct()
        .join(members.select("node", "d1", "d2", "rep_mark"), "node")
        .select("node", F.col("node").alias("part"), "d1", "d2", "rep_mark", *unit, F.lit(True).alias("guest"))
    )
    links = _run_units(docs, own.unionByName(visits), k, percent, True)
    large = members.where("salts > 0")
    if large.isEmpty():
        return links
    # blocks of several units: whatever is not in the block's largest part meets all units
    parts = stage(
        large.join(components(links), "node", "left")
        .withColumn("part", F.coalesce("label", "node"))
        .drop("label"),
        "parts",
    )
    sizes = stage(parts.groupBy("block", "part").agg(F.count(F.lit(1)).alias("c")), "part_sizes")
    main = stage(
        sizes.groupBy("block").agg(
            F.max(F.struct("c", "part")).getField("part").alias("main"),
            F.count(F.lit(1)).alias("n_parts"),
        ).where("n_parts > 1").drop("n_parts"),
        "main_parts",
    )
    if main.isEmpty():
        return links
    open_ = stage(parts.join(main, "block"), "open")
    units = open_.select("block", F.col("band").alias("to_band"), "salts").distinct()
    visitors = (
        open_.where("part <> main")
        .drop("salts")
        .withColumn("to_band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        .join(units, ["block", "to_band"])
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .where((F.col("to_band") != F.col("band")) | (F.col("to") != F.col("salt")))
        .select("node", "part", "d1", "d2", "rep_mark", "block", F.col("to_band").alias("band"),
                F.col("to").alias("salt"), F.lit(True).alias("guest"))
    )
    residents = open_.select("node", "part", "d1", "d2", "rep_mark", *unit, F.lit(False).alias("guest"))
    return links.union(_run_units(docs, residents.unionByName(visitors), k, percent, False))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of each component of links the
    row with the smallest doc_id, a null one counting as the smallest. Rows without words
    all stay; rows repeating the smallest doc_id of a component stay together. Rows of one
    doc_id with other texts are decided each by its own text."""
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        _number(F.col("doc_id")).alias("doc_id"),
        F.col("text"),
    ).withColumn("mark", F.xxhash64("doc_id", "text"))
    found = _linked_profiles(marked.drop("_row"), k, percent)
    gone = found.where("component_id <> doc_id").select("doc_id", "mark")
    return marked.drop("text").join(gone, ["doc_id", "mark"], "left_anti").select("_row.*")
