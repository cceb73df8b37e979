"""Connected components of an edge table by rounds of local contraction.

In a round every task joins the edges it holds with union-find, ``CHUNK`` at a time, and
says for each node which root it has there. The statements about one node then meet (at
most one per chunk, so a node with very many edges is no hot spot): the node takes its
smallest root, and the roots it has in common become the edges of the next, much smaller
round. Labels are looked up backwards through the rounds at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

CHUNK = 1 << 18


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their smallest connected node) of some edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(u, v)], ["node", "root"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield flush()
            held = []
    if held:
        yield flush()


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, root) in order: labels (node, smallest root) and edges between the
    smallest and the other roots of a node."""
    node_before = least_before = None
    for batch in batches:
        node, root = (batch.column(i).to_numpy() for i in range(2))
        if not len(node):
            continue
        first = np.ones(len(node), bool)
        first[1:] = node[1:] != node[:-1]
        first[0] = node[0] != node_before
        at = np.maximum.accumulate(np.where(first, np.arange(len(node)), -1))
        least = np.where(at >= 0, root[np.maximum(at, 0)], least_before if least_before is not None else 0)
        node_before, least_before = node[-1], least[-1]
        other = ~first & (root != least)
        pairs = np.unique(np.stack([root[other], least[other]], 1), axis=0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[first], pairs[:, 0]])),
                pa.array(np.concatenate([root[first], pairs[:, 1]])),
                pa.array(np.arange(first.sum() + len(pairs)) < first.sum()),
            ],
            ["u", "v", "is_label"],
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (columns u, v of any integer type):
    label is the smallest node of the component. Smallest nodes have no row."""
    now = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    rounds: list[DataFrame] = []
    while True:
        said = now.mapInArrow(_local, "node bigint, root bigint")
        met = stage(
            said.repartition("node")
            .sortWithinPartitions("node", "root")
            .mapInArrow(_meet, "u bigint, v bigint, is_label boolean"),
            "contracted",
        )
        rounds.append(met.where("is_label").select(F.col("u").alias("node"), F.col("v").alias("label")))
        left = met.where(~F.col("is_label")).select("u", "v")
        n = left.count()
        if not n:
            break
        now = left.coalesce(max(1, n // CHUNK))
    labels = rounds.pop()
    while rounds:
        higher = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = rounds.pop().join(higher, "label", "left").select(
            "node", F.coalesce("top", "label").alias("label")
        )
    return stage(labels.where("node <> label"), "labels")
