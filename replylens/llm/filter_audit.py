"""What each step of a chain of text filters removes, in every order of the filters.

A document's fate in any order depends only on which filters it fails. Documents are
therefore counted once per combination of failures, and every figure of every order is a
contraction of the resulting 2 x 2 x 2 x 2 x 2 tensor of a part: along each filter's axis a
step selects what passes, what fails, or all.

Filters (words are maximal runs without 0x20 and 0x09-0x0D):

* A: fewer than 200 words
* B: distinct words are less than half of the words
* C: more than 2 % of the code points are A-Z
* D: one of ``#$%&*|`` occurs
* E: a smaller doc_id has the same text, wherever it stands in the table
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

FILTERS = "ABCDE"
MIN_WORDS = 200
_SPACES = r"[\x20\x09-\x0D]+"
_KINDS = ("n", "good", "toxic")
_CELLS = 1 << len(FILTERS)
#: shares of a repeated doc_id, each joined with its own copy of the labels
_SALTS = 8

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def _failures() -> dict[str, Column]:
    """Whether a text fails A, B, C and D, over the columns of ``_measured``."""
    text = F.col("body")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * capitals.cast("bigint") > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, body, n_words, n_distinct): words are taken once a row."""
    words = F.filter(F.split("body", _SPACES), lambda w: w != "")
    return (
        docs.select(
            "doc_id", F.coalesce("source", F.lit("")).alias("part"),
            F.coalesce("text", F.lit("")).alias("body"),
        )
        .select("*", words.alias("words"))
        .select(
            "doc_id", "part", "body", F.size("words").cast("bigint").alias("n_words"),
            F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        )
    )


def _bit(name: str) -> int:
    """The weight of a filter's axis: A is the first, so the slowest, axis."""
    return 1 << (len(FILTERS) - 1 - FILTERS.index(name))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): documents per part and combination of failures.

    ``cell`` has a bit per filter, A the highest. Part is the source, null as the empty
    string. A null text is the empty text. A row without doc_id has no smaller id and is
    no smaller id, so it passes E; rows that share the smallest id of a text all pass. A
    doc_id that repeats in ``labels`` is good (toxic) if any of its rows says so; null
    labels say nothing. Extra columns are ignored; empty tables give no rows.

    Texts never move: a row is a digest, a part, an id and a few bits. Copies merge before
    every shuffle, so the largest group of equal texts is a few rows per task. Labels are
    never gathered in the driver.
    """
    bits = sum(
        (F.when(fails, _bit(name)).otherwise(0) for name, fails in _failures().items()), F.lit(0)
    )
    rows = (
        _measured(docs)
        .select(
            "doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"),
            bits.cast("tinyint").alias("cell"),
        )
        .groupBy("doc_id", "part", "digest", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        # rows without an id and rows of one id are dealt by their text
        .withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(_SALTS)).cast("tinyint"))
        .withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    )
    said = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(
            F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
        .select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<tinyint>")).alias("salt"),
            F.lit(0).cast("bigint").alias("spread"),
        )
    )
    # Files of numbers pack to a few bytes a row, so the planner takes millions of labels, eight
    # times over, for small enough to be gathered in the driver; they are dealt instead.
    known = rows.join(said.hint("merge"), ["doc_id", "salt", "spread"], "left")
    # rows of one id and text were merged, so the smallest id's number of rows is min_by
    per_text = known.groupBy(
        "digest", "part", "cell",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    ).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
    )
    # read twice, and computing it reads all texts
    per_text = stage(per_text, "texts")
    firsts = per_text.groupBy("digest").agg(F.min("first").alias("smallest"))
    stays = F.col("no_id") + F.when(
        F.col("first") == F.col("smallest"), F.col("n_first")
    ).otherwise(0)
    sides = F.inline(
        F.array(
            F.struct(F.lit(0).alias("copy"), stays.alias("rows")),
            F.struct(F.lit(_bit("E")).alias("copy"), (F.col("n") - stays).alias("rows")),
        )
    )
    return (
        per_text.join(firsts, "digest")
        .select("part", "cell", "good", "toxic", sides)
        .groupBy("part", (F.col("cell") + F.col("copy")).cast("int").alias("cell"))
        .agg(
            F.sum("rows").alias("n"),
            F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("rows")).otherwise(0)).alias("toxic"),
        )
    )


def _selectors(sides: list[dict[str, tuple[int, int]]]) -> list[np.ndarray]:
    """One (steps, 2) matrix per axis from a choice of side per step; all where unnamed."""
    return [np.array([side.get(f, _ALL) for side in sides], np.int64) for f in FILTERS]


def _contract(tensors: np.ndarray, sides: list[dict[str, tuple[int, int]]]) -> np.ndarray:
    """(parts, steps): for every step the sum of the cells on the chosen sides."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *_selectors(sides), optimize=True)


_STEPS = [
    (order, i) for order in map("".join, permutations(FILTERS)) for i in range(len(FILTERS))
]


def step_figures(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of all orders and steps, each (parts, steps), from (parts, 32) counts."""
    shape = (-1, *[2] * len(FILTERS))
    n, good, toxic = (x.reshape(shape) for x in (n, good, toxic))
    before = [{f: _PASS for f in order[:i]} for order, i in _STEPS]
    here = [order[i] for order, i in _STEPS]
    removing = [side | {f: _FAIL} for side, f in zip(before, here)]
    removed = _contract(n, removing)
    figures = {
        "kept": _contract(n, [side | {f: _PASS} for side, f in zip(before, here)]),
        "removed": removed,
        "redundant": _contract(n, [{f: _FAIL} for f in here]) - removed,
        "unique_fails": _contract(
            n, [{g: _FAIL if g == f else _PASS for g in FILTERS} for f in here]
        ),
        "good_lost": _contract(good, removing),
        "toxic_lost": _contract(toxic, removing),
    }
    shapley = np.zeros_like(removed)
    for f in FILTERS:
        mine = np.array([g == f for g in here])
        shapley[:, mine] = removed[:, mine].sum(axis=1, keepdims=True)
    return figures | {"shapley": shapley}


_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: (part, filter_order, step) and the
    numbers of documents that stay after the step (kept), go in it (removed), would go had
    they not gone earlier (redundant), fail this filter only (unique_fails), go in it though
    good (good_lost) or being toxic (toxic_lost), and go by this filter in all orders
    together (shapley).

    A part's 32 counts are one row; 600 rows come out of it. See ``failure_counts`` for
    nulls, repeated rows and empty tables.
    """
    counts = F.map_from_entries(F.collect_list(F.struct("cell", F.struct(*_KINDS).alias("k"))))
    cells = F.sequence(F.lit(0), F.lit(_CELLS - 1))

    def tensor(kind: str) -> Column:
        """The 32 counts of a kind in the order of their cells, zeros included."""
        return F.transform(
            cells,
            lambda i: F.coalesce(
                F.try_element_at("m", i).getField(kind), F.lit(0).cast("bigint")
            ),
        ).alias(kind)

    tensors = (
        failure_counts(docs, labels)
        .groupBy("part")
        .agg(counts.alias("m"))
        .select("part", *map(tensor, _KINDS))
    )
    orders = [order for order, _ in _STEPS]
    steps = np.array([i + 1 for _, i in _STEPS], np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # 16 parts at a time: 9,600 rows
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                figures = step_figures(
                    *(np.array(part.column(k).to_pylist(), np.int64) for k in _KINDS)
                )
                names = part.column("part")
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(np.repeat(np.arange(part.num_rows), len(steps)))),
                        pa.array(orders * part.num_rows, pa.string()),
                        pa.array(np.tile(steps, part.num_rows)),
                        *(pa.array(figures[x].ravel()) for x in _FIGURES),
                    ],
                    ["part", "filter_order", "step", *_FIGURES],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(
        f"{x} bigint" for x in _FIGURES
    )
    return tensors.mapInArrow(run, schema)
