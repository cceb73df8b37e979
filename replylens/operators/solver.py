"""Linear models with many terms, fitted without sending gradients through the driver.

The objectives are those of Spark's solvers (weighted hinge loss of each class against the
rest, or softmax loss of all classes at once, with a squared penalty on the coefficients and
a free intercept), and so is the method (L-BFGS); the rule by which a fit ends is theirs with
a tenth of the tolerance. What differs is where numbers live. The fit is one barrier stage: each task keeps its rows and
their margins, and a range of the coefficients with its part of the search history. In every
step tasks exchange directions and gradients, of the terms their rows hold, through files in
the stage folder, which are written over in the next step. All classes take their steps
together. The driver gets the coefficients once, at the end.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_root

#: rows that make a task worth while, entries that are multiplied at once
ROWS_PER_TASK, CHUNK = 4_000, 1 << 17
#: pairs of the search history, values that must have settled, trials of a line search
HISTORY, SETTLED, TRIALS = 10, 10, 40
#: seconds that a task waits for another; a lost one makes Spark end the stage before
PATIENCE = 3600
_ARMIJO, _CURVATURE = 1e-4, 0.9
#: of the tolerance, as Spark's steps go on longer for the same value
_STRICTER = 0.1


@dataclass(frozen=True)
class Problem:
    """``classes`` columns of coefficients over ``size`` terms and an intercept."""

    size: int
    classes: int
    softmax: bool  # one softmax loss, or a hinge loss for each class against the rest
    penalty: tuple[float, ...]  # per class, on half the squared coefficients
    raised: tuple[float, ...]  # per class, the weight of its own rows in its own fit
    weight_sum: tuple[float, ...]  # per class
    intercept: tuple[float, ...]  # to begin with
    max_iter: int
    tol: float


@dataclass(frozen=True)
class Solution:
    coefficients: np.ndarray  # classes x size
    intercepts: np.ndarray
    steps: int
    values: np.ndarray  # of the objective, per class (equal for softmax)


def shared_folder(spark: SparkSession) -> str | None:
    """The stage folder as a path that tasks can open, or None if it is no folder."""
    root = stage_root(spark)
    root = root[len("file:") :] if root.startswith("file:") else root
    return None if "://" in root else "/" + root.lstrip("/") if root.startswith("/") else root


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once; 0 where the number changes while jobs run."""
    context = spark.sparkContext._jsc.sc()
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def solve(data: DataFrame, rows: int, problem: Problem) -> Solution:
    """Fit on ``data`` (label as the number of a class, weight, features as sparse vectors)."""
    spark = data.sparkSession
    tasks = max(1, min(slots(spark), math.ceil(rows / ROWS_PER_TASK)))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}/solver"
    entries = F.unwrap_udt(F.col("features"))
    table = data.select(
        F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"),
        entries.getField("indices").alias("indices"), entries.getField("values").alias("values"),
    ).repartition(tasks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(BarrierTaskContext.get(), folder, problem, batches)
        steps, values = task.fit()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([task.edges[task.rank]]), pa.array([steps]),
                pa.array([values.tobytes()]), pa.array([task.w.tobytes()]),
            ],
            ["start", "steps", "value", "part"],
        )

    schema = "start bigint, steps bigint, value binary, part binary"
    parts = table.mapInArrow(run, schema, barrier=True).toArrow().sort_by("start")
    shards = [np.frombuffer(x.as_buffer()).reshape(problem.classes, -1) for x in parts.column("part")]
    whole = np.concatenate(shards, axis=1)
    return Solution(
        whole[:, :-1], whole[:, -1].copy(), parts.column("steps")[0].as_py(),
        np.frombuffer(parts.column("value")[0].as_buffer()),
    )


class _Task:
    """One task's rows (by column: classes x rows) and range of terms (classes x terms)."""

    def __init__(self, context, folder: str, problem: Problem, batches: Iterable[pa.RecordBatch]):
        self.problem = problem
        self.rank, self.tasks = context.partitionId(), len(context.getTaskInfos())
        # a stage that is run again must not meet the files of the run before
        self.folder, self.met = f"{folder}_{context.allGather(uuid.uuid4().hex)[0]}", 0
        os.makedirs(self.folder, exist_ok=True)
        self.read(batches)
        p = problem
        self.edges = np.linspace(0, p.size + 1, self.tasks + 1).astype(np.int64)
        self.cuts = np.searchsorted(self.terms, self.edges)
        self.start, end = self.edges[self.rank], self.edges[self.rank + 1]
        self.w = np.zeros((p.classes, end - self.start))
        self.penalised = np.ones(end - self.start)
        if self.rank == self.tasks - 1:  # the intercept is the last term, that of every row
            self.penalised[-1] = 0.0
            self.w[:, -1] = p.intercept
        np.save(self.path("terms", self.rank), self.terms)
        cuts = self.gather(self.cuts.astype(float)).astype(np.int64)
        self.at = [  # for each task: where its gradient of this range lies, and of which terms
            (a, b, np.load(self.path("terms", q), mmap_mode="r")[a:b] - self.start)
            for q, (a, b) in enumerate(zip(cuts[:, self.rank], cuts[:, self.rank + 1]))
        ]

    def read(self, batches: Iterable[pa.RecordBatch]) -> None:
        p, label, weight, sizes, terms, values = self.problem, [], [], [], [], []
        for batch in batches:
            lists = batch.column("indices")
            label.append(batch.column("label").to_numpy())
            weight.append(batch.column("weight").to_numpy())
            sizes.append(np.diff(lists.offsets.to_numpy()))
            terms.append(lists.flatten().to_numpy().astype(np.int32))
            values.append(batch.column("values").flatten().to_numpy().astype(np.float32))
        none = np.zeros(0)
        label, weight = (np.concatenate([none, *x]) for x in (label, weight))
        sizes = np.concatenate([none, *sizes]).astype(np.int64) + 1
        terms = np.concatenate([np.zeros(0, np.int32), *terms])
        values = np.concatenate([np.zeros(0, np.float32), *values])
        last = np.cumsum(sizes) - 1
        kept = np.ones(len(terms) + len(sizes), bool)
        kept[last] = False
        self.columns = np.full(len(kept), p.size, np.int32)
        self.columns[kept] = terms
        self.values = np.ones(len(kept), np.float32)
        self.values[kept] = values
        del terms, values, kept
        self.terms = np.unique(self.columns)
        # in parts, as the positions come as 64-bit numbers
        for a in range(0, len(self.columns), 1 << 22):
            part = slice(a, a + (1 << 22))
            self.columns[part] = np.searchsorted(self.terms, self.columns[part])
        self.first = np.append(0, last + 1).astype(np.int64)
        # rows are dealt so that a part has about CHUNK entries
        marks = np.searchsorted(self.first, np.arange(0, self.first[-1], CHUNK))
        self.parts = np.unique(np.append(marks, len(sizes)))
        mine = label == np.arange(p.classes)[:, None]
        if p.softmax:
            self.mine, self.weight = mine, weight / p.weight_sum[0]
        else:
            raised = np.where(mine, np.array(p.raised)[:, None], 1.0) * weight
            self.mine = np.where(mine, 1.0, -1.0)
            self.weight = raised / np.array(p.weight_sum)[:, None]

    # --- exchange -----------------------------------------------------------------------

    def path(self, kind: str, rank: int) -> str:
        return f"{self.folder}/{kind}_{rank}.npy"

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The numbers of all tasks, a row each; files written before can be read then. A
        barrier of Spark's would do, but it sleeps a second."""
        self.met += 1
        # a task is at most one meeting ahead, so two files a task are enough
        name = f"{self.folder}/note_{self.met % 2}_"
        sent = np.append(float(self.met), numbers).astype(np.float64).tobytes()
        with open(f"{name}{self.rank}.new", "wb") as file:
            file.write(sent)
        os.replace(f"{name}{self.rank}.new", f"{name}{self.rank}")
        got, since = [], time.monotonic()
        for q in range(self.tasks):
            pause = 0.0002
            while True:
                try:
                    with open(f"{name}{q}", "rb") as file:
                        note = np.frombuffer(file.read())
                    if note[0] == self.met:
                        break
                except FileNotFoundError:
                    pass
                if time.monotonic() - since > PATIENCE:
                    raise TimeoutError(f"task {q} of the solver has not been heard of")
                time.sleep(pause)
                pause = min(pause * 1.5, 0.02)
            got.append(note[1:])
        return np.array(got)

    def total(self, numbers: np.ndarray) -> np.ndarray:
        """Sums over all tasks; (.., classes) come back with sums over classes for softmax."""
        sums = self.gather(numbers).sum(0).reshape(np.shape(numbers))
        if self.problem.softmax:
            sums = np.broadcast_to(sums.sum(-1, keepdims=True), sums.shape)
        return sums

    def spread(self, shard: np.ndarray) -> np.ndarray:
        """Values (classes x terms of the rows) of a vector held in ranges."""
        np.save(self.path("direction", self.rank), shard)
        self.gather(np.zeros(0))
        out = np.empty((len(shard), len(self.terms)))
        for q in range(self.tasks):
            a, b = self.cuts[q], self.cuts[q + 1]
            if a < b:
                part = np.load(self.path("direction", q), mmap_mode="r")
                for row, values in zip(out, part):
                    np.take(values, self.terms[a:b] - self.edges[q], out=row[a:b])
        return out

    def collect(self, local: np.ndarray) -> np.ndarray:
        """The sums over all tasks' values per term, of this task's range."""
        np.save(self.path("gradient", self.rank), local)
        self.gather(np.zeros(0))
        out = np.zeros((len(local), self.w.shape[1]))
        for q, (a, b, at) in enumerate(self.at):
            if a < b:
                for row, values in zip(out, np.load(self.path("gradient", q), mmap_mode="r")):
                    row[at] += values[a:b]  # a task names a term once
        return out

    # --- rows ---------------------------------------------------------------------------

    def products(self, values: np.ndarray) -> np.ndarray:
        """classes x rows from classes x terms."""
        out = np.empty((len(values), len(self.first) - 1))
        for a, b in zip(self.parts[:-1], self.parts[1:]):
            span = slice(self.first[a], self.first[b])
            columns, x = self.columns[span], self.values[span]
            starts = self.first[a:b] - self.first[a]
            for k, row in enumerate(values):
                out[k, a:b] = np.add.reduceat(row[columns] * x, starts)
        return out

    def transposed(self, rows: np.ndarray) -> np.ndarray:
        """classes x terms from classes x rows."""
        out = np.zeros((len(rows), len(self.terms)))
        sizes, n = np.diff(self.first), len(self.terms)
        step = max(1, n // CHUNK)  # a part is worth a sum over all terms
        edges = np.unique(np.append(self.parts[::step], self.parts[-1]))
        for a, b in zip(edges[:-1], edges[1:]):
            span = slice(self.first[a], self.first[b])
            columns, x, size = self.columns[span], self.values[span], sizes[a:b]
            for k, row in enumerate(rows):
                if row[a:b].any():
                    out[k] += np.bincount(columns, np.repeat(row[a:b], size) * x, n)
        return out

    def losses(self, margins: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss per class, its slope per margin); the softmax loss stands with the first."""
        if self.problem.softmax:
            top = margins.max(0)
            powers = np.exp(margins - top)
            sums = powers.sum(0)
            loss = np.zeros(len(margins))
            loss[0] = self.weight @ (np.log(sums) + top - margins[self.mine.argmax(0), np.arange(margins.shape[1])])
            return loss, self.weight * (powers / sums - self.mine)
        mine, weight = self.mine[on], self.weight[on]
        short = 1.0 - mine * margins
        inside = short > 0
        return (weight * short * inside).sum(1), -weight * mine * inside

    # --- the fit ------------------------------------------------------------------------

    def fit(self) -> tuple[int, np.ndarray]:
        p, m = self.problem, HISTORY
        k, width = self.w.shape
        penalty = np.array(p.penalty)
        on = np.arange(k)  # classes that still take steps
        margins = self.products(self.spread(self.w))
        loss, slopes = self.losses(margins, on)
        squares = (self.w**2 * self.penalised).sum(1)
        value = self.total(np.stack([loss, squares / 2 * penalty])).sum(0)
        begin, past = value.copy(), []
        g = self.collect(self.transposed(slopes)) + penalty[:, None] * self.w * self.penalised
        # 0 .. m - 1: steps, m .. 2 m - 1: changes of the gradient, 2 m: the gradient
        basis = np.zeros((2 * m, k, width), np.float32)
        dots = np.zeros((k, 2 * m + 1, 2 * m + 1))
        dots[:, -1, -1] = self.total((g * g).sum(1))
        valid, order, steps = np.zeros((k, m), bool), [], 0
        while len(on) and steps < p.max_iter:
            share = _direction(dots, valid, order)
            rises = np.einsum("ki,ki->k", share, dots[:, :, -1])
            bad = rises >= 0
            if bad.any():  # forget what led there
                valid[bad] = False
                share = _direction(dots, valid, order)
                rises = np.einsum("ki,ki->k", share, dots[:, :, -1])
            d = share[:, -1, None] * g
            for j in [*order, *(m + j for j in order)]:
                d += share[:, j, None] * basis[j]
            off = np.setdiff1d(np.arange(k), on)
            d[off] = 0.0
            moves = self.products(self.spread(d[on]))
            t, value[on], failed = self.search(margins[on], moves, d, value, rises, valid, on)
            steps += 1
            # what cannot be lowered along the gradient itself has ended
            stuck = failed & ~valid[on].any(1)
            valid[on[failed]] = False
            step = np.zeros(k)
            step[on] = t
            margins[on] += t[:, None] * moves
            d *= step[:, None]
            self.w += d
            _loss, slopes = self.losses(margins[on], on)
            fresh = g.copy()
            fresh[on] = self.collect(self.transposed(slopes))
            fresh[on] += (penalty[:, None] * self.w * self.penalised)[on]
            slot = (steps - 1) % m
            order = [j for j in order if j != slot] + [slot]
            basis[slot], basis[m + slot] = d, fresh - g
            g = fresh
            news = (basis[slot], basis[m + slot], g)
            sums = np.zeros((3, 2 * m + 1, k))
            for i, new in enumerate(news):
                for j in [*order, *(m + j for j in order)]:
                    sums[i, j] = np.einsum("ks,ks->k", new, basis[j], dtype=np.float64)
                sums[i, -1] = np.einsum("ks,ks->k", new, g, dtype=np.float64)
            sums = self.total(sums)
            for at, new in zip((slot, m + slot, 2 * m), sums):
                dots[:, at, :] = dots[:, :, at] = new.T
            curved = dots[:, slot, m + slot]
            valid[:, slot] = curved > 1e-12 * dots[:, m + slot, m + slot]
            valid[on[failed], slot] = False
            past.append(value.copy())
            ended = dots[on, -1, -1] <= 1e-16
            if len(past) >= SETTLED:
                recent = np.max(past[-SETTLED:], axis=0)
                ended |= (recent - value <= _STRICTER * p.tol * begin)[on]
            if p.softmax:
                ended, stuck = np.full(k, ended.all()), np.full(k, stuck.any())
            on = on[~(ended | stuck)]
        for kind in ("terms", "direction", "gradient"):  # the last exchange is over
            os.remove(self.path(kind, self.rank))
        return steps, value

    def search(self, margins, moves, d, value, rises, valid, on):
        """(step, value, failed) per class that is on: a step that lowers the value and its
        slope enough, found by halving between steps too long and too short."""
        p, penalty = self.problem, np.array(self.problem.penalty)[on]
        w, d = self.w[on] * self.penalised, d[on]
        squares = self.total(np.stack([(w * w).sum(1), (w * d).sum(1), (d * d * self.penalised).sum(1)]))
        rises, start = rises[on], value[on]
        # the first step along a gradient goes as far as Spark's
        length = np.sqrt(self.total((d * d).sum(1)))
        t = np.where(valid[on].any(1), 1.0, 1.0 / np.maximum(length, 1e-300))
        low, high = np.zeros(len(on)), np.full(len(on), np.inf)
        best, best_value = np.zeros(len(on)), start.copy()
        open_ = rises < 0
        for _ in range(TRIALS):
            if not open_.any():
                break
            loss, slopes = self.losses(margins + t[:, None] * moves, on)
            loss, slope = self.total(np.stack([loss, (slopes * moves).sum(1)]))
            now = loss + penalty / 2 * (squares[0] + 2 * t * squares[1] + t * t * squares[2])
            slope = slope + penalty * (squares[1] + t * squares[2])
            lower = now <= start + _ARMIJO * t * rises
            flat = slope >= _CURVATURE * rises
            better = open_ & lower & (now < best_value)
            best, best_value = np.where(better, t, best), np.where(better, now, best_value)
            done = open_ & lower & flat
            best, best_value = np.where(done, t, best), np.where(done, now, best_value)
            open_ = open_ & ~done
            high = np.where(open_ & ~lower, t, high)
            low = np.where(open_ & lower & ~flat, t, low)
            middle = np.where(np.isinf(high), 2 * np.maximum(low, t), (low + high) / 2)
            t = np.where(open_, middle, t)
        return best, best_value, best <= 0


def _direction(dots: np.ndarray, valid: np.ndarray, order: list[int]) -> np.ndarray:
    """Shares of the basis vectors in each class's direction: the two loops of L-BFGS on the
    products of the vectors instead of the vectors."""
    m = valid.shape[1]
    share = np.zeros(dots.shape[:2])
    share[:, -1] = -1.0
    alpha, scale = np.zeros(valid.shape), np.ones(len(share))
    for j in reversed(order):
        curved = np.where(valid[:, j], dots[:, j, m + j], 1.0)
        alpha[:, j] = np.where(valid[:, j], np.einsum("ki,ki->k", share, dots[:, :, j]) / curved, 0.0)
        share[:, m + j] -= alpha[:, j]
    for j in order:  # the newest counts
        square = np.where(valid[:, j], dots[:, m + j, m + j], 1.0)
        scale = np.where(valid[:, j], dots[:, j, m + j] / square, scale)
    share *= scale[:, None]
    for j in order:
        curved = np.where(valid[:, j], dots[:, j, m + j], 1.0)
        beta = np.einsum("ki,ki->k", share, dots[:, :, m + j]) / curved
        share[:, j] += np.where(valid[:, j], alpha[:, j] - beta, 0.0)
    return share
