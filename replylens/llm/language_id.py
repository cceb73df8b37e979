"""Language identification with a byte convolutional network in numpy.

Filters of several widths slide over the bytes of a fixed-length window; their
rectified maxima over the window feed a softmax. Texts are cut into windows from end to
end and every window is scored; a document's prediction weighs its windows by length.

A filter over one-hot bytes is a sum of table rows, one per offset. For scoring the rows
of two neighbouring bytes are added up beforehand, so a filter of width w costs w / 2
look-ups a position.

A softmax over languages is sure of itself on text in no language at all. ``fit`` with
``background`` therefore trains one more output on texts made unreadable: letters
exchanged at random, moved to other scripts, or replaced by random bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .arrays import slices, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: training documents per language (expected number; the sample is by hash) and windows
#: taken from each: the bounds of what the driver holds
DOCS_PER_LANGUAGE = 1500
WINDOWS_PER_DOC = 4
BROADCAST_LABELS = 1 << 12
UNKNOWN = "und"
#: probability of the background from which ``keep_identified`` rejects a text
REJECT = 0.9
_PAD = 256
_CODES = 257
_SCORE_ROWS = 1 << 9


@dataclass
class ByteCNN:
    """``filters[w]`` has shape (w, 257, FILTERS); code 256 pads short windows. With
    ``background`` there is an output more than there are languages."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    background: bool = False

    def features(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maximum, its position) of every filter over each row of ``codes``."""
        top, place = [], []
        for w in self.filters:
            n = codes.shape[1] - len(w) + 1
            total = w[0][codes[:, :n]]
            for j in range(1, len(w)):
                total += w[j][codes[:, j : j + n]]
            at = total.argmax(1)
            top.append(np.take_along_axis(total, at[:, None], 1)[:, 0])
            place.append(at)
        return np.concatenate(top, 1) + self.bias, np.concatenate(place, 1)

    def paired(self) -> list[list[np.ndarray]]:
        """Per filter width the tables over byte pairs (and a last single byte)."""
        tables = []
        for w in self.filters:
            row = [
                (w[j][:, None] + w[j + 1][None]).reshape(-1, FILTERS)
                for j in range(0, len(w) - 1, 2)
            ]
            tables.append(row + ([w[-1]] if len(w) % 2 else []))
        return tables

    def log_probabilities(self, codes: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        out = np.empty((len(codes), len(self.offset)), np.float32)
        for at in range(0, len(codes), _SCORE_ROWS):
            part = codes[at : at + _SCORE_ROWS]
            pairs = part[:, :-1] * _CODES + part[:, 1:]
            top = []
            for width, row in zip(WIDTHS, tables):
                n = part.shape[1] - width + 1
                total = row[0][pairs[:, :n]]
                for k, table in enumerate(row[1:], 1):
                    source = pairs if len(table) > _CODES else part
                    total += table[source[:, 2 * k : 2 * k + n]]
                top.append(total.max(1))
            hidden = np.maximum(np.concatenate(top, 1) + self.bias, 0)
            logits = hidden @ self.weights + self.offset
            logits -= logits.max(1, keepdims=True)
            out[at : at + _SCORE_ROWS] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def train(
    codes: np.ndarray,
    labels: np.ndarray,
    languages: list[str],
    epochs: int = 8,
    seed: int = 3,
    background: bool = False,
) -> ByteCNN:
    """Mini-batch Adam on cross-entropy; languages weigh alike whatever their share. With
    ``background``, label ``len(languages)`` is that of the background."""
    draw = np.random.Generator(np.random.PCG64(seed))
    n_out, n_hidden = len(languages) + background, FILTERS * len(WIDTHS)
    model = ByteCNN(
        languages,
        [draw.normal(0, 0.05, (w, _CODES, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(n_hidden, 0.1, np.float32),
        draw.normal(0, 0.3, (n_hidden, n_out)).astype(np.float32),
        np.zeros(n_out, np.float32),
        background,
    )
    values = [*model.filters, model.bias, model.weights, model.offset]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    weight = (len(labels) / (n_out * np.bincount(labels, minlength=n_out).clip(1)))[labels]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            x, y = codes[rows], labels[rows]
            raw, place = model.features(x)
            hidden = np.maximum(raw, 0)
            logits = hidden @ model.weights + model.offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[rows] / len(rows))[:, None]
            back = (p @ model.weights.T) * (raw > 0)
            grads = [np.zeros_like(w) for w in model.filters]
            unit = np.arange(FILTERS)
            for k, grad in enumerate(grads):
                span = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(len(grad)):
                    seen = np.take_along_axis(x, place[:, span] + j, 1)
                    np.add.at(grad[j], (seen, unit[None]), back[:, span])
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            rate = 0.01 / (1 + step / 400)
            for v, g, m, s in zip(values, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return model


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, row, length) of the windows that tile each text; an empty text has none."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[row + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    codes = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int32)
    codes[np.arange(WINDOW) >= length[:, None]] = _PAD
    return codes, row, length


def unreadable(codes: np.ndarray, seed: int = 5) -> np.ndarray:
    """Each window made unreadable in one of four ways, in turn: Latin letters exchanged
    among themselves, written as letters of a two-byte script or as signs of a three-byte
    script (an alphabet of its own for each window), and all bytes replaced by random ones.
    Lengths stay or are cut to the window; padding stays."""
    draw = np.random.Generator(np.random.PCG64(seed))
    upper = np.arange(65, 91)
    out = np.full_like(codes, _PAD)
    for i, window in enumerate(codes):
        raw = window[window != _PAD]
        if i % 4 == 3:
            new = draw.integers(0, 256, len(raw))
        else:
            # one row of bytes for each byte value; -1 is no byte
            table = np.full((256, 3), -1)
            table[:, 0] = np.arange(256)
            if i % 4 == 0:
                table[upper, 0] = draw.permutation(upper)
                table[upper + 32, 0] = draw.permutation(upper) + 32
            else:
                letters = np.concatenate([upper, upper + 32])
                signs = draw.integers(0x80, 0xC0, (52, 3))
                signs[:, 0] = draw.integers(0xCE, 0xDA) if i % 4 == 1 else draw.integers(0xE1, 0xED, 52)
                signs[:, 2] = -1 if i % 4 == 1 else signs[:, 2]
                table[letters] = signs
            new = table[raw].ravel()
            new = new[new >= 0][: codes.shape[1]]
        out[i, : len(new)] = new
    return out


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    seed: int = 11,
    background: bool = False,
) -> ByteCNN:
    """A network trained on a bounded sample of labelled rows; with ``background``, also on
    as many ``unreadable`` windows as a language has on average.

    Per label about ``docs_per_language`` documents, chosen by a hash of doc_id and text,
    give up to ``WINDOWS_PER_DOC`` evenly spaced windows each. Rows with a null label, a
    null text or no letter do not count. Without any usable row the model knows no
    language. The driver holds the windows of the sample: labels * 1,500 * 4 * 512 bytes.
    """
    usable = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("lang")
    ).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = stage(usable.groupBy("lang").count(), "label_counts")
    # so few labels that the texts need not be shuffled to meet their counts
    if counts.count() <= BROADCAST_LABELS:
        counts = F.broadcast(counts)
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    chosen = (
        usable.join(counts, "lang")
        .where(F.pmod(draw, F.lit(1 << 20)) / float(1 << 20) < docs_per_language / F.col("count"))
        .select("text", "lang")
    )

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches):
            codes, row, _ = windows(*text_bytes(cut.column("text")))
            sizes = np.bincount(row, minlength=cut.num_rows)
            first = np.cumsum(sizes) - sizes
            picked = np.concatenate(
                [
                    f + np.unique(np.linspace(0, n - 1, min(n, WINDOWS_PER_DOC)).astype(int))
                    for f, n in zip(first, sizes)
                    if n
                ]
                or [np.zeros(0, int)]
            ).astype(int)
            raw = [x.tobytes() for x in codes[picked].astype(np.uint16)]
            yield pa.RecordBatch.from_arrays(
                [cut.column("lang").take(pa.array(row[picked])), pa.array(raw, pa.binary())],
                ["lang", "codes"],
            )

    rows = chosen.mapInArrow(sample, "lang string, codes binary").collect()
    rows.sort()
    languages = sorted({r["lang"] for r in rows})
    codes = np.frombuffer(b"".join(r["codes"] for r in rows), np.uint16)
    codes = codes.reshape(-1, WINDOW).astype(np.int32)
    known = {x: i for i, x in enumerate(languages)}
    labels = np.array([known[r["lang"]] for r in rows], int)
    if not background or not languages:
        return train(codes, labels, languages)
    draw = np.random.Generator(np.random.PCG64(seed))
    some = draw.permutation(len(codes))[: -(-len(codes) // len(languages))]
    codes = np.concatenate([codes, unreadable(codes[some])])
    labels = np.append(labels, np.full(len(some), len(languages)))
    return train(codes, labels, languages, background=True)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class _Scorer:
    """A fitted network on its way to the executors."""

    def __init__(self, spark: SparkSession, model: ByteCNN):
        self._held = spark.sparkContext.broadcast(
            (model.languages, model.filters, model.bias, model.weights, model.offset, model.background)
        )

    def load(self) -> Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function of texts and whether they have a letter: (language, its probability,
        that of the background)."""
        net = ByteCNN(*self._held.value)
        names = np.array([*net.languages, UNKNOWN], dtype=object)
        tables = net.paired()
        step = _SCORE_ROWS * 8

        def score(texts: pa.Array, lettered: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            has = lettered.to_numpy(zero_copy_only=False).astype(bool)
            best, top = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            none = np.zeros(len(texts))
            codes, row, length = windows(*text_bytes(texts))
            if net.languages and len(row):
                sums = np.zeros((len(texts), len(net.offset)))
                for at in range(0, len(row), step):
                    span = slice(at, at + step)
                    logs = net.log_probabilities(codes[span], tables)
                    np.add.at(sums, row[span], logs * length[span, None])
                total = np.bincount(row, length, len(texts))
                mean = sums / np.maximum(total, 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = np.where(has, p.argmax(1), best)
                top = np.where(has, p.max(1), 0.0)
                if net.background:
                    none = np.where(has, p[:, -1], 0.0)
            return names[best], top, none

        return score


def predict(
    docs: DataFrame, model: ByteCNN, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (probability of lang_pred).

    ``und`` with score 0 where the text is null, empty or has no letter, or the model
    knows no language; a model with background says ``und`` also where that is likeliest.
    The whole text is read, in windows. Equal texts get equal
    predictions; extra columns are ignored; an empty table gives no rows.
    """
    scorer = _Scorer(docs.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer.load()
        for cut in slices(batches):
            names, top, _ = score(cut.column("text"), cut.column("lettered"))
            yield pa.RecordBatch.from_arrays(
                [cut.column("doc_id"), pa.array(names, pa.string()), pa.array(top)],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        has_letter(F.col(text)).alias("lettered"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteCNN, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged.

    Rejected are texts that are null, empty or without a letter, and, by a model with
    background, those whose background has a probability of ``reject`` or more. Short texts
    give little evidence and stay. A model that knows no language rejects no text with a
    letter. Whole texts are read, equal texts are decided alike; an empty table stays empty.
    """
    scorer = _Scorer(docs.sparkSession, model)
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer.load()
        for cut in slices(batches, f"c{place}"):
            lettered = cut.column("lettered")
            _, _, none = score(cut.column(place), lettered)
            stays = lettered.to_numpy(zero_copy_only=False).astype(bool) & (none < reject)
            yield cut.select(cut.schema.names[:-1]).filter(pa.array(stays))

    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)),
        has_letter(F.col("text")).alias("lettered"),
    )
    return rows.mapInArrow(run, rows.drop("lettered").schema).toDF(*docs.columns)


def held_out(doc_id: Column, modulus: int = 5) -> Column:
    """Rows that training never sees: crc32 of the decimal doc_id divisible by modulus."""
    return F.coalesce(
        F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(False)
    )


def identify(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, by a model fitted on the rows
    that are not held out."""
    model = fit(docs.where(~held_out(F.col(doc_id))), doc_id)
    return predict(docs, model, doc_id).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
