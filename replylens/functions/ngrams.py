"""Word and character n-grams as array expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACES_PATTERN, TOKEN_PATTERN

NgramRange = tuple[int, int]
#: tokens of the rows that are counted at a time; a longer row is counted alone
TOKENS_AT_A_TIME = 1 << 20


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def word_ngrams(tokens: Column, ngram_range: NgramRange) -> Column:
    """Adjacent tokens joined by a blank, for every length in the range.

    Longer n-grams zip the array with its own shifted copies; the array is never
    captured inside a lambda, where it would be evaluated once per element.
    """
    low, high = ngram_range
    grams, blocks = tokens, [tokens] if low == 1 else []
    for n in range(2, high + 1):
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), count),
            F.slice(tokens, F.lit(n), count),
            lambda head, last: F.concat(head, F.lit(" "), last),
        )
        if n >= low:
            blocks.append(grams)
    return blocks[0] if len(blocks) == 1 else F.concat(*blocks)


def padded_ngrams(word: Column, ngram_range: NgramRange) -> Column:
    """Character n-grams of one word, padded with one blank on both sides. A padded word
    shorter than the smallest n is one n-gram by itself."""
    low, high = ngram_range
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)
    sizes = F.sequence(F.least(F.lit(low), size), F.least(F.lit(high), size))
    return F.flatten(
        F.transform(
            sizes,
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n)
            ),
        )
    )


def spaced_words(text: Column) -> Column:
    """Lower-case words separated by white space, punctuation included."""
    return F.filter(F.split(F.lower(text), SPACES_PATTERN), lambda w: w != "")


def char_ngrams(text: Column, ngram_range: NgramRange) -> Column:
    """Character n-grams inside word bounds: those of every white-space separated word."""
    return F.flatten(
        F.transform(spaced_words(text), lambda word: padded_ngrams(word, ngram_range))
    )


def char_ngram_totals(df: DataFrame, text: Column, ngram_range: NgramRange) -> DataFrame:
    """(term, n) of the character n-grams of all texts. The n-grams of a word depend on the
    word alone, so words are counted first and spelled out once each."""
    words = gram_rows(df, spaced_words(text)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return (
        gram_rows(words, padded_ngrams(F.col("term"), ngram_range), "n")
        .groupBy("term").agg(F.sum("n").alias("n"))
    )


def gram_rows(df: DataFrame, grams: Column, *keep: str) -> DataFrame:
    """One row per n-gram, as ``term``. The outer form keeps Spark from deriving a
    filter on the array, which would build the array a second time."""
    return df.select(*keep, F.explode_outer(grams).alias("term")).where(
        F.col("term").isNotNull()
    )


def counted_rows(df: DataFrame, grams: str, *keep: str) -> DataFrame:
    """One row per distinct n-gram of a row, as ``term`` with its count ``tf``. ``grams``
    is a column of sorted arrays; a term's count is the length of its run."""
    g = F.col(grams)
    starts = F.filter(
        F.sequence(F.lit(0), F.size(g) - 1),
        lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)),
    )
    runs = df.where(F.size(g) > 0).select(*keep, grams, starts.alias("__starts"))
    s = F.col("__starts")
    ends = F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(g)))
    counts = F.zip_with(
        s, ends, lambda a, b: F.struct(F.get(g, a).alias("term"), (b - a).cast("bigint").alias("tf"))
    )
    return runs.select(*keep, F.inline_outer(counts)).where(F.col("term").isNotNull())


def counted_word_ngrams(
    df: DataFrame, tokens: str, ngram_range: NgramRange, *keep: str
) -> DataFrame:
    """One row per distinct word n-gram of a row, as ``term`` with its count ``tf``. ``tokens``
    is a column of arrays of words; null has no n-grams. Words become numbers, and only
    distinct n-grams are spelled out."""
    counted = [T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    schema = T.StructType([*[df.schema[c] for c in keep], *counted])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            for rows, terms, tf in _count_ngrams(part.column(0), ngram_range, by_row=True):
                kept = [part.column(i + 1).take(rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, terms, tf], schema.names)

    return df.select(tokens, *keep).mapInArrow(count, schema)


def word_ngram_totals(df: DataFrame, tokens: str, ngram_range: NgramRange) -> DataFrame:
    """(term, n) of the word n-grams of all rows, added up over runs of rows before the
    shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            for _rows, terms, n in _count_ngrams(part.column(0), ngram_range, by_row=False):
                yield pa.RecordBatch.from_arrays([terms, n], ["term", "n"])

    counted = df.select(tokens).mapInArrow(count, "term string, n bigint")
    total = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    return counted.groupBy("term").agg(total.alias("n"))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in runs of up to ``TOKENS_AT_A_TIME`` tokens (first column)."""
    for batch in batches:
        ends = np.cumsum(_lengths(batch.column(0)))
        start = 0
        while start < batch.num_rows:
            most = (ends[start - 1] if start else 0) + TOKENS_AT_A_TIME
            stop = max(int(np.searchsorted(ends, most, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(lists: pa.Array) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    return sizes.to_numpy(zero_copy_only=False).astype("int64")


def _count_ngrams(
    lists: pa.Array, ngram_range: NgramRange, by_row: bool
) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(row, n-gram, count) of the distinct n-grams of every list, or of all lists, for each
    length in the range. No n-gram crosses lists."""
    words = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), _lengths(lists))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype("int64")
    many = max(len(coded.dictionary), 1)
    low, high = ngram_range
    for n in range(low, high + 1):
        starts = np.arange(max(len(rows) - n + 1, 0))
        starts = starts[rows[starts] == rows[starts + n - 1]]
        key, size = (rows[starts], len(lists)) if by_row else (np.zeros_like(starts), 1)
        for i in range(n):
            if size * many >= 1 << 62:
                found, key = np.unique(key, return_inverse=True)
                size = max(len(found), 1)
            key, size = key * many + codes[starts + i], size * many
        _keys, first, count = np.unique(key, return_index=True, return_counts=True)
        at = starts[first]
        spelled = [words.take(pa.array(at + i)) for i in range(n)]
        terms = spelled[0] if n == 1 else pc.binary_join_element_wise(*spelled, " ")
        yield pa.array(rows[at]), terms, pa.array(count.astype("int64"))
