"""One gram table for many feature settings over the same texts.

Texts are tokenised once, for the widest ranges wanted. Character n-grams depend on the
word alone, so they are spelled out once per distinct word and joined to the words'
counts. A gram carries its kind and size; a narrower setting is a selection of rows, and
its document frequencies are those already counted.

Documents can belong to several nested training sets at once (``copies`` holds one number
per set, 0 where the document is not in it): frequencies of all sets are counted in the
same pass. Documents in no set get vectors only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ngrams as N
from ..functions.text import SPACES_PATTERN
from ..session import stage
from ..sources.tables import spread
from .models import FittedFeatures, vector_table
from .ranking import positions
from .tfidf import Features, weigh

WORD, CHAR, RAW = "w:", "c:", "r:"


@dataclass(frozen=True)
class GramTable:
    docs: DataFrame  # doc_id, copies (array, one number per training set) and others
    counts: DataFrame  # doc_id, term (with prefix), size, tf
    frequencies: DataFrame  # term, size, df (array, one number per training set)


def widest(settings: Iterable[Features]) -> Features:
    """The smallest ranges that hold all of ``settings``."""
    settings = list(settings)
    chars = [f.char for f in settings if f.char]
    return Features(
        (min(f.word[0] for f in settings), max(f.word[1] for f in settings)),
        (min(c[0] for c in chars), max(c[1] for c in chars)) if chars else None,
    )


def gram_table(docs: DataFrame, features: Features, text: str = "customer_msg") -> GramTable:
    """Grams of ``docs`` (doc_id unique, copies, text). Null texts have no grams."""
    tokens = N.word_tokens(F.col(text))
    tagged = [F.transform(N.word_ngrams(F.col("__tokens"), features.word), lambda g: F.concat(F.lit(WORD), g))]
    if features.char:
        words = F.filter(F.split(F.lower(text), SPACES_PATTERN), lambda w: w != "")
        tagged.append(F.transform(words, lambda w: F.concat(F.lit(RAW), w)))
    tokenised = spread(docs.select("doc_id", text)).select("doc_id", text, tokens.alias("__tokens"))
    rows = tokenised.select("doc_id", F.sort_array(F.concat(*tagged)).alias("__grams"))
    found = stage(N.counted_rows(rows, "__grams", "doc_id"), "words")
    size = F.length("term") - F.length(F.translate("term", " ", "")) + 1
    counts = found.where(F.col("term").startswith(WORD)).select(
        "doc_id", "term", size.cast("int").alias("size"), "tf"
    )
    if features.char:
        counts = counts.unionByName(_char_counts(found.where(F.col("term").startswith(RAW)), features))
    counts = stage(counts, "grams")
    n_sets = F.size("copies")
    df = counts.join(docs.select("doc_id", "copies"), "doc_id").where(
        F.exists("copies", lambda n: n > 0)
    )
    # a long row per set would multiply the grams; sums by place in the array do not
    sets = docs.select(F.max(n_sets)).first()[0] or 1
    sums = [F.sum(F.col("copies")[i]).alias(f"d{i}") for i in range(sets)]
    frequencies = df.groupBy("term", "size").agg(*sums).select(
        "term", "size", F.array(*[f"d{i}" for i in range(sets)]).alias("df")
    )
    return GramTable(docs, counts, stage(frequencies, "frequencies"))


def _char_counts(words: DataFrame, features: Features) -> DataFrame:
    """(doc_id, term, size, tf) from word counts, through a dictionary of distinct words."""
    word = F.substring("term", 3, 1 << 30)
    dictionary = words.select("term").distinct().select(
        "term", F.sort_array(N.char_ngrams(word, features.char)).alias("__grams")
    )
    spelled = N.counted_rows(
        dictionary.withColumnRenamed("term", "word"), "__grams", "word"
    ).withColumnRenamed("tf", "times")
    spelled = stage(spelled, "dictionary").withColumnRenamed("term", "gram")
    return (
        words.withColumnRenamed("term", "word").join(spelled, "word")
        .groupBy("doc_id", "gram").agg(F.sum(F.col("tf") * F.col("times")).alias("tf"))
        .select(
            "doc_id", F.concat(F.lit(CHAR), F.col("gram")).alias("term"),
            F.length("gram").cast("int").alias("size"), "tf",
        )
    )


def selected(features: Features) -> Column:
    """Whether a gram belongs to a setting. A padded word shorter than the smallest n is
    one gram; only whole padded words start and end with a blank."""
    is_word = F.col("term").startswith(WORD) & F.col("size").between(*features.word)
    if not features.char:
        return is_word
    low, high = features.char
    whole = F.col("term").startswith(CHAR + " ") & F.col("term").endswith(" ") & (F.col("size") < low)
    is_char = F.col("term").startswith(CHAR) & (F.col("size").between(low, high) | whole)
    return is_word | is_char


def fit_grams(grams: GramTable, features: Features, training_set: int = 0) -> FittedFeatures:
    """The vocabulary of one setting on one training set, from frequencies alone."""
    n = F.lit(training_set)
    n_docs = grams.docs.agg(F.sum(F.get("copies", n)).cast("double").alias("n")).scalar()
    df = F.get("df", n)
    term = F.col("term") if features.char else F.substring("term", 3, 1 << 30)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0
    # a term of no document of this set is none of its terms, whatever min_df says
    known = grams.frequencies.where(selected(features) & (df >= max(features.min_df, 1)))
    vocab = known.select(term.alias("term"), idf.alias("idf"))
    placed = positions(vocab, ["term"], "index").withColumn("index", F.col("index").cast("int"))
    indexed = stage(placed, "indexed_vocab")
    return FittedFeatures(features, indexed, max(indexed.count(), 1))


def vectors(grams: GramTable, fitted: FittedFeatures) -> DataFrame:
    """All documents of the table with ``features``, staged."""
    features = fitted.features
    counts = grams.counts.where(selected(features))
    if not features.char:
        counts = counts.withColumn("term", F.substring("term", 3, 1 << 30))
    weights = weigh(counts, fitted.vocab, features.blocks, "doc_id", carry=("index",))
    return vector_table(grams.docs, weights, fitted.size)
