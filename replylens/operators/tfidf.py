"""TF-IDF as relations: one row per (document, term).

Weight = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per document
and block. A document is one row; its terms are counted inside the row, so no text is
shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ngrams as N
from ..session import stage
from ..sources.tables import spread


@dataclass(frozen=True)
class Features:
    """N-gram ranges of the word block and, optionally, the character block."""

    word: N.NgramRange = (1, 2)
    char: N.NgramRange | None = None
    min_df: int = 2

    @property
    def blocks(self) -> int:
        return 2 if self.char else 1


def term_counts(
    docs: DataFrame, features: Features, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, term, tf) of documents, one row each. With two blocks, terms carry the prefix
    ``w:`` or ``c:``."""
    # One row is one document, so its terms are counted inside the row and no text is
    # shuffled. Tokens and sorted n-grams form steps of their own, computed once a row.
    tokens = N.word_tokens(F.col(text_col))
    tokenised = spread(docs.select(id_col, text_col)).select(
        id_col, text_col, tokens.alias("__tokens")
    )
    if not features.char:
        return N.counted_word_ngrams(tokenised, "__tokens", features.word, id_col)
    grams: Column = N.word_ngrams(F.col("__tokens"), features.word)
    chars = N.char_ngrams(F.col(text_col), features.char)
    grams = F.concat(
        F.transform(grams, lambda g: F.concat(F.lit("w:"), g)),
        F.transform(chars, lambda g: F.concat(F.lit("c:"), g)),
    )
    grammed = tokenised.select(id_col, F.sort_array(grams).alias("__grams"))
    return N.counted_rows(grammed, "__grams", id_col)


def vocabulary(
    counts: DataFrame, n_docs: Column, min_df: int = 2, copies: Column | None = None
) -> DataFrame:
    """(term, df, postings, idf) for terms in at least ``min_df`` documents.

    ``copies`` is the number of identical documents a row stands for. ``n_docs`` is a
    literal or a scalar subquery. Counts are merged before the shuffle, so a term in
    a third of all documents is no hot spot.
    """
    copies = F.lit(1) if copies is None else copies
    return (
        counts.groupBy("term")
        .agg(F.sum(copies).alias("df"), F.count(F.lit(1)).alias("postings"))
        .where(F.col("df") >= min_df)
        .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)
    )


def weigh(
    counts: DataFrame, vocab: DataFrame, blocks: int = 1, id_col: str = "doc_id",
    carry: tuple[str, ...] = (), keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, term, weight [, columns of the vocabulary and of the counts]) with unit length
    per (id, block).

    Terms outside the vocabulary vanish before the length is taken; a document with
    no known term has no row, that is, it is the zero vector.
    """
    keys = [id_col] if blocks == 1 else [id_col, "block"]
    raw = _with_vocabulary(counts, vocab, id_col, carry).withColumn(
        "raw", (1.0 + F.log("tf")) * F.col("idf")
    )
    if blocks > 1:
        raw = raw.withColumn("block", F.substring("term", 1, 2))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return raw.withColumn("weight", F.col("raw") / norm).select(
        id_col, "term", "weight", *carry, *keep
    )


#: a term in more than this share of all postings is joined by broadcast
HEAD_SHARE = 1e-4


def _with_vocabulary(
    counts: DataFrame, vocab: DataFrame, id_col: str, carry: tuple[str, ...]
) -> DataFrame:
    """``counts`` with the vocabulary's columns, without a hot key.

    Terms with more than ``HEAD_SHARE`` of the postings number at most 1 / ``HEAD_SHARE``,
    so they are broadcast whatever the vocabulary's size. What is left has no term of many
    rows and is joined by term; rows that are settled go along dealt by their document.
    """
    columns = list(dict.fromkeys(["idf", *carry]))
    if "postings" not in vocab.columns:
        return counts.join(vocab.select("term", *columns), "term")
    total = vocab.agg(F.sum("postings").cast("double").alias("n")).scalar()
    facts = F.struct(*columns)
    is_head = F.col("postings") > F.lit(HEAD_SHARE) * total
    head = F.broadcast(vocab.where(is_head).select("term", facts.alias("__head")))
    tail = vocab.where(~is_head).select(F.col("term").alias("__key"), facts.alias("__tail"))
    # no term holds a line feed, so a settled row meets nothing
    settled = F.concat(F.lit("\n"), F.col(id_col).cast("string"))
    known = F.coalesce("__head", "__tail")
    return (
        counts.join(head, "term", "left")
        .withColumn("__key", F.when(F.col("__head").isNull(), F.col("term")).otherwise(settled))
        .join(tail, "__key", "left")
        .withColumn("__facts", known)
        .where(F.col("__facts").isNotNull())
        .select(*counts.columns, "__facts.*")
    )


def document_norms(raw: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Vector length per document from un-normalised (id, term, raw) rows."""
    return raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))


def fit_transform(
    docs: DataFrame, features: Features, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights) of a document table.

    The vocabulary is staged, so the planner knows its size: a small one is broadcast
    and the term counts stay where they are, a large one is joined by term.
    """
    counts = stage(term_counts(docs, features, id_col, text_col), "term_counts")
    n_docs = docs.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    vocab = stage(vocabulary(counts, n_docs, features.min_df), "vocab")
    return vocab, weigh(counts, vocab, features.blocks, id_col)


# --- without a vocabulary ---------------------------------------------------------------

def _hashed(bits: int) -> Column:
    if not 1 <= bits <= 30:
        raise ValueError("bits must lie between 1 and 30")
    digits = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digits, F.lit(1 << bits)).cast("int")


def hashed_weights(
    counts: DataFrame, bits: int = 20, id_col: str = "doc_id"
) -> DataFrame:
    """(id, index, weight) of signed feature hashing: a term goes to one of 2 ** bits
    indexes and adds or takes away 1 + ln tf there, so that terms that share an index cancel
    on average. Unit length per id; a document whose terms all cancel has no row.

    There is no vocabulary, no document frequency and no pass over the corpus: a model's
    memory is classes x 2 ** bits numbers whatever the corpus holds. Index and sign are
    digits of the term's md5, so they are the same in every engine.
    """
    sign = F.when(F.substring(F.md5("term"), 9, 1) < "8", 1.0).otherwise(-1.0)
    sums = (
        counts.groupBy(id_col, _hashed(bits).alias("index"))
        .agg(F.sum(sign * (1.0 + F.log("tf"))).alias("raw"))
        .where(F.abs("raw") > 1e-12)
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return sums.select(id_col, "index", (F.col("raw") / norm).alias("weight"))


def hash_collisions(counts: DataFrame, bits: int = 20) -> DataFrame:
    """(terms, indexes, shared): distinct terms, indexes they use, terms that share one."""
    per_index = counts.select("term").distinct().groupBy(_hashed(bits).alias("index")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_index.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count(F.lit(1)).alias("indexes"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared"),
    )
