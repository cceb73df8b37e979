"""Top-k cosine retrieval over historical pairs, as an exact sparse join with bounds.

Identical corpus messages are scored once (with their number of copies in the document
frequencies) and expanded at the end; identical queries likewise. So are messages that differ
only in terms outside the vocabulary: their vectors are equal, and however many there are,
they are one entry of the index, under the smallest msg_id.

The index is laid out by term. Messages that share their weightiest terms lie together in
blocks of bounded size; for every (term, block) the largest weight is kept. A query

1. gets a floor: the best score that k pairs reach by the heaviest postings of its terms
   (``heads``). No message below the floor can be among the k best.
2. takes its terms in falling order of what they can add at most. The terms from some place
   on cannot reach the floor together, so a message worth looking at holds one of the
   terms before, and only these look up blocks: rare ones all of theirs, the others only
   those whose largest weight is a share of the term's largest that a block without rare
   terms must reach in one of them. Blocks whose largest weights can reach the floor are opened.
3. scores the messages of the open blocks exactly.

Nothing is left out: a floor is a score that k pairs reach, and every bound is the sum
of largest weights. Queries with fewer than k candidates have no floor and open all blocks
they share a term with. Terms in very many messages are spread over their blocks.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import side_by_side, stage, stage_root
from .ranking import positions, top_per_group
from .tfidf import Features, term_counts, vocabulary, weigh

DIGITS = 6
#: messages of a block, postings of a term among its heads, postings of a bucket of files
BLOCK_MESSAGES, HEAD_POSTINGS, BUCKET_POSTINGS = 16, 32, 1_000_000
#: a term of at most so many messages looks up all of its blocks
RARE_POSTINGS = 16
SIGNATURE_TERMS = 4
MIN_BUCKETS = 8
#: tables that the term joins read, and the columns that place a row in a bucket
_LAYOUT = {
    "vectors": ("term", "block"), "tops": ("term",), "heads": ("term",), "vocab": ("term",),
}


@dataclass(frozen=True)
class RetrievalIndex:
    vocab: DataFrame  # term, df, postings, idf, peak (largest weight)
    vectors: DataFrame  # term, block, msg_id (of the first message of that vector), weight
    tops: DataFrame  # term, block, peak
    heads: DataFrame  # term, msg_id, weight, pairs (of that vector)
    messages: DataFrame  # msg_id, customer_msg, copies, vector_id (a msg_id of vectors), block
    corpus: DataFrame  # msg_id, vector_id, pair_seq, pair_id, support_reply
    features: Features = Features()


def build_index(
    corpus: DataFrame, features: Features = Features(), path: str | None = None
) -> RetrievalIndex:
    """Fit and write the index tables; ``path`` defaults to a new stage folder.

    ``corpus`` has pair_id, pair_seq, customer_msg, support_reply.
    """
    spark = corpus.sparkSession
    if path is None:
        path = f"{stage_root(spark)}/{uuid.uuid4().hex}/index"
    messages = stage(
        corpus.groupBy("customer_msg")
        .agg(F.min("pair_seq").alias("msg_id"), F.count(F.lit(1)).alias("copies"))
        .select("msg_id", "customer_msg", "copies"),
        "messages",
    )
    counts = stage(term_counts(messages, features, "msg_id", "customer_msg"), "term_counts")
    n_docs = messages.agg(F.sum("copies").cast("double").alias("n")).scalar()
    weighted = counts.join(messages.select("msg_id", "copies"), "msg_id")
    vocab = stage(vocabulary(weighted, n_docs, features.min_df, F.col("copies")), "vocab")
    carried = ("idf", "postings")
    weights = stage(weigh(counts, vocab, features.blocks, "msg_id", carried, ("tf",)), "weights")
    firsts = stage(_first_of_equals(weights, messages), "firsts")
    messages = messages.join(firsts, "msg_id", "left")
    pairs = corpus.join(messages.select("msg_id", "vector_id", "customer_msg"), "customer_msg").select(
        "msg_id", "vector_id", "pair_seq", "pair_id", "support_reply"
    )
    distinct = firsts.where(F.col("msg_id") == F.col("vector_id")).select("msg_id")
    weights = stage(weights.join(distinct, "msg_id").drop("tf"), "distinct_weights")
    buckets = max(MIN_BUCKETS, math.ceil(weights.count() / BUCKET_POSTINGS))  # from the footers

    blocks = _blocks(weights)
    vectors = weights.join(blocks, "msg_id").select("term", "block", "msg_id", "weight")
    in_blocks = blocks.withColumnRenamed("msg_id", "vector_id")
    with_blocks = messages.join(in_blocks, "vector_id", "left").select(*messages.columns, "block")

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}")

    side_by_side(
        spark,
        [
            lambda: _write_bucketed(vectors, path, "vectors", buckets),
            lambda: write(with_blocks, "messages"), lambda: write(pairs, "corpus"),
            lambda: _write_facts(spark, path, {"buckets": buckets}),
        ],
    )
    vectors = spark.table(_table_name(path, "vectors"))
    tops = vectors.groupBy("term", "block").agg(F.max("weight").alias("peak"))
    peaks = vectors.groupBy("term").agg(F.max("weight").alias("peak"))
    heaviest = [F.col("weight").desc(), F.col("msg_id")]
    heads = top_per_group(vectors.drop("block"), ["term"], heaviest, HEAD_POSTINGS).drop("rank")
    sizes = messages.groupBy(F.col("vector_id").alias("msg_id")).agg(F.sum("copies").alias("pairs"))
    heads = heads.join(sizes, "msg_id").select("term", "msg_id", "weight", "pairs")
    side_by_side(
        spark,
        [
            lambda: _write_bucketed(tops, path, "tops", buckets),
            lambda: _write_bucketed(heads, path, "heads", buckets),
            lambda: _write_bucketed(vocab.join(peaks, "term"), path, "vocab", buckets),
        ],
    )
    return load_index(spark, path, features)


def _first_of_equals(weights: DataFrame, messages: DataFrame) -> DataFrame:
    """(msg_id, vector_id): the smallest msg_id with the same terms as often. Messages
    without a known term have no row."""
    entry = F.concat_ws("\n", "term", F.col("tf").cast("string"))  # no term holds a line feed
    same = F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "\n"))
    digests = stage(weights.groupBy("msg_id").agg(same.alias("same")), "digests")
    first = digests.groupBy("same").agg(F.min("msg_id").alias("vector_id"))
    return digests.join(first, "same").select("msg_id", "vector_id")


def _blocks(weights: DataFrame) -> DataFrame:
    """(msg_id, block). Blocks are neighbours in the order of the terms that make messages
    alike: heavy ones that are not rare. Equals follow each other by weight, so that a
    block's largest weights are near those of all its messages."""
    pull = F.col("weight") * F.col("idf") * F.sqrt("postings")
    entry = F.struct((-pull).alias("pull"), "term", "weight")
    pulls = F.slice(F.array_sort(F.collect_list(entry)), 1, SIGNATURE_TERMS)
    signatures = weights.groupBy("msg_id").agg(pulls.alias("p")).select(
        "msg_id", F.col("p.term").alias("signature"), F.col("p.weight")[0].alias("weight")
    )
    return positions(signatures, ["signature", "weight", "msg_id"]).select(
        "msg_id", F.floor(F.col("position") / BLOCK_MESSAGES).cast("int").alias("block")
    )


def _write_facts(spark: SparkSession, path: str, facts: dict[str, int]) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/facts")


def _table_name(path: str, name: str) -> str:
    return f"replylens_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}_{name}"


def _write_bucketed(df: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """Write one file per bucket, sorted by term, and return it as a table whose layout the
    planner knows, so that joins on its keys read it in place."""
    keys, spark = _LAYOUT[name], df.sparkSession
    table = _table_name(path, name)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    # the shuffle deals rows as the buckets do, so a task writes one file
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(
        *keys
    ).option("path", f"{path}/{name}").format("parquet").saveAsTable(table)
    return spark.table(table)


def load_index(
    spark: SparkSession, path: str, features: Features = Features()
) -> RetrievalIndex:
    """An index written before, also by another session: its bucketed tables are declared
    to the planner again."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    tables = {}
    for name, keys in _LAYOUT.items():
        table, columns = _table_name(path, name), ", ".join(keys)
        if not spark.catalog.tableExists(table):
            schema = spark.read.parquet(f"{path}/{name}").schema
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(
                f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({columns}) "
                f"SORTED BY ({columns}) INTO {facts['buckets']} BUCKETS LOCATION '{path}/{name}'"
            )
        tables[name] = spark.table(table)
    for name in ("messages", "corpus"):
        tables[name] = spark.read.parquet(f"{path}/{name}")
    return RetrievalIndex(features=features, **tables)


def query_vectors(
    texts: DataFrame, index: RetrievalIndex, id_col: str, text_col: str
) -> DataFrame:
    """(id, term, wq, peak, postings) of query texts under the index vocabulary."""
    counts = term_counts(texts, index.features, id_col, text_col)
    return weigh(
        counts, index.vocab, index.features.blocks, id_col, carry=("peak", "postings")
    ).withColumnRenamed("weight", "wq")


#: scores are compared after rounding
_MARGIN = 2 * 10.0**-DIGITS


def open_blocks(terms: DataFrame, index: RetrievalIndex, k: int) -> DataFrame:
    """(text_id, block, term, wq): the blocks that can hold one of a query's k best
    messages, with the query's terms that occur there.

    ``terms`` has text_id, term, wq, peak, postings.
    """
    # A text's few terms become many messages, so texts are dealt once to a fixed number of
    # partitions; all that follows is done per text and stays there.
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = terms.repartition(parts, "text_id")
    head = terms.join(index.heads, "term").select(
        "text_id", "msg_id", (F.col("wq") * F.col("weight")).alias("score"), "pairs"
    )
    sums = head.groupBy("text_id", "msg_id").agg(
        F.sum("score").alias("score"), F.first("pairs").alias("pairs")
    )
    heaviest = [F.col("score").desc(), F.col("msg_id")]
    best = top_per_group(sums, ["text_id"], heaviest, k)
    so_far = F.sum("pairs").over(Window.partitionBy("text_id").orderBy("rank"))
    enough = best.withColumn("enough", so_far >= k)
    reached = F.max(F.when(F.col("enough"), F.col("score")))
    floors = enough.groupBy("text_id").agg(
        F.coalesce(reached - _MARGIN, F.lit(0.0)).alias("floor")
    )
    most = F.col("wq") * F.col("peak")
    falling = Window.partitionBy("text_id").orderBy(most.desc(), "term")
    onwards = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("text_id")
    spare = F.max(F.when(~F.col("reaches"), F.col("rest"))).over(whole)
    # A block without rare terms needs the floor less the spare from the others that look up
    # blocks, so in one of them it has this share of the term's largest weight.
    others = F.sum(F.when(~F.col("rare"), most)).over(whole)
    share = (F.col("floor") - F.col("spare")) / others * (1 - 1e-9)
    needed = (
        terms.withColumn("rest", F.sum(most).over(onwards))
        .join(floors, "text_id")  # every term has a head, so every text has a floor
        .withColumn("reaches", F.col("rest") >= F.col("floor"))
        .withColumn("spare", F.coalesce(spare, F.lit(0.0)))
        .where("reaches")
        .withColumn("rare", F.col("postings") <= RARE_POSTINGS)
        .withColumn("least", F.when(F.col("rare"), 0.0).otherwise(share * F.col("peak")))
        .select("text_id", "term", "floor", "least")
    )
    tops = index.tops.select("term", "block", F.col("peak").alias("top"))
    opened = (
        needed.join(tops, "term")
        .where(F.col("top") >= F.col("least"))
        .select("text_id", "block", "floor")
        .distinct()
    )
    in_block = Window.partitionBy("text_id", "block")
    return (
        opened.join(terms.select("text_id", "term", "wq"), "text_id")
        .join(index.tops, ["term", "block"])
        .withColumn("most", F.sum(most).over(in_block))
        .where(F.col("most") >= F.col("floor"))
        .select("text_id", "block", "term", "wq")
    )


def pair_scores(terms: DataFrame, index: RetrievalIndex, k: int) -> DataFrame:
    """(text_id, msg_id, score) of all messages that can be in a query's top k."""
    opened = open_blocks(terms, index, k).join(index.vectors, ["term", "block"])
    return _sum(
        opened.select("text_id", "msg_id", (F.col("wq") * F.col("weight")).alias("score"))
    )


def _sum(products: DataFrame) -> DataFrame:
    return products.groupBy("text_id", "msg_id").agg(F.sum("score").alias("score"))


def best_messages(
    texts: DataFrame, index: RetrievalIndex, k: int = 3
) -> DataFrame:
    """(text_id, msg_id, similarity) of the distinct corpus vectors that hold the k best
    pairs, at most k."""
    terms = stage(query_vectors(texts, index, "text_id", "customer_msg"), "query_terms")
    scores = pair_scores(terms, index, k).select(
        "text_id", "msg_id", F.round("score", DIGITS).alias("similarity")
    )
    order = [F.col("similarity").desc(), F.col("msg_id")]
    return top_per_group(scores.where("similarity > 0"), ["text_id"], order, k).drop("rank")


def retrieve(
    queries: DataFrame, index: RetrievalIndex, k: int = 3
) -> DataFrame:
    """k most similar historical pairs of every distinct query text.

    ``queries`` needs customer_msg. Returns customer_msg, rank, pair_id, pair_seq,
    evidence_msg, support_reply, similarity; ranked by (similarity desc, pair_seq).
    Only positive similarities count, so a query may have fewer than k rows.
    """
    texts = queries.select("customer_msg").distinct()
    texts = stage(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts")
    hits = stage(best_messages(texts, index, k), "hits")
    hits = hits.withColumnRenamed("msg_id", "vector_id")
    found = index.corpus.join(hits.select("vector_id").distinct(), "vector_id", "left_semi")
    # any pair in the final top k is among the first k pairs of one of the k vectors
    copies = top_per_group(found, ["vector_id"], [F.col("pair_seq")], k, "copy").drop("copy")
    rows = (
        hits.join(copies, "vector_id")
        .join(
            index.messages.select("msg_id", F.col("customer_msg").alias("evidence_msg")), "msg_id"
        )
    )
    ranked = top_per_group(
        rows, ["text_id"], [F.col("similarity").desc(), F.col("pair_seq")], k
    )
    return ranked.join(texts, "text_id").select(
        "customer_msg", "rank", "pair_id", "pair_seq", "evidence_msg", "support_reply",
        "similarity",
    )


def evidence_arrays(hits: DataFrame) -> DataFrame:
    """(customer_msg, evidence) with the at most k hits of a text in rank order."""
    item = F.struct(
        "rank",
        F.struct(
            F.col("evidence_msg").alias("customer_msg"), "support_reply", "similarity"
        ).alias("item"),
    )
    ordered = F.array_sort(F.collect_list(item))
    return hits.groupBy("customer_msg").agg(
        F.transform(ordered, lambda x: x["item"]).alias("evidence")
    )
