"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, filter_audit, hard_negatives, language_id
from . import line_dedup, lz_fingerprint, maxent_lm, mixing, ngram_join, packing, substring_dedup
from .arrays import small_batches

RANKS = "byte_bpe_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_documents(spark, sf_dir), k=3, percent=90)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


#: every control string of the template inside texts
_HARD = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.select("conv_id", "turn", "role", "text")
    hard = [(-7, 0, "user", _HARD), (-7, 1, "assistant", _HARD)]
    formatted = chat_format.format_conversations(
        turns.unionByName(spark.createDataFrame(hard, turns.schema)),
        public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
    )
    ranks = public_tokenizers.path(RANKS)
    return chat_format.read_back(formatted, ranks, public_tokenizers.PATTERN, in_order=True).drop("n_tokens")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_edited(_documents(spark, sf_dir))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(_documents(spark, sf_dir))


#: the vocabulary's free id ends documents
END_OF_TEXT = 50256


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(
        _documents(spark, sf_dir),
        public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
        END_OF_TEXT,
        positions=True,
    )
    return packing.write_packed(packed)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        _documents(spark, sf_dir),
        public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.mine(hard_negatives.integer_vectors(rows))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit_filters(_documents(spark, sf_dir), labels)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_mixing": op2_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_lz_fingerprint": op5_lz_fingerprint,
    "op6_maxent_lm": op6_maxent_lm,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}

_OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha AS text_sha256
FROM d
WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id)
"""

_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON r.a = n.doc_id GROUP BY r.a
"""

_OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head
  FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         CAST(sum(length(head) + length(body) + 15) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars
FROM g
"""

_OP11 = r"""
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

_OP12 = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM t),
first AS (SELECT body, min(doc_id) AS smallest FROM t GROUP BY body),
said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [CAST(len(words) < 200 AS INT), CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT),
          CAST(100 * length(regexp_replace(w.body, '[^A-Z]+', '', 'g')) > 2 * length(w.body) AS INT),
          CAST(regexp_matches(w.body, '[#$%&*|]') AS INT),
          CAST(coalesce(w.doc_id > smallest, false) AS INT)] AS fails
  FROM w LEFT JOIN first ON w.body = first.body LEFT JOIN said ON w.doc_id = said.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, s AS step, filter_order[s] AS x,
         list_transform(range(1, s), lambda i: strpos('ABCDE', filter_order[i])) AS before,
         strpos('ABCDE', filter_order[s]) AS here
  FROM orders, range(1, 6) r(s)),
seen AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, x, n, good, toxic,
         fails[here] = 1 AS failing,
         len(list_filter(before, lambda i: fails[i] = 1)) > 0 AS gone,
         list_sum(fails) AS failed
  FROM cells, steps),
g AS (
  SELECT part, filter_order, step, any_value(x) AS x,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
         coalesce(sum(n) FILTER (failing AND failed = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM g
"""

_OP13 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (keeper IS NOT NULL AND keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
                       FILTER (keeper IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN shared ON k.key = shared.key GROUP BY k.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": _OP1,
    "op3_chat_format": _OP3,
    "op4_exact_dedup": _OP4,
    "op11_hard_negatives": _OP11,
    "op12_filter_audit": _OP12,
    "op13_line_dedup": _OP13,
}
