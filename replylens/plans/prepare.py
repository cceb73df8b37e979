"""From raw tables to pools: the stages every later plan starts from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import pairing as P
from ..operators import splits as S
from ..operators.ranking import positions
from ..session import stage
from ..sources import read_table, spread, support_pairs, write_pools
from ..sources.tables import write_json_report


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pairs of the events table; pair_seq is their row order."""
    pairs = support_pairs(spark, spread(read_table(spark, sf_dir, "events"))).drop("value")
    return pairs.withColumnRenamed("event_id", "pair_seq")


def kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_pairs(event_pairs(spark, sf_dir))


def pooled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept pairs with their pool. The kept pairs are staged once; choosing the
    conversations then reads a single column of the staged table."""
    return S.assign_pools(stage(kept_pairs(spark, sf_dir), "kept"))


@dataclass(frozen=True)
class Pools:
    pooled: DataFrame
    evaluation: DataFrame  # one pair per conversation
    dev: DataFrame
    retrieval: DataFrame

    @classmethod
    def of(cls, pooled: DataFrame) -> Pools:
        def pool(name: str) -> DataFrame:
            return pooled.where(F.col("pool") == name).drop("pool")

        return cls(pooled, S.eval_pool(pooled), pool(S.DEV), pool(S.RETRIEVAL))


def build_pools(spark: SparkSession, sf_dir: str) -> Pools:
    return Pools.of(stage(pooled_pairs(spark, sf_dir), "pooled"))


@dataclass(frozen=True)
class Prepared:
    pools: Pools
    counts: DataFrame  # step, n


def prepare(raw: DataFrame, company: str | None = None, out: str | None = None) -> Prepared:
    """The whole preparation of one's own table of raw transcripts (conversation_id, company,
    conversation [, part]): parse, clean, de-duplicate, split into pools without leakage.

    Rows per step are observed while the steps run, so nothing is read again to be counted:
    one run up to the kept pairs, one over these for the pools. If executors are lost and
    part of a step runs again, its observed number can be too high; the results cannot.
    With ``out``, the pools, the eval pool and the counts are written there.
    """
    spark = raw.sparkSession
    seen = {x: Observation(x) for x in ("raw", "extracted", "kept", "pools", "eval")}
    one = F.count(F.lit(1))
    rows = raw if company is None else raw.where(F.col("company") == company)
    is_first = F.col("part") == 0 if "part" in raw.columns else F.lit(True)
    rows = rows.observe(seen["raw"], F.count_if(is_first).alias("n"))
    extracted = P.clean_and_filter(P.pair_transcripts(rows)).observe(seen["extracted"], one.alias("n"))
    kept = stage(P.keep_transcript_pairs(extracted).observe(seen["kept"], one.alias("n")), "kept")
    numbered = positions(kept, ["conversation_id", "turn"], "pair_seq").drop("turn")
    is_pool = {p: F.count_if(F.col("pool") == p).alias(p) for p in (S.DEV, S.RETRIEVAL)}
    pooled = stage(
        S.assign_pools(numbered).observe(seen["pools"], *is_pool.values()), "pooled"
    )
    pools = Pools.of(pooled)
    evaluation = stage(pools.evaluation.observe(seen["eval"], one.alias("n")), "eval_pool")
    counts = spark.createDataFrame(
        [
            ("raw_conversations", seen["raw"].get["n"]),
            ("extracted_pairs", seen["extracted"].get["n"]),
            ("deduped_pairs", seen["kept"].get["n"]), ("eval_pool", seen["eval"].get["n"]),
            ("dev_pool", seen["pools"].get[S.DEV]),
            ("retrieval_corpus", seen["pools"].get[S.RETRIEVAL]),
        ],
        "step string, n bigint",
    )
    if out:
        write_pools(pooled, f"{out}/pools")
        evaluation.write.mode("overwrite").parquet(f"{out}/eval_pool")
        write_json_report(counts, f"{out}/counts")
    return Prepared(Pools(pooled, evaluation, pools.dev, pools.retrieval), counts)


def stage_counts(raw: DataFrame, kept: DataFrame, pooled: DataFrame) -> DataFrame:
    """(step, n): rows per step from extraction to the pools. Kept pairs are counted
    after de-duplication and the boilerplate filter; the eval pool after keeping one
    pair per conversation. The three pools are counted in one pass."""
    cleaned = P.clean_and_filter(raw)
    one = F.count(F.lit(1)).alias("n")

    def step(name: str, df: DataFrame, count=one) -> DataFrame:
        return df.agg(count).select(F.lit(name).alias("step"), "n")

    is_pool = {p: F.col("pool") == p for p in (S.EVAL, S.DEV, S.RETRIEVAL)}
    pools = pooled.agg(
        F.count_distinct(F.when(is_pool[S.EVAL], F.col("conversation_id"))).alias("eval_pool"),
        F.count_if(is_pool[S.DEV]).alias("dev_pool"),
        F.count_if(is_pool[S.RETRIEVAL]).alias("retrieval_corpus"),
    )
    named = [F.struct(F.lit(c).alias("step"), F.col(c).alias("n")) for c in pools.columns]
    return (
        step("raw_conversations", raw.select("conversation_id"),
             F.count_distinct("conversation_id").alias("n"))
        .unionByName(step("extracted_pairs", cleaned))
        .unionByName(step("deduped_pairs", kept))
        .unionByName(pools.select(F.inline(F.array(*named))))
    )
