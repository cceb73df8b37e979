"""Everything once, in order: pools, model, index, decisions, metrics, reply checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import judge as J
from ..operators import models as ML
from ..operators import retrieval as RT
from ..operators.models import Learner
from ..operators.tfidf import Features
from ..session import stage
from ..sources.tables import write_json_report
from . import evaluation as EV
from . import experiments as EX
from .prepare import Pools, build_pools


@dataclass(frozen=True)
class FullRun:
    model: ML.IntentModel
    index: RT.RetrievalIndex
    scored: DataFrame  # decision records of the golden set
    metrics: DataFrame  # one row per system
    judge: DataFrame  # reply checks, one row
    grounded_share: float


def run_pools(
    pools: Pools, features: Features = ML.FINAL_FEATURES, learner: Learner = Learner(),
    out: str | None = None,
) -> FullRun:
    """Model, index, decisions, metrics and reply checks on given pools. With ``out``, the
    golden set, the predictions of all systems, the nested report and the reply checks are
    written there."""
    golden = stage(D.build_golden_set(pools.evaluation), "golden")
    model = ML.fit_intent_model(ML.training_pool(pools.pooled), features, learner)
    index = RT.build_index(pools.retrieval)
    messages = ML.predict(model, golden.drop("escalation_reason"))
    scored = stage(D.score_messages(messages, index), "scored")
    majority = D.majority_intent(EX.labelled(pools.dev))
    predictions = stage(EV.three_systems(golden, scored, majority), "predictions")
    judged = stage(J.judge_replies(scored), "judged")
    summary = J.judge_summary(judged)
    grounded = scored.agg(F.coalesce(F.avg(F.col("grounded").cast("int")), F.lit(0.0))).first()[0]
    if out:
        golden.write.mode("overwrite").parquet(f"{out}/golden")
        predictions.write.mode("overwrite").parquet(f"{out}/predictions")
        write_json_report(EV.nested_report(predictions), f"{out}/report")
        write_json_report(
            summary.withColumn("grounded_share", F.lit(grounded)), f"{out}/reply_checks"
        )
    return FullRun(model, index, scored, EV.system_metrics(predictions), summary, grounded)


def full_run(
    spark: SparkSession, sf_dir: str, features: Features = ML.FINAL_FEATURES,
    learner: Learner = Learner(), out: str | None = None,
) -> FullRun:
    """``run_pools`` on the pools of the events table."""
    return run_pools(build_pools(spark, sf_dir), features, learner, out)
