"""Draft replies, escalation decisions, baselines and prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from .retrieval import RetrievalIndex, evidence_arrays, retrieve

MIN_EVIDENCE = 0.12
INSUFFICIENT = "insufficient_evidence"

# What a baseline can say without reading a message: where it went, and the one fact that
# desk asks for first. No result depends on the wording.
DESKS = {
    "account_access": ("sign-in", "the address you registered with"),
    "billing_subscription": ("payments", "the date and amount on your statement"),
    "playback_technical": ("apps and devices", "what you did just before it happened"),
    "content_availability": ("catalogue", "the title and your country"),
    "feature_request_feedback": ("ideas", "what you would use it for"),
    "other": ("general", "what you expected to happen"),
}
CANNED_REPLIES = {
    intent: f"Routed to: {desk} desk. Needed from you: {fact}."
    for intent, (desk, fact) in DESKS.items()
}


def top_similarity(evidence: Column) -> Column:
    return F.coalesce(F.get(evidence, F.lit(0))["similarity"], F.lit(0.0))


def is_grounded(evidence: Column, min_evidence: float = MIN_EVIDENCE) -> Column:
    return F.round(top_similarity(evidence), 6) >= min_evidence


def extractive_reply(evidence: Column, min_evidence: float = MIN_EVIDENCE) -> Column:
    """Best historical reply without its sign-off; null where evidence is weak."""
    best = F.get(evidence, F.lit(0))["support_reply"]
    return F.when(is_grounded(evidence, min_evidence), X.strip_sign_off(best))


def decide(
    scored: DataFrame,
    min_evidence: float = MIN_EVIDENCE,
    min_confidence: float = R.MIN_RETRIEVAL_CONFIDENCE,
) -> DataFrame:
    """Add draft_reply, grounded, escalate and escalation_reason to rows that have
    customer_msg, intent and evidence."""
    grounded = is_grounded(F.col("evidence"), min_evidence)
    reason = R.escalation_reason(
        F.col("customer_msg"), F.col("intent"), top_similarity(F.col("evidence")), min_confidence
    )
    return (
        scored.withColumn("draft_reply", extractive_reply(F.col("evidence"), min_evidence))
        .withColumn("grounded", grounded)
        .withColumn("first_reason", reason)
        .withColumn(
            "escalation_reason",
            F.when(
                (F.col("first_reason") == R.NO_ESCALATION) & ~F.col("grounded"),
                F.lit(INSUFFICIENT),
            ).otherwise(F.col("first_reason")),
        )
        .drop("first_reason")
        .withColumn("escalate", F.col("escalation_reason") != R.NO_ESCALATION)
    )


def with_evidence(
    messages: DataFrame, index: RetrievalIndex, k: int = 3
) -> DataFrame:
    """Add ``evidence``; messages without any hit get an empty array."""
    evidence = evidence_arrays(retrieve(messages, index, k))
    joined = messages.join(evidence, "customer_msg", "left")
    empty = F.array().cast(evidence.schema["evidence"].dataType)
    return joined.withColumn("evidence", F.coalesce("evidence", empty))


def score_messages(
    messages: DataFrame, index: RetrievalIndex, k: int = 3, **thresholds: float
) -> DataFrame:
    """Decision record per message: needs customer_msg and intent columns (intent from
    a model or from rules); other columns pass through."""
    return decide(with_evidence(messages, index, k), **thresholds)


def canned_reply(intent: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CANNED_REPLIES.items() for x in pair])
    return table[intent]


def majority_intent(labelled: DataFrame, label: str = "intent_label") -> Column:
    """Most frequent label as a scalar subquery; ties go to the lower name."""
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(1).select(label).scalar()


def trivial_baseline(messages: DataFrame, majority: Column) -> DataFrame:
    """Majority intent, canned reply, never escalates."""
    return messages.withColumn("intent", majority).withColumns(
        {
            "draft_reply": canned_reply(F.col("intent")),
            "escalate": F.lit(False),
            "escalation_reason": F.lit(R.NO_ESCALATION),
        }
    )


def keyword_baseline(messages: DataFrame) -> DataFrame:
    """Blunt keyword intent, canned reply, explicit escalation rules only."""
    text = F.col("customer_msg")
    return (
        messages.withColumn("intent", R.keyword_intent(text))
        .withColumn("draft_reply", canned_reply(F.col("intent")))
        .withColumn("escalation_reason", R.keyword_escalation_reason(text))
        .withColumn("escalate", F.col("escalation_reason") != R.NO_ESCALATION)
    )


# Fixed value: written into every golden row.
LABEL_METHOD = "rule_based_v1"
# End of fixed value.


def build_golden_set(eval_pool: DataFrame) -> DataFrame:
    """Rule labels on the eval pool; no retrieval score takes part."""
    text = F.col("customer_msg")
    return (
        eval_pool.withColumn("intent_label", R.classify_intent(text))
        .withColumn("escalation_reason", R.escalation_reason(text, F.col("intent_label")))
        .withColumn("should_escalate", F.col("escalation_reason") != R.NO_ESCALATION)
        .withColumn("label_method", F.lit(LABEL_METHOD))
    )


# Prompt texts are sections: a heading in capitals, then one item a line.
REPLY_RULES = (
    "Output the next message of the support side, nothing else.",
    "A statement is allowed if a numbered precedent makes it.",
    "Output HANDOVER if no precedent is about the same problem.",
)
REVIEW_DIMENSIONS = (
    "answers the question asked", "says only what the past replies support",
    "leaves no step out", "is polite and brief",
)


def _section(heading: str, body: Column) -> Column:
    return F.concat(F.lit(heading + "\n"), body, F.lit("\n"))


def _numbered(evidence: Column, fields: tuple[str, ...]) -> Column:
    """``[1] .. => ..`` a line, in rank order."""
    items = F.transform(
        evidence,
        lambda e, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "),
            F.concat_ws(" => ", *[e[f] for f in fields]),
        ),
    )
    return F.array_join(items, "\n")


def reply_prompt(
    message: Column, evidence: Column, min_evidence: float = MIN_EVIDENCE
) -> Column:
    """Prompt text for an external writer; null where evidence is too weak."""
    prompt = F.concat(
        _section("PRECEDENTS", _numbered(evidence, ("customer_msg", "support_reply"))),
        _section("MESSAGE", message),
        _section("RULES", F.lit("\n".join(REPLY_RULES))),
    )
    return F.when(is_grounded(evidence, min_evidence), prompt)


def review_prompt(message: Column, reply: Column, evidence: Column) -> Column:
    """Prompt text for an external rater of a drafted reply."""
    return F.concat(
        _section("PRECEDENTS", _numbered(evidence, ("support_reply",))),
        _section("MESSAGE", message),
        _section("REPLY", F.coalesce(reply, F.lit(""))),
        _section("SCORES 1-5", F.lit("\n".join(f"{d}: ?" for d in REVIEW_DIMENSIONS))),
    )
