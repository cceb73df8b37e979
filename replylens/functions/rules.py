"""Ordered rule sets over message text: the first rule that matches wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]

# The names, the threshold and the patterns below define the labels, so their
# text and their order are part of the results. Matching ignores case.
DEFAULT_INTENT = "other"
NO_ESCALATION = "none"
LOW_CONFIDENCE = "low_retrieval_confidence"
UNCLASSIFIED = "unclassified_intent"
MIN_RETRIEVAL_CONFIDENCE = 0.15
INTENTS = (
    "account_access",
    "billing_subscription",
    "playback_technical",
    "content_availability",
    "feature_request_feedback",
    "other",
)
INTENT_RULES: tuple[Rule, ...] = (
    ("account_access",
     r"\b(log ?in|log ?on|logg?ing (in|out)|logs? (me )?out|password|sign ?up|sign ?in|hacked|"
     r"account.*(stolen|hacked|locked|access)|accessed my account|"
     r"can'?t access|verify my account|reset my (password|account)|email (was )?changed|"
     r"two.factor|2fa|locked out|link my \w+ (to|with) my account|connect(ed)? .*to my account)\b"),
    ("billing_subscription",
     r"\b(premium|subscription|billing|payment|charged|refund|cancell?(ed|ing)?|invoice|price|pricing|"
     r"student (offer|discount|plan)|family (plan|member|package)|free trial|renew|card (declined|not accepting)|"
     r"paid|promo(tional)?( offer| code)?|discount code|\$\d|\d+\.\d\d\b|pesos|DRM|package)\b"),
    ("playback_technical",
     r"\b(crash\w*|bug|not working|won'?t (play|open|load|connect|work)|error|glitch|freeze|"
     r"stop(s|ped|ping)? (working|playing|early)|won'?t (play|connect)|sync(ing)?|offline|"
     r"download(s|ed)? (disappear|delet)|no media control|"
     r"playlists? (disappear|gone|missing)|skip(ping)? (songs?|tracks?)|app (keeps|won'?t)|"
     r"sonos|chromecast|android auto|carplay|update (broke|to)|version \d|"
     r"cache issue|web player|album art|shuffle|ads? (stall|during|stop)|"
     r"lost spotify|reinstall|local librar(y|ies)|landscape mode|black bars)\b"),
    ("content_availability",
     r"\b(can'?t find|not (on|available (on|in)) spotify|missing (from|on) spotify|"
     r"add (this|that) (song|album|artist|track)|"
     r"duplicate (page|album|artist)|catalog|licens(e|ing)|"
     r"available in \w+|spotify in \w+|spotify (blocked|banned)|"
     r"why (isn'?t|is|are).*(on spotify|available)|not letting me listen)\b"),
    ("feature_request_feedback",
     r"\b(wish (you|spotify|had)|would be (nice|cool|great) if|feature request|suggestion|"
     r"please add|you should (add|make)|update the .*playlist|discover weekly|"
     r"i love|thanks for|great (app|job)|you guys rock|it would be cool|"
     r"stop getting|easier way to|is there a way to|any known issues|song limit)\b"),
)

ESCALATION_RULES: tuple[Rule, ...] = (
    ("account_security",
     r"\b(hack\w*|stole\w*|stolen|account.*(hack\w*|stolen|compromised)|"
     r"email (was )?changed.*(not me|didn'?t|without)|unauthorized|fraud|"
     r"(accessed|logged in to|got into) my account|"
     r"changed (the |my )?(account )?email.*(recognize|not mine|wasn'?t me))\b"),
    ("billing_dispute",
     r"\b(refund|charged (twice|again|wrong)|dispute|unauthorized (charge|payment)|"
     r"cancel my (subscription|account)|billing error)\b"),
    ("explicit_human_request",
     r"\b(speak to (a|someone)|talk to (a|someone)|human|real person|manager|"
     r"escalate|representative)\b"),
    ("high_distress",
     r"(!{3,}|\?{3,})|\b(furious|disgusted|lawsuit|lawyer|legal action)\b"),
)

KEYWORD_RULES: tuple[Rule, ...] = (
    ("account_access", r"\b(login|log in|password|sign up|account)\b"),
    ("billing_subscription", r"\b(premium|subscription|charge|billing|refund|cancel)\b"),
    ("playback_technical", r"\b(crash|bug|error|not working|won'?t play|stopped)\b"),
    ("content_availability", r"\b(not available|can'?t find|missing|catalog)\b"),
    ("feature_request_feedback", r"\b(wish|suggestion|please add|feature)\b"),
)
# End of fixed values.

# i: ignore case; U: Unicode character classes; d: only \n ends a line.
_FLAGS = "(?iUd)"


def matches(text: Column, pattern: str) -> Column:
    """Does the pattern occur anywhere in the text? Null text matches nothing."""
    return F.coalesce(text.rlike(_FLAGS + pattern), F.lit(False))


def first_match(
    text: Column, rules: Sequence[Rule], default: Column | str
) -> Column:
    """Name of the first matching rule. ``CASE WHEN`` stops at the first hit, so
    later patterns are not evaluated for that row."""
    chain = None
    for name, pattern in rules:
        hit = matches(text, pattern)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    default = default if isinstance(default, Column) else F.lit(default)
    return default if chain is None else chain.otherwise(default)


def all_matches(text: Column, rules: Sequence[Rule]) -> Column:
    """Names of all matching rules, in rule order."""
    return F.array_compact(
        F.array(*[F.when(matches(text, p), F.lit(name)) for name, p in rules])
    )


def classify_intent(text: Column) -> Column:
    return first_match(text, INTENT_RULES, DEFAULT_INTENT)


def keyword_intent(text: Column) -> Column:
    return first_match(text, KEYWORD_RULES, DEFAULT_INTENT)


def escalation_reason(
    text: Column,
    intent: Column,
    confidence: Column | None = None,
    min_confidence: float = MIN_RETRIEVAL_CONFIDENCE,
) -> Column:
    """Why a message goes to a human: message rules, then a weak retrieval score
    (skipped where it is null or not given), then an unclassified intent."""
    rest = F.when(intent == DEFAULT_INTENT, F.lit(UNCLASSIFIED)).otherwise(
        F.lit(NO_ESCALATION)
    )
    if confidence is not None:
        rest = F.when(
            F.round(confidence, 6) < min_confidence, F.lit(LOW_CONFIDENCE)
        ).otherwise(rest)
    return first_match(text, ESCALATION_RULES, rest)


def keyword_escalation_reason(text: Column) -> Column:
    """Only the three explicit message rules; no distress and no score signal."""
    return first_match(text, ESCALATION_RULES[:3], NO_ESCALATION)
