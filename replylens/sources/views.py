"""Views over the driver tables that have the shape of support data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import require_columns

_SUPPORT_PAIRS = """
SELECT event_id, user_id, ts, value,
  CAST(FLOOR(event_id / 3.0) AS BIGINT) AS conversation_id,
  CASE event_type
    WHEN 'error' THEN CASE k % 5
      WHEN 0 THEN 'The app keeps crashing on my speaker number ' || ks || ' after the update'
      WHEN 1 THEN 'Shuffle is not working on device ' || ks || '!!! please fix it'
      WHEN 2 THEN 'My premium download stopped playing on version ' || ks
      WHEN 3 THEN 'Somebody has been hacking my profile number ' || ks
      ELSE 'The page ' || ks || ' looks strange on my phone today' END
    WHEN 'purchase' THEN CASE k % 4
      WHEN 0 THEN 'I was charged twice for premium order ' || ks || ', please refund me'
      WHEN 1 THEN 'How much is the family plan in region ' || ks
      WHEN 2 THEN 'My card was charged USD ' || ks || ' for order ' || us
      ELSE 'I want to speak to a manager about order ' || ks END
    WHEN 'signup' THEN CASE k % 4
      WHEN 0 THEN 'I forgot my password and cannot sign in to profile ' || ks
      WHEN 1 THEN 'Someone accessed my account and changed my email ' || ks
      WHEN 2 THEN 'I am locked out since day ' || ks || ' @support' || ks
      ELSE 'Hello there is anybody awake at desk ' || ks END
    WHEN 'view' THEN CASE k % 3
      WHEN 0 THEN 'I can' || chr(39) || 't find album number ' || ks || ' in the library'
      WHEN 1 THEN 'Why is track ' || ks || ' not available in Norway https://x.example/' || ks
      ELSE 'Is song ' || ks || ' missing from the list' END
    ELSE CASE k % 3
      WHEN 0 THEN 'I wish you had folders for list ' || ks
      WHEN 1 THEN 'It would be cool to see chart ' || ks
      ELSE 'Thanks for list number ' || ks || ', great job' END
  END AS customer_msg,
  CASE event_type
    WHEN 'error' THEN 'Sorry to hear that! Please restart the app and reinstall version ' || ks || ' /AB'
    WHEN 'purchase' THEN 'We can look into that within 24 hours, a refund of $' || ks || ' may apply. ^CC'
    WHEN 'signup' THEN 'Please reset your password using the link we just sent to you /MT.'
    WHEN 'view' THEN 'Availability depends on licensing and about ' || ks || '% of tracks vary by region'
    ELSE 'Thanks for the feedback!' END AS support_reply
FROM (SELECT event_id, user_id, ts, value, event_type,
             CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
             regexp_extract(props, '[0-9]+', 0) AS ks,
             CAST(user_id AS VARCHAR(20)) AS us
      FROM {events}) e
"""


def support_pairs_sql(events: str = "events") -> str:
    """The view text; it reads the same in Spark SQL and in ANSI engines."""
    return _SUPPORT_PAIRS.replace("{events}", events)


def support_pairs(spark: SparkSession, events: DataFrame) -> DataFrame:
    """One (customer_msg, support_reply) row per event. Works on streams too."""
    require_columns(events, "event_id", "user_id", "ts", "event_type", "props")
    return spark.sql(_SUPPORT_PAIRS, events=events)


_ROLE_PREFIX = {"user": "Customer", "assistant": "Support", "system": "System"}


def transcripts(turns: DataFrame, turns_per_row: int = 4096) -> DataFrame:
    """Turn rows as newline-joined transcripts.

    A conversation of up to ``turns_per_row`` turns is one row (``part`` 0). Longer
    ones are cut by turn number into several parts, so that a conversation holding a
    large share of the table never gathers in one task or one cell.
    """
    prefix = F.coalesce(
        *[F.when(F.col("role") == r, F.lit(p)) for r, p in _ROLE_PREFIX.items()]
    )
    line = F.concat(prefix, F.lit(": "), F.col("text"))
    part = F.floor(F.col("turn") / turns_per_row).cast("bigint").alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id", part).agg(ordered.alias("lines")).select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.concat(F.lit("brand_"), (F.col("conv_id") % 5).cast("string")).alias("company"),
        "part",
        F.array_join(F.col("lines.line"), "\n").alias("conversation"),
    )
