"""(customer message, support reply) pairs from turns, de-duplicated and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import require_columns
from ..session import stage

MIN_MESSAGE, MIN_REPLY = 15, 10
# Replies too generic to ground an answer on.
BOILERPLATE_REPLIES = (
    "thanks for reaching out.", "we're here to help.", "hi there!",
)
# End of fixed values.


def clean_and_filter(
    pairs: DataFrame, min_message: int = MIN_MESSAGE, min_reply: int = MIN_REPLY
) -> DataFrame:
    """Clean both texts, then keep pairs that are long enough after cleaning.

    The length test sits inside a generator: as a plain filter it would be pushed below
    the cleaning, and every text would be cleaned twice. The same goes for the filter
    Spark derives from a generator's input, hence the outer form here and elsewhere.
    """
    others = [c for c in pairs.columns if c not in ("customer_msg", "support_reply")]
    cleaned = F.struct(
        X.clean_text(F.col("customer_msg")).alias("customer_msg"),
        X.clean_text(F.col("support_reply")).alias("support_reply"),
    )
    long_enough = F.filter(
        F.array(cleaned),
        lambda p: (F.length(p["customer_msg"]) >= min_message)
        & (F.length(p["support_reply"]) >= min_reply),
    )
    rows = pairs.select(*others, F.inline_outer(long_enough))
    return rows.where(F.col("customer_msg").isNotNull()).select(*pairs.columns)


def drop_boilerplate(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.lower("support_reply").isin(*BOILERPLATE_REPLIES))


def transcript_facts(raw: DataFrame) -> DataFrame:
    """One row per conversation, however many parts its transcript came in:
    (conversation_id, company, n_chars, replied, turns)."""
    require_columns(raw, "conversation_id", "company", "conversation")
    text = F.col("conversation")
    parts = raw.select(
        "conversation_id",
        "company",
        F.length(text).cast("bigint").alias("n_chars"),
        X.has_support_reply(text).alias("replied"),
        X.turn_count(text).cast("bigint").alias("turns"),
    )
    return parts.groupBy("conversation_id", "company").agg(
        # line feeds join the parts
        (F.sum("n_chars") + F.count(F.lit(1)) - 1).alias("n_chars"),
        F.bool_or("replied").alias("replied"),
        F.sum("turns").alias("turns"),
    )


def _kept_before(turns: DataFrame) -> DataFrame:
    """``turns`` (conversation_id, part, turns) with ``before``: the number of kept turns
    in earlier parts. They are written once; numbering reads their sizes alone, and only
    conversations with a second part are numbered."""
    turns = stage(turns.withColumn("kept", F.size("turns")), "turns")
    sizes = turns.select("conversation_id", "part", "kept")
    cut = sizes.where(F.col("part") > 0).select("conversation_id").distinct()
    earlier = Window.partitionBy("conversation_id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        sizes.join(cut, "conversation_id", "left_semi")
        .withColumn("before", F.coalesce(F.sum("kept").over(earlier), F.lit(0)))
        .drop("kept")
    )
    return turns.drop("kept").join(before, ["conversation_id", "part"], "left").withColumn(
        "before", F.coalesce("before", F.lit(0))
    )


def _parsed(raw: DataFrame) -> DataFrame:
    require_columns(raw, "conversation_id", "conversation")
    parts = "part" in raw.columns
    turns = raw.select(
        "conversation_id",
        (F.col("part") if parts else F.lit(0).cast("bigint")).alias("part"),
        X.transcript_turns(F.col("conversation")).alias("turns"),
    )
    return _kept_before(turns) if parts else turns.withColumn("before", F.lit(0).cast("bigint"))


def parse_transcripts(raw: DataFrame) -> DataFrame:
    """One row per kept turn: (conversation_id, part, turn, role, text). Turn numbers go
    on from part to part."""
    return _parsed(raw).select(
        "conversation_id", "part", "before", F.posexplode_outer("turns").alias("place", "t")
    ).where(F.col("place").isNotNull()).select(
        "conversation_id", "part", (F.col("before") + F.col("place")).alias("turn"),
        "t.role", "t.text",
    )


def pair_transcripts(raw: DataFrame) -> DataFrame:
    """Raw pairs of a customer turn with the support turn right after it.

    Neighbours are matched inside the transcript's own row, so nothing is shuffled.
    Only where a long conversation came in several parts are the last turn of one
    part and the first turn of the next joined, one narrow row per part.
    """
    parts = "part" in raw.columns
    turns = _parsed(raw)
    count = F.greatest(F.size("turns") - 1, F.lit(0))
    neighbours = F.arrays_zip(
        F.slice("turns", F.lit(1), count).alias("a"), F.slice("turns", F.lit(2), count).alias("b")
    )
    inside = turns.select(
        "conversation_id", "part", "before", F.posexplode_outer(neighbours).alias("place", "p")
    ).where(F.col("place").isNotNull()).select(
        "conversation_id", "part", (F.col("before") + F.col("place")).alias("turn"), "p.a", "p.b"
    )
    if parts:
        inside = inside.unionByName(_across_parts(turns))
    return inside.where(
        (F.col("a.role") == "Customer") & (F.col("b.role") == "Support")
    ).select(
        "conversation_id", "part", F.col("turn").cast("bigint").alias("turn"),
        F.col("a.text").alias("customer_msg"), F.col("b.text").alias("support_reply"),
    )


def _across_parts(turns: DataFrame) -> DataFrame:
    turns = turns.where(F.size("turns") > 0)
    firsts = turns.select(
        "conversation_id", F.col("part").alias("next_part"), F.get("turns", F.lit(0)).alias("b")
    ).where(F.col("next_part") > 0)
    by_part = Window.partitionBy("conversation_id").orderBy("next_part")
    firsts = firsts.withColumn("part", F.coalesce(F.lag("next_part").over(by_part), F.lit(0)))
    lasts = turns.select(
        "conversation_id", "part", (F.col("before") + F.size("turns") - 1).alias("turn"),
        F.element_at("turns", -1).alias("a"),
    ).where(F.col("a.role") == "Customer")
    return lasts.join(firsts.drop("next_part"), ["conversation_id", "part"])


def pair_turns(
    turns: DataFrame, customer: str = "user", support: str = "assistant", block: int = 4096
) -> DataFrame:
    """The same pairing from one row per turn (conv_id, turn >= 0, role, text).

    Turns of other roles are removed first, as unmatched transcript lines are. The
    next turn is looked up inside blocks of ``block`` turn numbers, so one huge
    conversation is spread over many tasks; the first turn of every later block is
    joined to the end of the block before it. Ordinary conversations fit in block 0
    and cost one shuffle.
    """
    require_columns(turns, "conv_id", "turn", "role", "text")
    kept = turns.where(F.col("role").isin(customer, support)).withColumn(
        "block", F.floor(F.col("turn") / block).cast("bigint")
    )
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn")
    reply = F.struct("role", "text")
    looked = kept.select(
        "conv_id", "block", "turn", "role", "text",
        F.lead(reply).over(in_block).alias("next"),
        F.row_number().over(in_block).alias("place"),
    )
    by_block = Window.partitionBy("conv_id").orderBy("head_block")
    heads = looked.where((F.col("place") == 1) & (F.col("block") > 0)).select(
        "conv_id", F.col("block").alias("head_block"), reply.alias("head")
    )
    heads = heads.select(
        "conv_id", "head",
        F.coalesce(F.lag("head_block").over(by_block), F.lit(0)).alias("block"),
    )
    following = F.coalesce(F.col("next"), F.col("head"))
    return (
        looked.where(F.col("role") == customer)
        .join(heads, ["conv_id", "block"], "left")
        .where(following["role"] == support)
        .select(
            F.col("conv_id").alias("conversation_id"), "turn",
            F.col("text").alias("customer_msg"), following["text"].alias("support_reply"),
        )
    )


def deduplicate(pairs: DataFrame, order: str = "pair_seq") -> DataFrame:
    """One row per (message, reply): the one with the lowest ``order``. Copies are
    merged before the shuffle, so a text repeated everywhere costs one row a task."""
    carried = [c for c in pairs.columns if c not in ("customer_msg", "support_reply", order)]
    return pairs.groupBy("customer_msg", "support_reply").agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in carried]
    )


def first_per_conversation(pairs: DataFrame, order: str = "pair_seq") -> DataFrame:
    """First non-null value of every column per conversation, in ``order``."""
    carried = [c for c in pairs.columns if c != "conversation_id"]
    first = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in carried
    ]
    return pairs.groupBy("conversation_id").agg(*first).select(*pairs.columns)


def with_pair_id(pairs: DataFrame, position: Column | None = None) -> DataFrame:
    position = F.col("pair_seq") if position is None else position
    return pairs.withColumn("pair_id", X.stable_pair_id(F.col("conversation_id"), position))


def keep_pairs(pairs: DataFrame) -> DataFrame:
    """Clean, length filter, de-duplicate, boilerplate filter, ids."""
    kept = drop_boilerplate(deduplicate(clean_and_filter(pairs)))
    return with_pair_id(kept).select(
        "pair_id", "conversation_id", "pair_seq", "customer_msg", "support_reply"
    )


def keep_transcript_pairs(pairs: DataFrame) -> DataFrame:
    """``keep_pairs`` for cleaned pairs of transcripts (conversation_id, turn, texts): of
    equal pairs the first conversation and turn stays; pair_seq is left to the caller."""
    ordered = pairs.select(
        "conversation_id", "turn", "customer_msg", "support_reply",
        F.struct("conversation_id", "turn").alias("pair_seq"),
    )
    kept = drop_boilerplate(deduplicate(ordered)).drop("pair_seq")
    return with_pair_id(kept, F.col("turn")).select(
        "pair_id", "conversation_id", "turn", "customer_msg", "support_reply"
    )
