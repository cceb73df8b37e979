import hashlib
import random

import pytest
from pyspark.sql import functions as F

from replylens.operators import pairing as P
from replylens.operators import profile as PF
from replylens.operators import ranking as RK
from replylens.operators import splits as S
from replylens.plans.prepare import build_pools, kept_pairs
from replylens.sources.views import transcripts


def random_turns(seed=1):
    rng, rows = random.Random(seed), []
    for conv in range(12):
        turn = 0
        for _ in range(rng.choice([1, 3, 40])):
            turn += rng.choice([1, 1, 1, 9])
            role = rng.choice(["user", "user", "assistant", "system"])
            rows.append((conv, turn, role, f"{role} says {conv}-{turn}"))
    return rows


def brute_pairs(rows):
    out = set()
    for conv in {r[0] for r in rows}:
        kept = [r for r in sorted(rows) if r[0] == conv and r[2] in ("user", "assistant")]
        for a, b in zip(kept, kept[1:]):
            if a[2] == "user" and b[2] == "assistant":
                out.add((conv, a[1], a[3], b[3]))
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_pair_turns_is_the_same_for_every_block_size(spark, block):
    rows = random_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in P.pair_turns(df, block=block).collect()}
    assert got == brute_pairs(rows)


@pytest.mark.parametrize("size", [2, 7, 4096])
def test_pair_transcripts_across_parts(spark, size):
    from replylens.sources import transcripts

    rows = random_turns(2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {
        (int(r.conversation_id), r.customer_msg, r.support_reply)
        for r in P.pair_transcripts(transcripts(df, size)).collect()
    }
    assert got == {(c, m, s) for c, _t, m, s in brute_pairs(rows)}


def test_filters_and_dedupe(spark):
    rows = [
        (5, 1, "the app is broken again", "please restart it"),
        (3, 2, "the  app is broken again", "please restart it"),
        (4, 2, "too short", "please restart it"),
        (6, 2, "the app is broken again", "Hi there! @x"),
    ]
    df = spark.createDataFrame(
        rows, "pair_seq long, conversation_id long, customer_msg string, support_reply string"
    )
    kept = P.keep_pairs(df).collect()
    assert [(r.pair_seq, r.conversation_id) for r in kept] == [(3, 2)]
    assert kept[0].pair_id == "p_" + hashlib.md5(b"2:3").hexdigest()


def test_first_per_conversation_skips_nulls(spark):
    df = spark.createDataFrame(
        [(1, 10, None, "b"), (1, 11, "m", "c"), (2, 5, "x", "y")],
        "conversation_id long, pair_seq long, customer_msg string, support_reply string",
    )
    rows = {r.conversation_id: tuple(r) for r in P.first_per_conversation(df).collect()}
    assert rows == {1: (1, 10, "m", "b"), 2: (2, 5, "x", "y")}


def test_pools_are_disjoint_and_complete(spark, sf):
    pools = build_pools(spark, sf)
    assert {r.shared for r in S.shared_conversations(pools.pooled).collect()} == {0}
    counts = {r["pool"]: r["count"] for r in pools.pooled.groupBy("pool").count().collect()}
    assert counts == {"eval": 38, "dev": 41, "retrieval": 388}
    ids = [r[0] for r in pools.evaluation.select("conversation_id").collect()]
    assert len(ids) == len(set(ids)) == 20


def test_empty_input_gives_empty_pools(spark, sf):
    empty = kept_pairs(spark, sf).where(F.lit(False))
    assert S.assign_pools(empty).count() == 0


def seeded(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


def test_ranks_samples_and_dense_ids(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, "hot").otherwise("cold"))
    want = sorted(range(500), key=seeded)
    ranked = RK.seeded_rank(df, "id").orderBy("rank").collect()
    assert [r["id"] for r in ranked] == want and [r["rank"] for r in ranked] == list(range(1, 501))
    by = RK.seeded_rank(df, "id", by=["g"], total="n").where("g = 'hot'").orderBy("rank").collect()
    assert [r["id"] for r in by] == [i for i in want if i < 400] and by[0]["n"] == 400
    sample = RK.sample_per_group(df, "g", "id", 30, salts=4).where("g = 'hot'").collect()
    assert {r["id"] for r in sample} == set([i for i in want if i < 400][:30])
    skewed = spark.range(300).select((F.col("id") * F.col("id") * 7 + 3).alias("k"))
    ids = RK.dense_ids(skewed, "k", "sp_%06d").orderBy("k").collect()
    assert [r.row_id for r in ids] == [f"sp_{i:06d}" for i in range(300)]


def test_stratified_split_and_prefixes(spark):
    df = spark.range(103).withColumn("g", (F.col("id") % 3 == 0).cast("string"))
    split = S.stratified_split(df, "g", "id").collect()
    for g in ("true", "false"):
        rows = [r["id"] for r in split if r["g"] == g]
        test = {r["id"] for r in split if r["g"] == g and r["split"] == "test"}
        assert test == set(sorted(rows, key=seeded)[: round(0.2 * len(rows))])
    marked = S.with_prefix_share(df, "id", (0.1, 0.5, 1.0)).collect()
    order = sorted(range(103), key=seeded)
    assert {r["id"] for r in marked if r["prefix_share"] <= 0.5} == set(order[:51])
    assert {r["id"] for r in marked if r["prefix_share"] == 0.1} == set(order[:10])


def test_brand_profile_parts_add_up(spark):
    rows = [
        ("1", "a", 0, "Customer: x\nSupport: y"), ("1", "a", 1, "Customer: z"),
        ("2", "a", 0, "Customer: hello hello"),
    ]
    raw = spark.createDataFrame(
        rows, "conversation_id string, company string, part long, conversation string"
    )
    [row] = PF.brand_profile(raw, ["a", "none"]).collect()
    assert (row.n_conversations, row.pct_with_support_reply, row.avg_turns) == (2, 50.0, 2.0)
    # words: customer: x support: y customer: z customer: hello hello
    assert row.vocab_diversity == round(6 / 9, 4)


@pytest.mark.parametrize("turns_per_row", [2, 3, 4096])
def test_transcript_results_do_not_depend_on_parts(spark, sf, turns_per_row):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    whole, cut = transcripts(turns), transcripts(turns, turns_per_row)

    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    assert rows(P.transcript_facts(cut)) == rows(P.transcript_facts(whole))
    assert rows(P.parse_transcripts(cut).drop("part")) == rows(P.parse_transcripts(whole).drop("part"))
    assert rows(P.pair_transcripts(cut).drop("part")) == rows(P.pair_transcripts(whole).drop("part"))


def test_building_a_query_runs_no_job_over_the_table(spark, sf):
    """Only jobs of schema reading are allowed before an action."""
    from replylens.plans.catalog import QUERIES

    tracker = spark.sparkContext.statusTracker()
    context = spark.sparkContext
    for name in ("b1_brand_filter", "c1_clean_documents", "b3_min_length", "c5_intent_rules"):
        context.setJobGroup(f"build {name}", name)
        QUERIES[name](spark, sf)
        stages = [s for j in tracker.getJobIdsForGroup(f"build {name}") for s in tracker.getJobInfo(j).stageIds]
        assert len(stages) <= 1, name
    context.setLocalProperty("spark.jobGroup.id", None)


def test_transcripts_in_parts_are_parsed_once(spark, sf):
    """Turns of transcripts that come in parts are written once; numbering and pairing read
    the written table, not the transcripts."""
    from replylens.plans.catalog import QUERIES

    for name in ("c2_transcript_lines", "d1_pairs_from_transcripts", "d3_pairs_per_conversation"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "/turns]" in plan and "conversations.parquet" not in plan, name
