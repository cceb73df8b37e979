import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from replylens import schemas
from replylens.operators import decide as D
from replylens.operators import judge as J
from replylens.operators import retrieval as RT
from replylens.operators.tfidf import Features
from replylens.plans.catalog import QUERIES
from replylens.plans.prepare import build_pools
from replylens.session import stage


def grams(text):
    words, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum() or ch == "_":
            word += ch
        else:
            if len(word) > 1:
                words.append(word)
            word = ""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(queries, corpus, k, min_df=2):
    """corpus: (pair_seq, text). Top k (pair_seq, similarity) per query."""
    df = Counter(t for _s, text in corpus for t in set(grams(text)))
    idf = {t: math.log((1 + len(corpus)) / (1 + n)) + 1 for t, n in df.items() if n >= min_df}

    def vector(text):
        tf = Counter(t for t in grams(text) if t in idf)
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in tf.items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / size for t, w in raw.items()}

    vectors = {text: vector(text) for _s, text in corpus}
    out = {}
    for q in queries:
        qv = vector(q)
        sims = [
            (round(sum(w * vectors[text].get(t, 0) for t, w in qv.items()), 6), seq)
            for seq, text in corpus
        ]
        ranked = sorted((-s, seq) for s, seq in sims if s > 0)[:k]
        out[q] = [(seq, -s) for s, seq in ranked]
    return out


@pytest.fixture(scope="module")
def pools(spark, sf):
    return build_pools(spark, sf)


@pytest.fixture(scope="module")
def corpus(pools):
    # a third of the corpus is one message, to exercise the handling of copies
    base = pools.retrieval
    copies = base.limit(1).select(
        "conversation_id", "customer_msg", "support_reply",
        F.explode(F.expr("sequence(5000L, 5199L)")).alias("pair_seq"),
    ).withColumn("pair_id", F.concat(F.lit("copy"), F.col("pair_seq")))
    return stage(base.unionByName(copies), "test_corpus")


@pytest.fixture(scope="module")
def index(corpus):
    return RT.build_index(corpus)


@pytest.fixture(scope="module")
def expected(pools, corpus):
    rows = [(r.pair_seq, r.customer_msg) for r in corpus.collect()]
    texts = sorted({r.customer_msg for r in pools.pooled.select("customer_msg").collect()})
    return brute_force(texts, rows, 3)


@pytest.mark.parametrize("blocks, heads", [(16, 32), (1, 1), (3, 2), (10_000, 4)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_retrieval_is_exact(spark, pools, corpus, expected, monkeypatch, blocks, heads, broadcast):
    monkeypatch.setattr(RT, "BLOCK_MESSAGES", blocks)
    monkeypatch.setattr(RT, "HEAD_POSTINGS", heads)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = RT.build_index(corpus)
        rows = RT.retrieve(pools.pooled.select("customer_msg"), index, 3).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.customer_msg, []).append((r.pair_seq, r.similarity))
    wanted = {q: hits for q, hits in expected.items() if hits}
    assert got.keys() == wanted.keys()
    for q, hits in wanted.items():
        assert [s for s, _ in got[q]] == [s for s, _ in hits], q
        assert [v for _, v in got[q]] == pytest.approx([v for _, v in hits], abs=2e-6)


def test_candidates_are_few(spark, pools, index):
    texts = pools.pooled.groupBy("customer_msg").agg(F.md5("customer_msg").alias("text_id"))
    terms = stage(RT.query_vectors(texts, index, "text_id", "customer_msg"), "terms")
    per_text = RT.pair_scores(terms, index, 3).groupBy("text_id").count()
    assert per_text.agg(F.avg("count")).first()[0] < index.messages.count() / 3


def test_term_join_reads_the_index_in_place(spark, pools, index):
    """No shuffle between the stored postings and the join by term."""
    texts = pools.pooled.groupBy("customer_msg").agg(F.md5("customer_msg").alias("text_id"))
    terms = stage(RT.query_vectors(texts, index, "text_id", "customer_msg"), "terms")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = RT.pair_scores(terms, index, 3)
        plan = scores._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "_vectors" in line]
    assert scans and "Bucketed: true" in plan[scans[0]]
    for i in scans:  # the operators above the scan, up to the join
        depth, above = plan[i].index("- "), []
        while not above or "Join" not in above[-1]:
            i -= 1
            if plan[i].index("- ") < depth:
                depth = plan[i].index("- ")
                above.append(plan[i])
        assert not any("Exchange" in line for line in above)


def test_index_round_trip_and_self_match(spark, pools, corpus, tmp_path):
    RT.build_index(corpus, path=str(tmp_path / "index"))
    index = RT.load_index(spark, str(tmp_path / "index"), Features())
    best = RT.retrieve(corpus, index, 1).select("similarity").distinct().collect()
    assert [r.similarity for r in best] == [1.0]


def test_unknown_words_have_no_evidence(spark, index):
    q = spark.createDataFrame([("qqq zzz", "other")], "customer_msg string, intent string")
    [row] = D.score_messages(q, index).collect()
    assert (row.evidence, row.draft_reply, row.grounded) == ([], None, False)
    assert row.escalation_reason == "low_retrieval_confidence"


def scored(spark, similarity, reply="Try restarting the app now. /AB", intent="playback_technical"):
    evidence = [] if similarity is None else [("x", reply, similarity)]
    schema = f"customer_msg string, intent string, evidence {schemas.EVIDENCE.simpleString()}"
    return spark.createDataFrame([("the sound is off", intent, evidence)], schema)


@pytest.mark.parametrize(
    "similarity, thresholds, reply, reason",
    [
        (0.5, {}, "Try restarting the app now.", "none"),
        (0.12, {}, "Try restarting the app now.", "low_retrieval_confidence"),
        (0.01, {}, None, "low_retrieval_confidence"),
        (None, {}, None, "low_retrieval_confidence"),
        # with the thresholds the other way round the last branch is reached
        (0.17, {"min_evidence": 0.2, "min_confidence": 0.15}, None, "insufficient_evidence"),
    ],
)
def test_decisions(spark, similarity, thresholds, reply, reason):
    [row] = D.decide(scored(spark, similarity), **thresholds).collect()
    assert (row.draft_reply, row.grounded) == (reply, reply is not None)
    assert (row.escalation_reason, row.escalate) == (reason, reason != "none")


def test_judge(spark):
    good = D.decide(scored(spark, 0.9, "please restart the app and then sign in once more with it ^AB"))
    weak = D.decide(scored(spark, None))
    rows = J.judge_replies(good.unionByName(weak)).orderBy("grounded_score").collect()
    assert [r.grounded_score for r in rows] == [0, 1]
    assert [r.length_ok for r in rows] == [False, True]
    assert rows[0].overlap_score == 0.0 and rows[0].unsupported_claims == []
    [total] = J.judge_summary(J.judge_replies(good.unionByName(weak))).collect()
    assert (total.n, total.grounded_count, total.length_ok_count) == (2, 1, 1)


def test_prompts(spark):
    df = scored(spark, 0.9).withColumn("r", F.lit("ok"))
    e, m = F.col("evidence"), F.col("customer_msg")
    [row] = df.select(D.reply_prompt(m, e), D.review_prompt(m, F.col("r"), e)).collect()
    assert "the sound is off" in row[0] and "Try restarting" in row[0] and "REPLY\nok\n" in row[1]
    assert scored(spark, 0.01).select(D.reply_prompt(m, e)).first()[0] is None


def test_every_message_is_searched(spark, sf, pools):
    index = RT.build_index(pools.retrieval)
    whole = RT.retrieve(pools.pooled, index).select("customer_msg", "rank", "pair_id", "similarity")
    got = QUERIES["e4_topk_all_messages"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole.collect()))
    # no message that shares a term with the index is left out
    known = RT.query_vectors(
        pools.pooled.select("customer_msg").distinct(), index, "customer_msg", "customer_msg"
    )
    texts = {r.customer_msg for r in known.select("customer_msg").distinct().collect()}
    assert texts and {r.customer_msg for r in got} == texts
