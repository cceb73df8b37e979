"""Shared grams, hashing, vocabulary joins, running totals, sketches and preparation."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from replylens.operators import grams as G
from replylens.operators import metrics as M
from replylens.operators import models as ML
from replylens.operators import profile as PF
from replylens.operators import ranking as RK
from replylens.operators import tfidf as TF
from replylens.operators.models import Learner
from replylens.operators.tfidf import Features
from replylens.plans import experiments as EX
from replylens.plans.full import run_pools
from replylens.plans.prepare import build_pools, prepare
from replylens.session import reused_stages, stage
from replylens.sources import transcripts

TEXTS = [
    "I cannot log in, my password a is wrong", "Password reset a does not work", None, "", " a ",
    "refund my card please", "the card was charged twice, refund", "Ünïcode wörds play no müsic",
    "play play play the song", "my song a song",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", t, [1 + i % 3, i % 2]) for i, t in enumerate(TEXTS)]
    return stage(
        spark.createDataFrame(rows, "doc_id string, customer_msg string, copies array<bigint>"), "docs"
    )


@pytest.mark.parametrize("training_set", [0, 1])
def test_shared_grams_equal_separate_fits(spark, docs, training_set):
    settings = [f for _n, f in EX.FEATURE_GRID]
    grams = G.gram_table(docs, G.widest(settings))
    mine = F.get("copies", F.lit(training_set))
    for features in settings:
        fitted = G.fit_grams(grams, features, training_set)
        train = docs.withColumn("copies", mine).where("copies > 0")
        alone = ML.fit_features(stage(train, "train"), features)

        def vocabulary(f):
            return sorted((r.term, round(r.idf, 9), r["index"]) for r in f.vocab.collect())

        assert vocabulary(fitted) == vocabulary(alone)
        plain = docs.select("doc_id", "customer_msg")
        both = [G.vectors(grams, fitted), ML.vectorise(plain, alone)]
        first, second = ({r.doc_id: r.features for r in t.collect()} for t in both)
        assert first.keys() == second.keys()
        for doc_id, vector in first.items():
            assert vector.indices.tolist() == second[doc_id].indices.tolist()
            assert vector.values == pytest.approx(second[doc_id].values)


def test_one_scan_serves_all_settings(spark, docs):
    """The texts are tokenised in one place; the rest reads stage tables."""
    grams = G.gram_table(docs, G.widest([f for _n, f in EX.FEATURE_GRID]))
    for table in (grams.counts, grams.frequencies):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and "customer_msg" not in plan


def test_vocabulary_join_without_a_hot_key(spark, monkeypatch):
    """A term of every document never reaches the join by term."""
    rows = [(i, t, 1) for i in range(300) for t in ("everywhere", f"t{i % 90}", f"u{i // 2}")]
    counts = stage(spark.createDataFrame(rows, "doc_id int, term string, tf bigint").repartition(6), "c")
    vocab = stage(TF.vocabulary(counts, F.lit(300.0), 2), "v")
    plain = counts.join(vocab.select("term", "idf"), "term")
    expected = sorted((r.doc_id, r.term, r.idf) for r in plain.collect())
    monkeypatch.setattr(TF, "HEAD_SHARE", 0.01)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = TF._with_vocabulary(counts, vocab, "doc_id", ())
        assert sorted((r.doc_id, r.term, r.idf) for r in joined.collect()) == expected
        keys = joined.groupBy(F.spark_partition_id()).count().collect()
        assert joined.columns == ["doc_id", "term", "tf", "idf"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sizes = sorted(r["count"] for r in keys)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2] + 50


def test_own_class_weights(spark):
    """Raising a class in its own fit moves its margin, not that of the others."""
    rng = random.Random(1)
    words = {"a": "alpha apple", "b": "beta bread", "c": "gamma grape"}
    rows = [
        (" ".join(rng.choices((words[k] + " noise filler").split(), k=5)), k)
        for k, n in (("a", 60), ("b", 25), ("c", 6)) for _ in range(n)
    ]
    messages = spark.createDataFrame(rows, "customer_msg string, intent_label string")
    features = Features((1, 1), None, 1)
    fits = [
        ML.fit_intent_model(messages, features, Learner("svc", 1.0, balanced))
        for balanced in (False, True)
    ]
    for model in fits:
        assert len(model.classifier.models) == 3 and ML.solver_steps(model.classifier) > 0
    plain, raised = ([m.intercept for m in f.classifier.models] for f in fits)
    assert raised[2] >= plain[2]  # the rare class is found more often


def test_final_features_reach_their_bound(spark, sf):
    pools = build_pools(spark, sf)
    for model in (
        ML.fit_intent_model(ML.training_pool(pools.pooled)),
        ML.fit_intent_model(ML.training_pool(pools.pooled), EX.WORD_CHAR, EX.BASE_LEARNER, hash_bits=14),
    ):
        scored = ML.predict(model, EX.labelled(pools.evaluation))
        [row] = M.summary(M.label_counts(scored, "intent_label", "intent")).collect()
        assert row.n == 20 and row.macro_f1 >= 0.8


def test_hashed_model_reloads(spark, sf, tmp_path):
    pools = build_pools(spark, sf)
    model = ML.fit_intent_model(
        ML.training_pool(pools.pooled), EX.WORD, EX.BASE_LEARNER, hash_bits=10
    )
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_model(spark, str(tmp_path / "m"))
    gold = EX.labelled(pools.evaluation)
    rows = [sorted(map(tuple, ML.predict(m, gold).select("row_key", "intent").collect())) for m in (model, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 20
    with pytest.raises(ValueError, match="bits"):
        TF.hashed_weights(spark.createDataFrame([], "doc_id int, term string, tf bigint"), 31)


def test_running_totals_and_positions(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 50), rng.randint(1, 9)) for _ in range(1000)]
    df = stage(spark.createDataFrame(rows, "k int, n int").repartition(5), "t")
    got = RK.running_totals(df, ["k"], "n").collect()
    by_key = sorted(got, key=lambda r: r.before)
    assert [r.k for r in by_key] == sorted(r[0] for r in rows)
    total = 0
    for r in by_key:
        assert r.before == total
        total += r.n
    places = sorted(r.position for r in RK.positions(df, ["k"]).collect())
    assert places == list(range(1000))
    assert RK.positions(df.where("k < 0"), ["k"]).collect() == []


def test_ranks_take_nulls_as_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "")], "id int, g string")
    got = {r.id: (r["rank"], r.n) for r in RK.ranks(df, ["id"], ["g"], total="n").collect()}
    assert got == {1: (1, 2), 3: (2, 2), 2: (1, 2), 4: (2, 2), 5: (1, 1)}


def test_spearman_on_a_long_scale(spark):
    rng = random.Random(3)
    rows = [(x := rng.random(), x + rng.random() / 5) for _ in range(2000)] + [(0.5, 0.5)] * 50
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "a double, b double")
    [row] = M.spearman(df, "a", "b").collect()

    def ranks(values):
        places = {}
        for i, v in enumerate(sorted(values)):
            places.setdefault(v, []).append(i + 1)
        return [sum(places[v]) / len(places[v]) for v in values]

    a, b = ranks([r[0] for r in rows]), ranks([r[1] for r in rows])
    mean = (len(rows) + 1) / 2
    cov = sum((x - mean) * (y - mean) for x, y in zip(a, b))
    size = (sum((x - mean) ** 2 for x in a) * sum((y - mean) ** 2 for y in b)) ** 0.5
    assert row.n == len(rows) and row.spearman == pytest.approx(cov / size)


def test_sketches_merge(spark):
    rng = random.Random(4)
    rows = [(f"c{i % 2}", " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(400))) for i in range(200)]
    raw = spark.createDataFrame(rows, "company string, conversation string")
    parts = [raw.limit(0), raw.where("company = 'c0'"), raw.where("company = 'c1'"), raw]
    sketches = [PF.word_sketches(p) for p in parts]
    merged = sketches[0]
    for s in sketches[1:]:
        merged = merged.unionByName(s)  # every text twice: distinct words do not change
    for r in PF.sketched_diversity(PF.merge_sketches(merged)).collect():
        exact = len({w for c, t in rows if c == r.brand for w in t.split()})
        assert abs(r.distinct_words - exact) <= 0.04 * exact
        assert r.words == 2 * 400 * 100


RAW = [
    ("k1", "acme", "Customer: My premium download stopped playing\nSupport: Please restart the app /AB\nCustomer: Still nothing at all here\nSupport: thanks for reaching out."),
    ("k2", "acme", "Customer: My premium download stopped playing\nSupport: Please restart the app /AB"),
    ("k3", "other", "Customer: I was charged twice for it\nSupport: We will look into that"),
    ("k4", "acme", "Customer: short\nSupport: We will look into that"),
    ("k5", "acme", None),
    ("k6", "acme", "no roles at all"),
]


def test_preparation_of_ones_own_table(spark, tmp_path):
    raw = spark.createDataFrame(RAW, "conversation_id string, company string, conversation string")
    done = prepare(raw, "acme", str(tmp_path / "out"))
    counts = {r.step: r.n for r in done.counts.collect()}
    assert counts == {
        "raw_conversations": 5, "extracted_pairs": 3, "deduped_pairs": 1, "eval_pool": 0,
        "dev_pool": 0, "retrieval_corpus": 1,
    }
    [row] = done.pools.pooled.collect()
    assert (row.conversation_id, row.support_reply) == ("k1", "Please restart the app /AB")
    assert spark.read.parquet(str(tmp_path / "out/pools")).count() == 1
    assert spark.read.json(str(tmp_path / "out/counts")).count() == 6


def test_parts_and_whole_transcripts_prepare_alike(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    whole, cut = (
        prepare(transcripts(turns, size).withColumn("company", F.lit("c")), "c") for size in (4096, 3)
    )
    first, second = (
        sorted(map(tuple, p.pools.pooled.select("pair_id", "customer_msg", "pool").collect()))
        for p in (whole, cut)
    )
    assert first == second and len(first) > 20
    assert sorted(map(tuple, whole.counts.collect())) == sorted(map(tuple, cut.counts.collect()))
    pools = Counter(r[2] for r in first)
    assert all(pools[p] for p in ("eval", "dev", "retrieval"))


def test_run_writes_its_results(spark, sf, tmp_path):
    out = str(tmp_path / "run")
    run = run_pools(build_pools(spark, sf), EX.WORD, Learner("nb", 1.0, False), out)
    assert 0.0 <= run.grounded_share <= 1.0
    n = spark.read.parquet(f"{out}/golden").count()
    assert spark.read.parquet(f"{out}/predictions").count() == 3 * n
    reports = [json.loads(r.value) for r in spark.read.text(f"{out}/report").collect()]
    assert sorted(r["system"] for r in reports) == ["baseline_simple", "baseline_trivial", "system_full"]
    [checks] = spark.read.json(f"{out}/reply_checks").collect()
    assert checks.n == n and checks.grounded_share == pytest.approx(run.grounded_share)


def test_reused_stages_replace_each_other(spark):
    paths = []
    for i in range(3):
        with reused_stages(spark, "loop"):
            tables = [stage(spark.range(i + 1), "a"), stage(spark.range(i + 2), "b")]
            paths.append(sorted({f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}))
            assert [t.count() for t in tables] == [i + 1, i + 2]
    assert paths[0] == paths[1] == paths[2]
    assert "loop" not in stage(spark.range(1), "a").inputFiles()[0]
