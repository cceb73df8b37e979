import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from replylens.functions import rules as R
from replylens.operators import decide as D
from replylens.operators import metrics as M
from replylens.operators import models as ML
from replylens.operators import retrieval as RT
from replylens.operators import solver
from replylens.operators.models import Learner
from replylens.plans import experiments as EX
from replylens.plans.prepare import build_pools
from replylens.session import stage, stage_root
from replylens.sources import support_pairs
from replylens.streaming import score_stream

ROWS = [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "b")] + [("c", "a")]


def counts(spark):
    df = spark.createDataFrame(ROWS, "t string, p string")
    return M.label_counts(df, "t", "p")


def test_class_report_and_summary(spark):
    report = {r.label: r for r in M.class_report(counts(spark)).collect()}
    assert report["a"].precision == 3 / 4 and report["a"].recall == 3 / 5
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0.0, 0.0, 0.0)
    [s] = M.summary(counts(spark)).collect()
    f1 = [2 * 3 / 9, 2 / 4, 0.0]
    assert s.n == 7 and s.accuracy == 4 / 7
    assert s.macro_f1 == pytest.approx(sum(f1) / 3)
    assert s.weighted_f1 == pytest.approx((f1[0] * 5 + f1[1] * 1) / 7)


def test_confusion_cells_sum_to_n(spark):
    cells = {(r.true_label, r.pred_label): r.n for r in M.confusion_matrix(counts(spark)).collect()}
    assert len(cells) == 9 and sum(cells.values()) == len(ROWS) and cells["c", "c"] == 0


def test_escalation_without_positives(spark):
    df = spark.createDataFrame([(False, True), (False, False)], "t boolean, p boolean")
    [r] = M.escalation_metrics(df, "t", "p").collect()
    assert (r.escalation_precision, r.escalation_recall, r.escalation_f1) == (0.0, 0.0, 0.0)
    assert (r.false_auto_handle_rate, r.false_escalation_rate) == (0.0, 0.5)


def test_agreement(spark):
    same = spark.createDataFrame([(1, 1), (2, 2), (5, 5)], "a int, b int")
    c = M.label_counts(same, "a", "b")
    assert M.cohen_kappa(c).first().kappa == pytest.approx(1.0)
    assert M.cohen_kappa(c, "linear").first().kappa == pytest.approx(1.0)
    assert M.spearman(same, "a", "b").first().spearman == pytest.approx(1.0)
    # one pair out of order: ranks (1,2,3) against (1,3,2)
    other = spark.createDataFrame([(1, 1), (2, 9), (5, 5)], "a int, b int")
    assert M.spearman(other, "a", "b").first().spearman == pytest.approx(0.5)


def test_override(spark):
    df = spark.createDataFrame([([0.3, 0.6, 0.1],), ([0.1, 0.8, 0.1],)], "p array<double>")
    labels = ("billing", "other", "playback")
    got = [r[0] for r in df.select(ML.override_other(labels, F.col("p"), 0.25)).collect()]
    assert got == ["billing", "other"]


@pytest.fixture(scope="module")
def pools(spark, sf):
    return build_pools(spark, sf)


@pytest.mark.parametrize("learner", [Learner("svc"), Learner("lr", 2.0), Learner("nb", 1.0, False)])
def test_models_learn_and_reload(spark, pools, tmp_path, learner):
    train = ML.training_pool(pools.pooled)
    model = ML.fit_intent_model(train, EX.WORD, learner)
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_model(spark, str(tmp_path / "m"))
    gold = EX.labelled(pools.evaluation)
    first = ML.predict(model, gold).select("row_key", "intent", "confidence", "intent_label")
    second = ML.predict(again, gold).select("row_key", "intent", "confidence", "intent_label")
    rows = first.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, second.collect()))
    assert len(rows) == 20 and all(0 < r.confidence <= 1 for r in rows)
    right = sum(r.intent == r.intent_label for r in rows) / len(rows)
    assert right >= (0.5 if learner.kind == "nb" else 0.8)


@pytest.mark.parametrize("kind", ["svc", "lr"])
def test_models_predict_in_a_session_that_has_observed(spark, tmp_path, kind):
    rows = [(f"play song {i % 3} now", "playback") for i in range(9)]
    rows += [(f"refund card {i % 3} please", "billing") for i in range(9)]
    train = spark.createDataFrame(rows, "customer_msg string, intent_label string")
    seen = Observation()
    train.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(str(tmp_path / "t"))
    assert seen.get == {"n": 18}
    model = ML.fit_intent_model(train, EX.WORD, Learner(kind))
    assert ML.predict(model, train).where("intent = intent_label").count() == 18


def test_stream_equals_batch_over_two_steps(spark, pools, sf, tmp_path):
    """All decision columns, in two micro-batches that share their stage folders."""
    index = RT.build_index(pools.retrieval)
    columns = ["event_id", "intent", "draft_reply", "grounded", "escalate", "escalation_reason"]

    def score(batch):
        return D.score_messages(
            batch.withColumn("intent", R.classify_intent(F.col("customer_msg"))), index
        ).select(*columns)

    messages = support_pairs(spark, spark.read.parquet(f"{sf}/events.parquet")).select(
        "event_id", "customer_msg"
    )
    for i in (0, 1):
        messages.where(F.col("event_id") % 2 == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = (
        spark.readStream.schema(messages.schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    before = set(os.listdir(stage_root(spark)))
    score_stream(stream, score, out, state).awaitTermination()
    new = set(os.listdir(stage_root(spark))) - before
    assert len(os.listdir(out)) == 2 and len(new) == 1  # one folder, however many batches
    streamed = spark.read.parquet(out).select(*columns).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, score(messages).collect()))
    assert len(streamed) == 1000


def test_best_override_must_beat_the_plain_prediction(spark):
    def report(*rows):
        return spark.createDataFrame(list(rows), "threshold double, macro_f1 double")

    assert EX.best_override(report((0.0, 0.5), (0.2, 0.5), (0.3, 0.4))) is None
    assert EX.best_override(report((0.0, 0.5), (0.2, 0.6), (0.3, 0.6))) == 0.2


def test_solver_bound_is_an_error(spark, pools):
    with pytest.raises(RuntimeError, match="converge"):
        ML.fit_intent_model(ML.training_pool(pools.pooled), EX.WORD, Learner("lr", 2.0, max_iter=2))


def test_texts_with_two_labels_stay_two_rows(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")]
    docs = ML.distinct_messages(spark.createDataFrame(rows, "customer_msg string, l string"), "l")
    got = sorted((r.customer_msg, r.label, r.copies) for r in docs.collect())
    assert got == [("a", "x", 2), ("a", "y", 1), ("b", "x", 1)]
    assert len({r.doc_id for r in docs.collect()}) == 3


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    def put(name, *rows):
        spark.createDataFrame(list(rows), "event_id bigint, customer_msg string").coalesce(1).write.parquet(
            str(tmp_path / "in" / name)
        )

    def run():
        stream = (
            spark.readStream.schema("event_id bigint, customer_msg string")
            .option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", 1)
            .parquet(str(tmp_path / "in"))
        )
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        score_stream(stream, lambda batch: batch, out, state).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(out).collect())

    put("a", (1, "x"), (2, "y"))
    assert run() == [1, 2]
    put("b", (3, "z"))
    assert run() == [1, 2, 3]


def _words(spark):
    """75 messages of nine common words, which no model separates, and five easy ones."""
    state, rows = 7, []
    for i in range(75):
        words = []
        for _ in range(6):
            state = (state * 1103515245 + 12345) % (1 << 31)
            words.append(f"word{state // 65536 % 9}")
        rows.append((" ".join(words), f"label{state // 65536 % 3}"))
    rows += [(f"label{i % 3} only{i % 3} text {i}", f"label{i % 3}") for i in range(5)]
    return spark.createDataFrame(rows, "customer_msg string, intent_label string")


@pytest.mark.parametrize(
    "learner",
    [Learner("svc"), Learner("svc", 2.0, False), Learner("lr", 2.0), Learner("lr", 5.0, False)],
    ids=lambda x: x.name,
)
def test_large_models_send_no_gradients_to_the_driver(spark, tmp_path, monkeypatch, learner):
    docs = stage(ML.distinct_messages(_words(spark), "intent_label"), "docs")
    fitted = ML.fit_features(docs, EX.WORD)
    table = ML.vectorise(docs, fitted)
    plain = ML.fit_classifier(table, fitted, learner)

    def refuse(*_args):
        raise AssertionError("a solver that steps through the driver")

    monkeypatch.setattr(ML, "DRIVER_COEFFICIENTS", 0, raising=False)
    monkeypatch.setattr(ML.LogisticRegression, "fit", refuse)
    monkeypatch.setattr(ML.LinearSVC, "fit", refuse)
    monkeypatch.setattr(solver, "ROWS_PER_TASK", 25)  # four tasks
    model = ML.fit_classifier(table, fitted, learner)
    assert ML.solver_steps(model.classifier) > 0

    rows = table.withColumn("f", F.unwrap_udt("features")).collect()
    n = {k: sum(r.copies for r in rows if r.label == k) for k in model.labels}
    total = sum(n.values())

    def values(fit):
        """The objective, per class for the linear SVC."""
        if learner.kind == "lr":
            w, b = fit.classifier.coefficientMatrix.toArray(), fit.classifier.interceptVector.toArray()
        else:
            w = [x.coefficients.toArray() for x in fit.classifier.models]
            b = [x.intercept for x in fit.classifier.models]
        lost, weights = [0.0] * len(n), [0.0] * len(n)
        for r in rows:
            at = model.labels.index(r.label)
            m = [sum(w[k][j] * x for j, x in zip(r.f.indices, r.f["values"])) + b[k] for k in range(len(n))]
            for k in range(len(n)):
                raised = total / (len(n) * n[r.label]) if learner.balanced else 1.0
                if learner.kind == "lr":
                    weight, own = r.copies * raised, math.log(sum(math.exp(x - m[at]) for x in m))
                else:
                    weight = r.copies * (raised if k == at else 1.0)
                    own = max(0.0, 1 - (1 if k == at else -1) * m[k])
                lost[k] += weight * own
                weights[k] += weight
        squares = [float((x**2).sum()) for x in w]
        if learner.kind == "lr":
            return [(lost[0] + sum(squares) / 2 / learner.c) / total]
        return [(a + s / 2 / learner.c) / c for a, s, c in zip(lost, squares, weights)]

    for mine, theirs in zip(values(model), values(plain)):
        assert mine <= theirs + 2e-4
    ML.save_model(model, f"{tmp_path}/model")
    again = ML.load_model(spark, f"{tmp_path}/model")
    first, second = (
        {r.doc_id: (r.intent, round(r.confidence, 9)) for r in ML.score_table(x, table).collect()}
        for x in (model, again)
    )
    assert first == second and len(first) == len(rows)
    easy = [r for r in rows if "only" in r.customer_msg]
    assert easy and all(first[r.doc_id][0] == r.label for r in easy)


def test_large_model_that_does_not_converge_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(ML, "DRIVER_COEFFICIENTS", 0, raising=False)
    for kind in ("svc", "lr"):
        with pytest.raises(RuntimeError, match="converge"):
            ML.fit_intent_model(_words(spark), EX.WORD, Learner(kind, max_iter=3))


class OneTask:
    def partitionId(self):
        return 0

    def getTaskInfos(self):
        return [self]

    def allGather(self, message):
        return [message]


@pytest.mark.parametrize("chunk", [3, 10, 1 << 17])
def test_products_of_the_solver(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(solver, "CHUNK", chunk)
    rows = [[0, 3], [], [1, 2, 3, 4, 5, 6], [6], [], [0, 6]]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([0, 1, 1, 0, 1, 0], pa.int32()), pa.array([1.0] * 6),
            pa.array(rows, pa.list_(pa.int32())),
            pa.array([[j + 0.5 for j in r] for r in rows], pa.list_(pa.float64())),
        ],
        ["label", "weight", "indices", "values"],
    )
    problem = solver.Problem(8, 2, False, (1.0,) * 2, (1.0,) * 2, (6.0,) * 2, (0.0,) * 2, 10, 1e-4)
    parts = [batch.slice(0, 2), batch.slice(2, 4)]
    task = solver._Task(OneTask(), str(tmp_path / "x"), problem, parts)
    dense = np.zeros((6, 9))
    dense[:, 8] = 1  # the intercept
    for i, r in enumerate(rows):
        dense[i, r] = [j + 0.5 for j in r]
    w, r = np.arange(18.0).reshape(2, 9), np.array([[1.0, 0, 2, 0, 3, 4], [0, 0, 0, 0, 5, -1]])
    assert np.allclose(task.products(task.spread(w)), w @ dense.T)
    assert np.allclose(task.collect(task.transposed(r)), r @ dense)
