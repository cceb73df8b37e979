"""Intent models on TF-IDF features with Spark ML.

Identical messages are merged into one training row weighted by their number, which
leaves every objective unchanged. Feature tables are written once as parquet; the
vector struct is built with native expressions and read back as an ML vector, so no
row passes through Python.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, NaiveBayes, NaiveBayesModel, OneVsRestModel,
    LogisticRegressionModel,
)
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..session import side_by_side, stage, stage_root
from . import solver
from .ranking import positions
from .tfidf import Features, hashed_weights, term_counts, vocabulary, weigh

DOCS_PER_PARTITION = 20_000
#: Spark's solvers send a gradient to the driver in every step, of one class (svc) or of all;
#: models with more coefficients are fitted by ``solver``, which sends none
DRIVER_COEFFICIENTS = 1 << 16
FINAL_FEATURES = Features(word=(1, 2), char=(3, 7), min_df=2)


@dataclass(frozen=True)
class Learner:
    """Which classifier to fit, with its penalty C and class weighting."""

    kind: str = "svc"  # svc, lr or nb
    c: float = 1.0
    balanced: bool = True
    max_iter: int | None = None  # 5,000 for svc, 1,000 for lr
    tol: float = 1e-4

    @property
    def name(self) -> str:
        return f"{self.kind} C={self.c:g} {'balanced' if self.balanced else 'unweighted'}"


@dataclass(frozen=True)
class FittedFeatures:
    """A fitted vocabulary with dense term indexes, or none where terms are hashed."""

    features: Features
    vocab: DataFrame | None  # term, idf, index
    size: int
    bits: int | None = None  # terms are hashed to 2 ** bits indexes


@dataclass(frozen=True)
class IntentModel:
    fitted: FittedFeatures
    labels: tuple[str, ...]
    classifier: Model
    margin_shift: tuple[float, ...] = field(default=())
    scorer: Model | None = None  # the classifier without the summary of its training


def distinct_messages(messages: DataFrame, label: str | None = None) -> DataFrame:
    """One row per message text, or per text and label: doc_id, customer_msg, copies
    [, label]."""
    keys = [F.col("customer_msg"), *([F.col(label).alias("label")] if label else [])]
    name = F.concat_ws("\n", "label", "customer_msg") if label else F.col("customer_msg")
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "doc_id", F.md5(name)
    )


def fit_features(docs: DataFrame, features: Features) -> FittedFeatures:
    """Vocabulary of ``docs`` (distinct messages with copies). Terms get dense indexes
    by their place in a range sort, without passing through the driver."""
    counts = term_counts(docs, features, "doc_id", "customer_msg").join(
        docs.select("doc_id", "copies"), "doc_id"
    )
    n_docs = docs.agg(F.sum("copies").cast("double").alias("n")).scalar()
    vocab = stage(vocabulary(counts, n_docs, features.min_df, F.col("copies")), "vocab")
    placed = positions(vocab.select("term", "idf"), ["term"], "index")
    indexed = stage(placed.withColumn("index", F.col("index").cast("int")), "indexed_vocab")
    return FittedFeatures(features, indexed, max(indexed.count(), 1))


def hashed_features(features: Features, bits: int = 18) -> FittedFeatures:
    """Nothing to fit: terms of ``features`` hashed to 2 ** bits indexes."""
    return FittedFeatures(features, None, 1 << bits, bits)


def vectorise(docs: DataFrame, fitted: FittedFeatures) -> DataFrame:
    """``docs`` plus ``features``: one sparse vector per row, staged as a table."""
    counts = term_counts(docs, fitted.features, "doc_id", "customer_msg")
    if fitted.bits is not None:
        return vector_table(docs, hashed_weights(counts, fitted.bits), fitted.size)
    weights = weigh(
        counts, fitted.vocab, fitted.features.blocks, "doc_id", carry=("index",)
    )
    return vector_table(docs, weights, fitted.size)


def vector_table(docs: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """``docs`` plus ``features`` from (doc_id, index, weight) rows, staged."""
    entries = F.array_sort(F.collect_list(F.struct("index", "weight")))
    rows = weights.groupBy("doc_id").agg(entries.alias("entries"))
    none = F.array().cast(rows.schema["entries"].dataType)
    joined = docs.join(rows, "doc_id", "left").withColumn(
        "entries", F.coalesce("entries", none)
    )
    struct = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col("entries.index").alias("indices"), F.col("entries.weight").alias("values"),
    )
    table = joined.select(*docs.columns, struct.alias("features"))
    path = f"{stage_root(docs.sparkSession)}/{uuid.uuid4().hex}/features"
    table.write.parquet(path)
    as_vector = T.StructType(
        [f for f in table.schema if f.name != "features"]
        + [T.StructField("features", VectorUDT())]
    )
    return docs.sparkSession.read.schema(as_vector).parquet(path)


def balanced_weights(docs: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, class_weight) with weight = rows / (classes * rows of the class)."""
    counts = docs.groupBy(label).agg(F.sum("copies").alias("n"))
    total = counts.agg(
        F.sum("n").cast("double").alias("rows"), F.count(F.lit(1)).alias("classes")
    )
    rows = total.select("rows").scalar()
    classes = total.select("classes").scalar()
    return counts.withColumn("class_weight", rows / (classes * F.col("n")))


def fit_classifier(table: DataFrame, fitted: FittedFeatures, learner: Learner) -> IntentModel:
    """Fit on a vectorised table with doc_id, label, copies, features."""
    weights = balanced_weights(table)
    rows = {r["label"]: r for r in weights.orderBy("label").collect()}  # one row a class
    labels = tuple(rows)
    total = sum(r["n"] for r in rows.values())
    index = F.array_position(F.lit(list(labels)), F.col("label")) - 1
    weight: Column = F.col("copies").cast("double")
    if learner.balanced and learner.kind == "lr":
        table = table.join(weights.select("label", "class_weight"), "label")
        weight = weight * F.col("class_weight")
    # solvers run one short job per step, so partitions should hold real work
    partitions = math.ceil(max(table.count(), 1) / DOCS_PER_PARTITION)
    data = table.select(
        index.cast("double").alias("label"), weight.alias("weight"), "features"
    ).coalesce(partitions)
    # balanced weights sum to the number of rows as well
    penalty = 1.0 / (learner.c * total)
    max_iter = learner.max_iter or (5000 if learner.kind == "svc" else 1000)
    common = dict(
        featuresCol="features", labelCol="label", weightCol="weight",
    )
    shift: tuple[float, ...] = ()
    sizes = [r["n"] for r in rows.values()]
    if learner.kind in ("svc", "lr") and _leaves_driver(data.sparkSession, fitted, labels):
        raised = [r["class_weight"] if learner.balanced else 1.0 for r in rows.values()]
        model: Model = _fit_in_tasks(table, index, weight, fitted, sizes, raised, learner, max_iter)
    elif learner.kind == "svc":
        model = _one_vs_rest(data, sizes, learner, max_iter)
    elif learner.kind == "lr":
        model = LogisticRegression(
            **common, family="multinomial", elasticNetParam=0.0, standardization=False,
            regParam=penalty, maxIter=max_iter, tol=learner.tol,
        ).fit(data)
    elif learner.kind == "nb":
        model = NaiveBayes(**common, modelType="multinomial", smoothing=1.0).fit(data)
        # Spark also smooths the class priors; put the plain shares back
        shift = tuple(
            math.log(rows[label]["n"] / total) - float(model.pi[i])
            for i, label in enumerate(labels)
        )
    else:
        raise ValueError(f"unknown learner {learner.kind!r}")
    if learner.kind == "nb":
        return IntentModel(fitted, labels, model, shift)
    if (steps := solver_steps(model)) >= max_iter:
        raise RuntimeError(f"{learner.name} did not converge in {steps} steps; raise max_iter")
    scorer = None if hasattr(model, "steps") else _without_summary(model)
    return IntentModel(fitted, labels, model, scorer=scorer)


def _leaves_driver(spark: SparkSession, fitted: FittedFeatures, labels: tuple[str, ...]) -> bool:
    """Whether a linear model has too many coefficients for steps through the driver, and
    tasks can exchange files in the stage folder."""
    many = len(labels) > 1 and fitted.size * len(labels) > DRIVER_COEFFICIENTS
    return many and solver.shared_folder(spark) is not None and solver.slots(spark) > 0


def _fit_in_tasks(
    table: DataFrame, index: Column, weight: Column, fitted: FittedFeatures, sizes: list[int],
    raised: list[float], learner: Learner, max_iter: int,
) -> Model:
    """The model that Spark's solver would fit, from coefficients that stay in the tasks
    until they are final."""
    data = table.select(index.alias("label"), weight.alias("weight"), "features")
    total, k = sum(sizes), len(sizes)
    softmax = learner.kind == "lr"
    if softmax:  # weights are in the rows; balanced ones sum to the number of rows as well
        sums = [float(total)] * k
        shares = np.array([n * r / total for n, r in zip(sizes, raised)])
        intercept = np.log(shares) - np.log(shares).mean()
    else:
        sums, intercept = [total - n + r * n for n, r in zip(sizes, raised)], np.zeros(k)
    found = solver.solve(
        data, table.count(),
        solver.Problem(
            fitted.size, k, softmax, tuple(1.0 / (learner.c * x) for x in sums), tuple(raised),
            tuple(sums), tuple(intercept), max_iter, learner.tol,
        ),
    )
    jvm = SparkSession.active()._jvm.org.apache.spark.ml.classification
    java = lambda x: _py2java(table.sparkSession.sparkContext, x)
    if softmax:
        lr = LogisticRegression(
            featuresCol="features", labelCol="label", family="multinomial", standardization=False
        )
        matrix = DenseMatrix(k, fitted.size, found.coefficients.ravel(), True)
        centred = DenseVector(found.intercepts - found.intercepts.mean())
        made = jvm.LogisticRegressionModel(lr.uid, java(matrix), java(centred), k, True)
        model: Model = lr._copyValues(lr._create_model(made))
    else:
        svc = LinearSVC(featuresCol="features", labelCol="label", standardization=False)
        models = []
        for w, b in zip(found.coefficients, found.intercepts):
            binary = svc.copy()
            made = jvm.LinearSVCModel(f"{svc.uid}_{len(models)}", java(DenseVector(w)), float(b))
            models.append(binary._copyValues(binary._create_model(made)))
        model = OneVsRestModel(models=models).setFeaturesCol("features")
        model.set(model.classifier, svc)  # saving a model writes its solver as well
    model.steps = found.steps
    return model


def _without_summary(model: Model) -> Model:
    """The model as it is read from its files. A model just fitted holds a summary with the
    session inside; it goes along to the executors with every prediction, which fails once
    the session has observed a metric."""
    path = f"{stage_root(SparkSession.active())}/{uuid.uuid4().hex}/classifier"
    model.write().save(path)
    return type(model).load(path)


def _one_vs_rest(
    data: DataFrame, sizes: list[int], learner: Learner, max_iter: int
) -> OneVsRestModel:
    """One binary fit per class. A balanced class weight raises the class's own rows in its
    own fit; as a row of the rest, a message counts once, whatever its class."""
    total = sum(sizes)
    solver = LinearSVC(
        featuresCol="features", labelCol="label", weightCol="weight", standardization=False,
        maxIter=max_iter, tol=learner.tol,
    )

    def fit(k: int) -> Model:
        raised = total / (len(sizes) * sizes[k]) if learner.balanced else 1.0
        mine = F.col("label") == k
        binary = data.select(
            mine.cast("double").alias("label"),
            (F.col("weight") * F.when(mine, raised).otherwise(1.0)).alias("weight"), "features",
        )
        # the solver divides by the sum of the weights
        weight_sum = total - sizes[k] + raised * sizes[k]
        return solver.copy({solver.regParam: 1.0 / (learner.c * weight_sum)}).fit(binary)

    data = data.cache()
    try:
        models = side_by_side(
            data.sparkSession, [lambda k=k: fit(k) for k in range(len(sizes))], 8
        )
    finally:
        data.unpersist()
    model = OneVsRestModel(models=models).setFeaturesCol("features")
    model.set(model.classifier, solver)  # saving a model writes its solver as well
    return model


def solver_steps(model: Model) -> int:
    """Steps of a linear model just fitted; the most of any class for one-vs-rest."""
    if hasattr(model, "steps"):
        return model.steps
    if isinstance(model, OneVsRestModel):
        return max(m.summary().totalIterations for m in model.models)
    return model.summary.totalIterations


def fit_intent_model(
    messages: DataFrame, features: Features = FINAL_FEATURES, learner: Learner = Learner(),
    label: str = "intent_label", hash_bits: int | None = None,
) -> IntentModel:
    """Fit on labelled messages (customer_msg, label), with a vocabulary of their terms or
    with terms hashed to 2 ** hash_bits indexes (not for naive Bayes, which takes no
    negative weights)."""
    docs = stage(distinct_messages(messages, label), "train_docs")
    if hash_bits is None:
        fitted = fit_features(docs, features)
    else:
        fitted = hashed_features(features, hash_bits)
    return fit_classifier(vectorise(docs, fitted), fitted, learner)


def margins(model: IntentModel) -> Column:
    raw = vector_to_array("rawPrediction")
    if model.margin_shift:
        shift = F.lit(list(model.margin_shift))
        raw = F.zip_with(raw, shift, lambda a, b: a + b)
    return raw


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda p: p / total)


def score_table(model: IntentModel, table: DataFrame) -> DataFrame:
    """Predictions for a vectorised table: intent, confidence, probabilities. The
    confidence is a softmax over margins, for display only."""
    kept = [c for c in table.columns if c != "features"]
    scored = (model.scorer or model.classifier).transform(table)
    scored = scored.select(*kept, margins(model).alias("margins"))
    scored = scored.withColumn("probabilities", softmax(F.col("margins")))
    best = F.array_position("margins", F.array_max("margins")).cast("int")
    return scored.select(
        *kept, F.get(F.lit(list(model.labels)), best - 1).alias("intent"),
        F.array_max("probabilities").alias("confidence"), "probabilities",
    )


def predict(model: IntentModel, messages: DataFrame) -> DataFrame:
    """Add intent and confidence to messages. Each distinct text is scored once."""
    texts = distinct_messages(messages).drop("copies")
    scored = score_table(model, vectorise(texts, model.fitted))
    return messages.join(scored.select("customer_msg", "intent", "confidence"), "customer_msg")


def override_other(
    labels: tuple[str, ...], probabilities: Column, threshold: Column | float
) -> Column:
    """Best label other than ``other`` if its probability reaches the threshold,
    else the best label."""
    names = F.lit(list(labels))
    if R.DEFAULT_INTENT in labels:
        at = labels.index(R.DEFAULT_INTENT)
        others = F.transform(
            probabilities, lambda p, i: F.when(i == at, F.lit(-1.0)).otherwise(p)
        )
    else:
        others = probabilities

    def name_of(values: Column) -> Column:
        return F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)

    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(F.array_max(others) >= threshold, name_of(others)).otherwise(
        name_of(probabilities)
    )


def training_pool(pooled: DataFrame) -> DataFrame:
    """Dev and retrieval messages with weak rule labels."""
    dev = pooled.where(F.col("pool") == "dev").select("customer_msg")
    retrieval = pooled.where(F.col("pool") == "retrieval").select("customer_msg")
    return dev.unionByName(retrieval).withColumn(
        "intent_label", R.classify_intent(F.col("customer_msg"))
    )


_LOADERS = {"svc": OneVsRestModel, "lr": LogisticRegressionModel, "nb": NaiveBayesModel}


def save_model(model: IntentModel, path: str) -> None:
    spark = SparkSession.active()
    if model.fitted.vocab is not None:
        model.fitted.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    model.classifier.write().overwrite().save(f"{path}/classifier")
    kind = next(k for k, cls in _LOADERS.items() if isinstance(model.classifier, cls))
    f = model.fitted.features
    meta = {
        "kind": kind, "labels": model.labels, "size": model.fitted.size,
        "shift": model.margin_shift, "word": f.word, "char": f.char, "min_df": f.min_df,
        "bits": model.fitted.bits,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> IntentModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    features = Features(
        tuple(meta["word"]), tuple(meta["char"]) if meta["char"] else None, meta["min_df"]
    )
    bits = meta.get("bits")
    vocab = spark.read.parquet(f"{path}/vocab") if bits is None else None
    fitted = FittedFeatures(features, vocab, meta["size"], bits)
    classifier = _LOADERS[meta["kind"]].load(f"{path}/classifier")
    return IntentModel(fitted, tuple(meta["labels"]), classifier, tuple(meta["shift"]))
