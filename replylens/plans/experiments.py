"""Model comparisons: small driver loops over staged feature tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import grams as G
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import splits as S
from ..operators.models import Learner
from ..operators.tfidf import Features
from ..session import side_by_side, stage

# The compared settings.
FRACTIONS = (0.10, 0.25, 0.50, 0.75, 1.0)
OVERRIDE_THRESHOLDS = (0.15, 0.20, 0.25, 0.30, 0.35, 0.40)
FEATURE_GRID: tuple[tuple[str, Features], ...] = (
    ("word(1,1)", Features((1, 1), None, 2)),
    ("word(1,2)", Features((1, 2), None, 2)),
    ("word(1,3)", Features((1, 3), None, 2)),
    ("word(1,2)+char(3,5)", Features((1, 2), (3, 5), 2)),
    ("word(1,2)+char(3,6)", Features((1, 2), (3, 6), 2)),
    ("word(1,2)+char(4,6)", Features((1, 2), (4, 6), 2)),
    ("word(1,2)+char(3,7)", Features((1, 2), (3, 7), 2)),
    ("word(1,2)+char(3,5) min_df=1", Features((1, 2), (3, 5), 1)),
)
LR_PENALTIES = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
SVC_PENALTIES = (0.5, 1.0, 2.0)
BASE_LEARNER = Learner("lr", 2.0, True)
# End of fixed values.
WORD = Features((1, 2), None, 2)
WORD_CHAR = Features((1, 2), (3, 5), 2)


@dataclass(frozen=True)
class Universe:
    """Training messages and the fixed held-out slice of the dev pool."""

    train: DataFrame  # row_key, customer_msg, intent_label
    held_out: DataFrame


def labelled(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("pair_id").alias("row_key"), "customer_msg",
        R.classify_intent(F.col("customer_msg")).alias("intent_label"),
    )


def dev_split(pooled: DataFrame) -> DataFrame:
    dev = labelled(pooled.where(F.col("pool") == S.DEV))
    return S.stratified_split(dev, "intent_label", "row_key")


def small_universe(pooled: DataFrame) -> Universe:
    """Dev pool alone: 80 % to train, 20 % held out per label."""
    split = stage(dev_split(pooled), "dev_split")
    return Universe(
        split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    )


def large_universe(pooled: DataFrame) -> Universe:
    """Dev training rows plus the retrieval pool; same held-out slice."""
    small = small_universe(pooled)
    more = labelled(pooled.where(F.col("pool") == S.RETRIEVAL))
    return Universe(stage(small.train.unionByName(more), "universe"), small.held_out)


@dataclass(frozen=True)
class FeatureTables:
    fitted: ML.FittedFeatures
    train: DataFrame
    held_out: DataFrame


def universe_grams(
    universe: Universe, settings: Iterable[Features], shares: Iterable[float] = (1.0,)
) -> G.GramTable:
    """One gram table of all messages of a universe, for all settings compared on it.

    The training rows may carry ``prefix_share``; every share is a training set of its
    own. Held-out messages are in no training set.
    """
    shares = list(shares)
    marked = "prefix_share" in universe.train.columns

    def copies(of: DataFrame, inside) -> DataFrame:
        sums = [F.sum(F.when(inside(s), 1).otherwise(0)).cast("bigint") for s in shares]
        return of.groupBy("customer_msg", F.col("intent_label").alias("label")).agg(
            F.array(*sums).alias("copies"), F.count(F.lit(1)).alias("rows")
        )

    train = copies(
        universe.train, lambda s: F.col("prefix_share") <= s if marked else F.lit(True)
    ).withColumn("side", F.lit("train"))
    held_out = copies(universe.held_out, lambda s: F.lit(False)).withColumn("side", F.lit("held_out"))
    name = F.md5(F.concat_ws("\n", "side", "label", "customer_msg"))
    docs = stage(train.unionByName(held_out).withColumn("doc_id", name), "docs")
    return G.gram_table(docs, G.widest(settings))


def gram_features(grams: G.GramTable, features: Features, training_set: int = 0) -> FeatureTables:
    """Vectors of one setting and training set, selected from the shared grams."""
    fitted = G.fit_grams(grams, features, training_set)
    table = G.vectors(grams, fitted)
    mine = F.get("copies", F.lit(training_set))
    keep = ["doc_id", "customer_msg", "label", "features"]
    train = table.where((F.col("side") == "train") & (mine > 0))
    held_out = table.where("side = 'held_out'")
    return FeatureTables(
        fitted, train.select(*keep, mine.alias("copies")),
        held_out.select(*keep, F.col("rows").alias("copies")),
    )


def feature_tables(universe: Universe, features: Features) -> FeatureTables:
    """Features fitted and staged once, shared by all learners compared on them."""
    return gram_features(universe_grams(universe, [features]), features)


def _scores(scored: DataFrame) -> tuple:
    counts = M.label_counts(scored, "label", "intent", copies="copies")
    row = M.summary(counts).first()
    if row is None or row["n"] is None:
        return 0, 0.0, 0.0, 0.0
    return int(row["n"]), row["accuracy"], row["macro_f1"], row["weighted_f1"]


def evaluate(tables: FeatureTables, learner: Learner, table: DataFrame | None = None) -> tuple:
    """(n, accuracy, macro_f1, weighted_f1) of one fit on the held-out table."""
    model = ML.fit_classifier(tables.train, tables.fitted, learner)
    return _scores(ML.score_table(model, tables.held_out if table is None else table))


RESULT = "step int, grp string, config string, n bigint, accuracy double, macro_f1 double, weighted_f1 double"


def _results(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), RESULT)


def _best(rows: list[tuple]) -> int:
    """Place of the highest macro-F1; the first wins on ties."""
    return max(range(len(rows)), key=lambda i: (rows[i][5], -i))


def best_config(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("macro_f1"), "step").limit(1)


def grid(
    spark: SparkSession, universe: Universe,
    feature_grid: tuple[tuple[str, Features], ...] = FEATURE_GRID,
    penalties: tuple[float, ...] = LR_PENALTIES,
) -> DataFrame:
    """Sequential comparison: features, then LR settings, then other learners. All
    feature settings are selections of one gram table."""
    grams = universe_grams(universe, [f for _name, f in feature_grid])

    def try_features(features: Features) -> tuple[FeatureTables, tuple]:
        tables = gram_features(grams, features)
        return tables, evaluate(tables, BASE_LEARNER)

    tried = side_by_side(spark, [lambda f=f: try_features(f) for _name, f in feature_grid])
    rows = [
        (i, "features", name, *scores)
        for i, ((name, _f), (_t, scores)) in enumerate(zip(feature_grid, tried))
    ]
    tables = tried[_best(rows)][0]
    lr = [Learner("lr", c, balanced) for balanced in (False, True) for c in penalties]
    lr_rows = _try_learners(spark, tables, lr, "lr", len(rows))
    last = [lr[_best(lr_rows)], Learner("svc", 1.0, True), Learner("nb", 1.0, False)]
    rows += lr_rows
    return _results(
        spark, rows + _try_learners(spark, tables, last, "classifier", len(rows))
    )


def _try_learners(
    spark: SparkSession, tables: FeatureTables, learners: list[Learner], group: str, start: int
) -> list[tuple]:
    scores = side_by_side(spark, [lambda x=x: evaluate(tables, x) for x in learners])
    return [
        (start + i, group, x.name, *row) for i, (x, row) in enumerate(zip(learners, scores))
    ]


def svc_sweep(
    spark: SparkSession, universe: Universe, features: Features = ML.FINAL_FEATURES,
    penalties: tuple[float, ...] = SVC_PENALTIES,
) -> DataFrame:
    tables = feature_tables(universe, features)
    learners = [Learner("svc", c, b) for b in (False, True) for c in penalties]
    return _results(spark, _try_learners(spark, tables, learners, "svc", 0))


def word_or_char(
    spark: SparkSession, universe: Universe, learner: Learner = BASE_LEARNER
) -> DataFrame:
    configs = [("word", WORD), ("word+char", WORD_CHAR)]
    grams = universe_grams(universe, [f for _n, f in configs])
    scores = side_by_side(
        spark, [lambda f=f: evaluate(gram_features(grams, f), learner) for _n, f in configs]
    )
    return _results(
        spark, [(i, "features", n, *row) for i, ((n, _f), row) in enumerate(zip(configs, scores))]
    )


def prefix_grams(
    universe: Universe, features: Features = WORD_CHAR, fractions: tuple[float, ...] = FRACTIONS
) -> G.GramTable:
    """Grams of a universe with the document frequencies of every nested prefix of its
    training rows, all counted in one pass over the texts."""
    marked = stage(S.with_prefix_share(universe.train, "row_key", fractions), "prefixes")
    return universe_grams(Universe(marked, universe.held_out), [features], sorted(fractions))


def learning_curve(
    spark: SparkSession, universe: Universe, fractions: tuple[float, ...] = FRACTIONS,
    features: Features = WORD_CHAR, learner: Learner = BASE_LEARNER,
) -> DataFrame:
    """Fit on nested prefixes of the seeded order: the usual result columns and
    ``n_train``, the rows trained on. Every prefix has its own vocabulary and document
    frequencies."""
    shares = sorted(fractions)
    grams = prefix_grams(universe, features, fractions)

    def fit_on(i: int) -> tuple:
        tables = gram_features(grams, features, i)
        n_train = tables.train.agg(F.sum("copies")).first()[0] or 0
        return (*evaluate(tables, learner), int(n_train))

    scores = side_by_side(spark, [lambda i=i: fit_on(i) for i in range(len(shares))])
    rows = [(i, "fraction", f"{s:.2f}", *row) for i, (s, row) in enumerate(zip(shares, scores))]
    return spark.createDataFrame(rows, RESULT + ", n_train bigint")


def gap_report(
    spark: SparkSession, universe: Universe, golden: DataFrame, features: Features = WORD_CHAR,
    learner: Learner = BASE_LEARNER,
) -> DataFrame:
    """Metrics of one fit on its training rows, the held-out slice and the golden set."""
    return M.summary(gap_counts(universe, golden, features, learner), ("split",))


def gap_details(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-class values, confusion matrix), each by split, of ``gap_counts``."""
    return M.class_report(counts, ("split",)), M.confusion_matrix(counts, ("split",))


def gap_counts(
    universe: Universe, golden: DataFrame, features: Features = WORD_CHAR,
    learner: Learner = BASE_LEARNER,
) -> DataFrame:
    """Staged label counts by split of one fit."""
    tables = feature_tables(universe, features)
    gold = stage(ML.distinct_messages(golden, "intent_label"), "gold_docs")
    sets = [
        ("train", tables.train), ("dev", tables.held_out),
        ("golden", ML.vectorise(gold, tables.fitted)),
    ]
    model = ML.fit_classifier(tables.train, tables.fitted, learner)
    scored = None
    for name, table in sets:
        part = ML.score_table(model, table).select(
            F.lit(name).alias("split"), "label", "intent", "copies"
        )
        scored = part if scored is None else scored.unionByName(part)
    return stage(M.label_counts(scored, "label", "intent", ("split",), "copies"), "gap_counts")


def override_report(
    spark: SparkSession, universe: Universe, learner: Learner = BASE_LEARNER,
    thresholds: tuple[float, ...] = OVERRIDE_THRESHOLDS,
) -> DataFrame:
    """Macro-F1 per override threshold, all thresholds in one pass over the scores, and
    whether it is the one to use (``chosen``). Threshold 0 stands for the plain
    prediction, which stays unless a threshold is strictly better."""
    tables = feature_tables(universe, WORD)
    model = ML.fit_classifier(tables.train, tables.fitted, learner)
    scored = ML.score_table(model, tables.held_out)
    report = stage(override_metrics(scored, model.labels, thresholds), "override")
    best = best_override(report)
    return report.withColumn("chosen", F.col("threshold") == F.lit(0.0 if best is None else best))


def best_override(report: DataFrame) -> float | None:
    """The threshold with the highest macro-F1, the smallest on ties; None unless it is
    strictly better than the plain prediction (threshold 0). One row a threshold."""
    rows = {r["threshold"]: r["macro_f1"] for r in report.collect()}
    plain = rows.pop(0.0)
    best = max(rows, key=lambda t: (rows[t], -t), default=None)
    return best if best is not None and rows[best] > plain else None


def override_metrics(
    scored: DataFrame, labels: tuple[str, ...],
    thresholds: tuple[float, ...] = OVERRIDE_THRESHOLDS,
) -> DataFrame:
    choices = [F.struct(F.lit(0.0).alias("threshold"), F.col("intent").alias("pred"))]
    for t in thresholds:
        choice = ML.override_other(labels, F.col("probabilities"), float(t))
        choices.append(F.struct(F.lit(float(t)).alias("threshold"), choice.alias("pred")))
    rows = scored.select("label", "copies", F.inline(F.array(*choices)))
    counts = M.label_counts(rows, "label", "pred", ("threshold",), "copies")
    return M.summary(counts, ("threshold",)).select("threshold", "n", "accuracy", "macro_f1")
