"""Classifiers on MLlib: training, prediction, comparison, tuning and validation."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom.operators import evaluate as E
from ticketloom.operators import features as X
from ticketloom.operators import sampling as S
from ticketloom.operators.boosting import SparseBoosting
from ticketloom.operators.columns import filter_nonempty
from ticketloom.operators.forests import Forest
from ticketloom.operators.trees import SparseTree
from ticketloom.session import materialise

MAX_TREE_DEPTH = 30
# Models of one grid or one-vs-rest set that are fitted at the same time.
PARALLEL_FITS = 4
# Rows of vectors that one task of a grid handles per pass: the driver gets a result of each task in each iteration.
GRID_ROWS_PER_TASK = 50_000


# --- estimators --------------------------------------------------------------------
def logreg(rows: int, features="features", label="label_index", c=1.0, weight=None, max_iter=1000) -> LogisticRegression:
    """Multinomial logistic regression with an L2 penalty of 1 / (C * rows), unscaled features."""
    model = LogisticRegression(
        featuresCol=features, labelCol=label, family="multinomial", regParam=X.regularisation(c, rows),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-4,
    )
    return model.setWeightCol(weight) if weight else model


def one_vs_rest_logreg(rows: int, features="features", label="label_index", c=1.0, max_iter=1000, weight=None) -> OneVsRest:
    """One binary logistic regression per class."""
    base = LogisticRegression(
        regParam=X.regularisation(c, rows), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-4
    )
    model = OneVsRest(classifier=base, featuresCol=features, labelCol=label, parallelism=PARALLEL_FITS)
    return model.setWeightCol(weight) if weight else model


def linear_svm(rows: int, features="features", label="label_index", c=1.0, max_iter=1000) -> OneVsRest:
    """One-vs-rest linear SVM (hinge loss)."""
    base = LinearSVC(regParam=X.regularisation(c, rows), standardization=False, maxIter=max_iter, tol=1e-4)
    return OneVsRest(classifier=base, featuresCol=features, labelCol=label, parallelism=PARALLEL_FITS)


def naive_bayes(features="features", label="label_index") -> NaiveBayes:
    return NaiveBayes(featuresCol=features, labelCol=label, modelType="multinomial", smoothing=1.0)


def decision_tree(features="features", label="label_index", depth=MAX_TREE_DEPTH) -> SparseTree:
    """One Gini tree."""
    return SparseTree(features, label, depth, S.SEED)


def random_forest(features="features", label="label_index", trees=100, depth=MAX_TREE_DEPTH) -> Forest:
    # Rows keep their nodes between passes: deep trees are not walked again from the root for every group of nodes.
    return Forest(
        featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=S.SEED,
        cacheNodeIds=True,
    )


def gradient_boosting(features="features", label="label_index", rounds=100, depth=3, rate=0.1) -> SparseBoosting:
    """One boosted set of trees per class on features that are not negative."""
    return SparseBoosting(features, label, rounds, depth, rate, S.SEED)


# --- training ----------------------------------------------------------------------
def _with_label_names(model_stages: list, indexer) -> PipelineModel:
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    return PipelineModel([*model_stages, names])


def train(
    df: DataFrame,
    estimator: object | Callable[[int], object],
    label: str,
    features: str = "features",
    weight: str | None = None,
    stages: Sequence = (),
) -> PipelineModel:
    """Fit a classifier on a prepared feature column; the result maps rows to ``predicted_label``.

    ``estimator`` is an estimator or a function of the row count, such as
    ``logreg``.  ``stages`` are the fitted feature stages that made the column;
    they become part of the saved model, the label indexer does not.
    """
    narrow = df.select(label, features, *([weight] if weight else [])).persist()
    try:
        rows = narrow.count()
        indexer = X.label_indexer(label).fit(narrow)
        chosen = estimator(rows) if callable(estimator) else estimator
        fitted = chosen.fit(indexer.transform(X.sized(narrow, rows)))
    finally:
        narrow.unpersist()
    return _with_label_names([*stages, fitted], indexer)


def train_logreg(
    df: DataFrame,
    text_col: str,
    label: str,
    c: float = 1.0,
    balanced: bool = False,
    **tfidf,
) -> PipelineModel:
    """TF-IDF and multinomial logistic regression as one savable text model."""
    text_model = X.fit_tfidf(df, text_col, **tfidf)
    weight = "weight" if balanced else None
    weighted = X.with_class_weight(df, label, weight) if balanced else df
    make = lambda rows: logreg(rows, c=c, weight=weight)
    return train(text_model.transform(weighted), make, label, weight=weight, stages=text_model.stages)


def train_on_vectors(df: DataFrame, vec: str, label: str, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Logistic regression on an ``array<float>`` embedding column (see ``with_features``)."""
    return train(with_features(df, vec), lambda rows: logreg(rows, c=c, max_iter=max_iter), label)


def with_features(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    """Array column as an MLlib vector column."""
    return df.withColumn(out, array_to_vector(F.col(vec)))


def hybrid_features(
    df: DataFrame, key: str, text_col: str, vectors: DataFrame, vec: str, max_features: int = 2000, **tfidf
) -> tuple[DataFrame, PipelineModel]:
    """TF-IDF and embedding side by side, joined by key; returns the rows and the text stages."""
    text_model = X.fit_tfidf(df, text_col, out="tfidf", max_features=max_features, **tfidf)
    joined = with_features(text_model.transform(df).join(vectors.select(key, vec), key), vec, "embedding_vector")
    both = VectorAssembler(inputCols=["tfidf", "embedding_vector"], outputCol="features").transform(joined)
    return both.select(*df.columns, "features"), text_model


def train_hybrid(
    df: DataFrame, key: str, text_col: str, label: str, vectors: DataFrame, vec: str, c: float = 1.0, **tfidf
) -> PipelineModel:
    """Logistic regression on TF-IDF and embedding together."""
    both, _ = hybrid_features(df, key, text_col, vectors, vec, **tfidf)
    return train(both, lambda rows: logreg(rows, c=c), label)


def reduce_dims(df: DataFrame, vec: str, k: int = 50, out: str = "reduced") -> tuple[DataFrame, float]:
    """Centre, project to k principal components; also the explained variance."""
    prepared = with_features(df, vec, "_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False).fit(prepared)
    centred = scaler.transform(prepared)
    pca = PCA(k=k, inputCol="_centred", outputCol="_projected").fit(centred)
    reduced = pca.transform(centred).withColumn(out, vector_to_array("_projected"))
    return reduced.drop("_raw", "_centred", "_projected"), float(sum(pca.explainedVariance.toArray()))


# --- prediction --------------------------------------------------------------------
def predict_batch(df: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """Label, class probabilities and largest probability per row, in one pass."""
    scored = model.transform(df)
    probabilities = vector_to_array("probability")
    return scored.select(
        *keep,
        F.col("predicted_label").alias("prediction"),
        probabilities.alias("probability"),
        F.array_max(probabilities).alias("confidence"),
    )


def predicted_labels(df: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """Label only, for models without probabilities."""
    return model.transform(df).select(*keep, F.col("predicted_label").alias("prediction"))


def score(df: DataFrame, model: PipelineModel, label: str) -> float:
    """Accuracy on labelled rows."""
    row = E.accuracy(predicted_labels(df, model, [label]), label, "prediction").first()
    return float(row["accuracy"] or 0.0)


def top_features(model: PipelineModel, spark, n: int = 5) -> DataFrame:
    """Terms with the largest coefficients per class of a text logistic regression."""
    stages = {type(s).__name__: s for s in model.stages}
    terms = stages["CountVectorizerModel"].vocabulary
    labels = stages["IndexToString"].getLabels()
    matrix = stages["LogisticRegressionModel"].coefficientMatrix.toArray()
    # classes x max_features numbers of the model itself.
    rows = [(labels[i], t, float(w)) for i in range(len(labels)) for t, w in zip(terms, matrix[i])]
    table = spark.createDataFrame(rows, "category string, term string, coefficient double")
    order = W.partitionBy("category").orderBy(F.desc("coefficient"), "term")
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


# --- comparison, tuning, validation ------------------------------------------------
def compare_models(
    train_df: DataFrame,
    test_df: DataFrame,
    estimators: Mapping[str, object],
    label: str,
    predictors: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Accuracy and training time per classifier on a shared, prepared split, best first.

    ``predictors`` are classifiers without a training step, such as nearest
    neighbours: (train, test) -> rows with the label and a ``prediction``.
    """
    train_df.persist()
    test_df.persist()
    rows = []
    try:
        for name, estimator in estimators.items():
            started = time.time()
            model = train(train_df, estimator, label)
            elapsed = time.time() - started
            rows.append((name, score(test_df, model, label), elapsed))
        for name, predict in (predictors or {}).items():
            right = E.accuracy(predict(train_df, test_df), label, "prediction").first()["accuracy"]
            rows.append((name, float(right or 0.0), 0.0))
    finally:
        train_df.unpersist()
        test_df.unpersist()
    results = train_df.sparkSession.createDataFrame(rows, "classifier string, accuracy double, train_time double")
    return results.orderBy(F.desc("accuracy"), "classifier")


class MacroF1Evaluator(Evaluator):
    """Unweighted mean of the per-class F1 scores; larger is better."""

    def __init__(self, label: str = "label_index", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(E.macro_f1(dataset, self.label, self.prediction).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def grid_search(
    df: DataFrame,
    label: str,
    key: str,
    c_values: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0),
    folds: int = 3,
    tune_rows: int | None = None,
    weight: str | None = None,
    max_iter: int = 1000,
    parallelism: int = PARALLEL_FITS,
) -> tuple[DataFrame, PipelineModel]:
    """Grid over C and solver with stratified folds and macro F1; refits the best on all rows.

    The solver grid is the multinomial form and the one-vs-rest form.  Returns
    (results, best model).
    """
    indexer = X.label_indexer(label).fit(df)
    subset = S.sample_n(df, tune_rows, key) if tune_rows else df
    assigned = S.kfold_assign(indexer.transform(subset), label, key, folds).persist()
    rows = []
    try:
        n = assigned.count()
        tuned = X.sized(assigned, n, GRID_ROWS_PER_TASK)
        solvers = {
            "multinomial": logreg(n, weight=weight, max_iter=max_iter),
            "one-vs-rest": one_vs_rest_logreg(n, max_iter=max_iter, weight=weight),
        }
        for solver, estimator in solvers.items():
            inner = estimator if solver == "multinomial" else estimator.getClassifier()
            values = [X.regularisation(c, n) for c in c_values]
            if solver == "multinomial":
                grid = ParamGridBuilder().addGrid(inner.regParam, values).build()
            else:
                choices = [inner.copy({inner.regParam: v}) for v in values]
                grid = ParamGridBuilder().addGrid(estimator.classifier, choices).build()
            search = CrossValidator(
                estimator=estimator, estimatorParamMaps=grid, evaluator=MacroF1Evaluator(), numFolds=folds,
                foldCol="fold", parallelism=parallelism,
            ).fit(tuned)
            rows += [(solver, float(c), float(m)) for c, m in zip(c_values, search.avgMetrics)]
    finally:
        assigned.unpersist()
    best = max(rows, key=lambda r: r[2])
    total = df.count()
    estimator = (
        logreg(total, c=best[1], weight=weight, max_iter=max_iter)
        if best[0] == "multinomial"
        else one_vs_rest_logreg(total, c=best[1], max_iter=max_iter, weight=weight)
    )
    fitted = estimator.fit(indexer.transform(df))
    results = df.sparkSession.createDataFrame(rows, "solver string, c double, macro_f1 double")
    return results.orderBy(F.desc("macro_f1")), _with_label_names([fitted], indexer)


def keep_if_better(
    current: PipelineModel, candidate: PipelineModel, test_df: DataFrame, label: str
) -> tuple[PipelineModel, float]:
    """The candidate when it scores higher on the test rows, else the current model."""
    old, new = score(test_df, current, label), score(test_df, candidate, label)
    return (candidate, new) if new > old else (current, old)


def cross_validate(
    df: DataFrame, label: str, key: str, fit: Callable[[DataFrame], PipelineModel], folds: int = 5
) -> DataFrame:
    """Accuracy per stratified fold; at most as many folds as classes.

    ``fit`` trains on the other folds only, so no text statistics leak into a fold.
    """
    folds = min(folds, df.select(label).distinct().count())
    # Stored once: every fold reads the same assignment, also after a lost executor.
    assigned = materialise(S.kfold_assign(df, label, key, folds), "folds")
    rows = []
    for i in range(folds):
        model = fit(assigned.filter(F.col("fold") != i).drop("fold"))
        rows.append((i, score(assigned.filter(F.col("fold") == i).drop("fold"), model, label)))
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.agg(
        F.count("*").alias("folds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy")
    )


def low_feature_probe(train_df: DataFrame, test_df: DataFrame, text_col: str, label: str, features: int = 100) -> float:
    """Accuracy with only the most frequent terms: high values hint at a leak."""
    model = train_logreg(train_df, text_col, label, max_features=features, min_df=1, max_df=1.0, stopwords=())
    return score(test_df, model, label)


def train_baseline(
    df: DataFrame, key: str, text_col: str, label: str, test: float = 0.2, c: float = 1.0, **tfidf
) -> tuple[PipelineModel, DataFrame]:
    """Clean rows -> stratified split -> TF-IDF logistic regression -> test predictions."""
    usable = filter_nonempty(df.select(key, text_col, label), [text_col])
    usable = usable.filter(F.col(label).isNotNull())
    split = materialise(S.stratified_split(usable, label, key, test), "split")
    train_df = split.filter(~F.col("is_test")).drop("is_test")
    if train_df.isEmpty():
        raise ValueError("no valid records after cleaning")
    model = train_logreg(train_df, text_col, label, c=c, **tfidf)
    return model, predict_batch(split.filter("is_test"), model, [key, label])


def default_estimators() -> dict[str, object]:
    """The classifiers of the standard comparison."""
    return {
        "Logistic Regression": logreg,
        "Linear SVM": linear_svm,
        "Naive Bayes": naive_bayes(),
        "Decision Tree": decision_tree(),
        "Random Forest": random_forest(),
        "Gradient Boosting": gradient_boosting(),
    }
