import math
import re

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketloom.operators import boosting
from ticketloom.operators import evaluate as E
from ticketloom.operators import features as X
from ticketloom.operators import label as L
from ticketloom.operators import models as M
from ticketloom.operators import sampling as S
from ticketloom.operators import trees
from ticketloom.plans import model_queries as Q
from ticketloom.sources import logs as G

# Published confusion matrix (true rows, predicted columns) and class scores.
CLASSES = ["Account", "Billing", "Fraud", "General Inquiry", "Technical"]
MATRIX = [
    [20985, 649, 130, 1283, 1435],
    [1132, 8771, 90, 822, 811],
    [586, 237, 859, 452, 374],
    [1355, 699, 110, 10449, 1483],
    [1395, 673, 104, 1471, 13015],
]
PUBLISHED = {
    "Account": (0.8244607708325148, 0.8571603627154645, 0.8404926404325623, 24482),
    "Billing": (0.7952670233022033, 0.754429726475142, 0.7743103067755462, 11626),
    "Fraud": (0.6643464810518175, 0.34250398724082937, 0.4519863193896343, 2508),
    "General Inquiry": (0.7217655591628099, 0.7412741203178207, 0.731389773562454, 14096),
    "Technical": (0.76031078397009, 0.7813062792652179, 0.7706655613453339, 16658),
}


def test_published_confusion_matrix(spark):
    rows = [(CLASSES[i], CLASSES[j], MATRIX[i][j]) for i in range(5) for j in range(5)]
    counts = spark.createDataFrame(rows, "truth string, prediction string, n long")
    report = {r["category"]: r for r in E.per_class_from_counts(counts).collect()}
    for name, (p, r, f, n) in PUBLISHED.items():
        got = report[name]
        assert (got["precision"], got["recall"], got["f1"]) == pytest.approx((p, r, f), abs=1e-12)
        assert got["support"] == n
    spread = counts.select("truth", "prediction", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    assert E.accuracy(spread, "truth", "prediction").first()["accuracy"] == round(0.7795733025803662, 6)
    assert E.most_confused_with(spread, "truth", "prediction").filter("truth = 'Fraud'").first()["most_confused"] == "Account"
    matrix = {r["truth"]: [r[c] for c in CLASSES] for r in E.confusion_matrix(spread, "truth", "prediction", CLASSES).collect()}
    assert [matrix[c] for c in CLASSES] == MATRIX


def test_perfect_and_absent_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (2, 2), (0, 0)], "t int, p int")
    assert E.weighted_prf(df, "t", "p").first()["accuracy"] == 1.0
    wrong = spark.createDataFrame([("a", "b"), ("a", "a")], "t string, p string")
    got = {r["category"]: (r["precision"], r["recall"], r["support"]) for r in E.per_class_prf(wrong, "t", "p", averages=False).collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.0, 0.0, 0)}


DOCS = [
    (1, "refund my card card payment", "billing"), (2, "card refund please refund", "billing"),
    (3, "payment card billing refund", "billing"), (4, "app crash error screen", "technical"),
    (5, "error crash again app app", "technical"), (6, "screen error crash now", "technical"),
    (7, "parcel late delivery", "delivery"), (8, "delivery parcel lost", "delivery"),
    (9, "late parcel delivery delivery", "delivery"),
]


def _docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string, label string")


def test_tfidf_against_the_formula(spark):
    got = {(r["id"], r["term"]): r["weight"] for r in X.tfidf(_docs(spark), "id", "text", min_df=2, max_df=0.5, stopwords=()).collect()}
    docs = {i: t.split() for i, t, _ in DOCS}
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    vocab = {w for w, n in df.items() if 2 <= n <= 4.5}
    for i, words in docs.items():
        raw = {w: words.count(w) * (math.log(10 / (1 + df[w])) + 1) for w in set(words) & vocab}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert got.pop((i, w)) == pytest.approx(v / norm, abs=1e-9)
    assert not got


def test_text_model_trains_saves_and_labels(spark, tmp_path):
    df = _docs(spark)
    model = M.train_logreg(df.withColumnRenamed("text", "clean_text"), "clean_text", "label", max_df=1.0, balanced=True)
    path = str(tmp_path / "m")
    G.save_model(model, path, {"type": "tfidf-logreg"})
    loaded, config = G.load_model(spark, path)
    assert config == {"type": "tfidf-logreg"}
    scored = M.predict_batch(df.withColumnRenamed("text", "clean_text"), loaded, ["id", "label"])
    assert scored.filter("label = prediction").count() == 9
    row = scored.first()
    assert row["confidence"] == max(row["probability"]) and sum(row["probability"]) == pytest.approx(1)
    messages = spark.createDataFrame([(1, "the app crash error screen"), (2, "d1"), (3, "zzz qqq")], "id int, text string")
    kept = L.pseudo_label(messages, loaded, threshold=0.5).collect()
    assert [(r["id"], r["predicted_category"], r["source"]) for r in kept] == [(1, "technical", "twitter")]
    assert tuple(L.pseudo_label_counts(messages, loaded, threshold=0.5).first()) == (2, 1)
    top = {r["category"]: r["term"] for r in M.top_features(loaded, spark, 1).collect()}
    assert top["delivery"] in ("delivery", "parcel")
    with pytest.raises(FileNotFoundError):
        G.load_model(spark, str(tmp_path / "none"))


def test_weights_and_regularisation(spark):
    got = {r["label"]: r["weight"] for r in X.class_weights(_docs(spark).filter("id <> 9"), "label").collect()}
    assert got == {"billing": round(8 / 9, 6), "technical": round(8 / 9, 6), "delivery": round(8 / 6, 6)}
    assert X.regularisation(0.5, 100) == 0.02
    assert [tuple(r) for r in X.label_index(_docs(spark), "label").orderBy("index").collect()] == [
        ("billing", 0), ("delivery", 1), ("technical", 2)
    ]


def _points(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 0.3 + np.eye(4)[i % 3] * 3).tolist(), "abc"[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, vec array<double>, label string")


def test_vector_models_and_cross_validation(spark):
    df = M.with_features(_points(spark), "vec")
    for estimator in (M.logreg, M.linear_svm, M.random_forest(trees=5, depth=4), M.decision_tree(depth=4)):
        assert M.score(df, M.train(df, estimator, "label"), "label") > 0.95
    scores = M.cross_validate(df, "label", "id", lambda part: M.train(part, M.logreg, "label"), folds=5)
    assert scores.count() == 3
    assert M.cv_summary(scores).first()["mean_accuracy"] > 0.95


def _matrix(df):
    rows = sorted(df.collect(), key=lambda r: r["id"])
    x, y = np.array([r["vec"] for r in rows]), np.array(["abc".index(r["label"]) for r in rows])
    return x, y


def test_logistic_regression_is_the_optimum(spark):
    """Mean log loss and half the penalty, by plain gradient descent."""
    df = M.with_features(_points(spark), "vec")
    x, y = _matrix(df)
    for c in (0.1, 1.0):
        model = M.train(df, lambda rows, c=c: M.logreg(rows, c=c), "label").stages[-2]
        reg, hot, w, b = 1 / (c * len(x)), np.eye(3)[y], np.zeros((3, 4)), np.zeros(3)

        def loss(w, b):
            z = x @ w.T + b
            return (np.log(np.exp(z).sum(1)) - z[np.arange(len(x)), y]).mean() + reg / 2 * (w * w).sum()

        for _ in range(20000):
            p = np.exp(x @ w.T + b)
            p = (p / p.sum(1, keepdims=True) - hot) / len(x)
            w, b = w - 0.3 * (p.T @ x + reg * w), b - 0.3 * p.sum(0)
        got, shift = model.coefficientMatrix.toArray(), np.array(model.interceptVector.toArray())
        assert loss(got, shift) == pytest.approx(loss(w, b), abs=1e-4)
        assert np.abs(got - w).max() < 0.05


def test_linear_svm_is_the_optimum(spark):
    """Mean hinge loss and half the penalty of one class against the rest, by plain subgradient steps."""
    df = M.with_features(_points(spark), "vec")
    x, y = _matrix(df)
    reg, found = 1 / len(x), M.train(df, M.linear_svm, "label").stages[-2].models
    for k, model in enumerate(found):
        sign = np.where(y == k, 1, -1)

        def loss(w, b):
            return np.maximum(0, 1 - sign * (x @ w + b)).mean() + reg / 2 * (w * w).sum()

        w, b, best = np.zeros(4), 0.0, np.inf
        for step in range(1, 30001):
            wrong = (sign * (x @ w + b) < 1) * sign
            rate = 2 / np.sqrt(step)
            w, b = w - rate * (reg * w - x.T @ wrong / len(x)), b + rate * wrong.mean()
            best = min(best, loss(w, b))
        assert loss(model.coefficients.toArray(), model.intercept) < best + 5e-3


def test_tree_splits_where_gini_is_least(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = np.where(rng.random(300) < 0.15, rng.integers(0, 3, 300), (x[:, 1] > 5) + ((x[:, 1] > 5) & (x[:, 2] > 5)).astype(int))
    rows = [(i, v.tolist(), "abc"[k]) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    df = M.with_features(spark.createDataFrame(rows, "id int, vec array<double>, label string"), "vec")
    printed = M.train(df, M.decision_tree(depth=1), "label").stages[-2].toDebugString
    feature, threshold = re.search(r"If \(feature (\d+) <= ([\d.]+)\)", printed).groups()

    def impurity(part):
        return len(part) * (1 - sum((np.mean(part == k) if len(part) else 0) ** 2 for k in range(3)))

    splits = {(j, t): impurity(y[x[:, j] <= t]) + impurity(y[x[:, j] > t]) for j in range(3) for t in np.arange(0.5, 8)}
    assert splits[int(feature), float(threshold)] == pytest.approx(min(splits.values()))


def test_a_tuned_model_is_kept_only_where_it_is_better(spark, sf_dir):
    row = Q.tune_and_keep(spark, sf_dir).first()
    assert row["accuracy_kept"] >= row["accuracy_before"] and row["replaced"] == (row["accuracy_kept"] > row["accuracy_before"])
    assert row["solver"] in ("multinomial", "one-vs-rest") and row["c"] in (0.01, 0.1, 1.0, 10.0, 100.0)


def test_grid_search_and_keep_if_better(spark):
    df = M.with_features(_points(spark, 60), "vec")
    results, best = M.grid_search(df, "label", "id", c_values=(0.1, 1.0), folds=3, max_iter=20)
    assert results.count() == 4
    kept, value = M.keep_if_better(best, best, df, "label")
    assert kept is best and value > 0.9


def test_pca_matches_numpy(spark):
    df = _points(spark)
    reduced, explained = M.reduce_dims(df, "vec", 2)
    x = np.array([r["vec"] for r in df.collect()])
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert explained == pytest.approx(values[:2].sum() / values.sum(), abs=1e-9)
    got = np.array([r["reduced"] for r in reduced.orderBy("id").collect()])
    assert np.allclose(got.mean(0), 0, atol=1e-9)


def test_baseline_training(spark):
    rows = [(i, t + " " + t, c) for i, t, c in DOCS] + [(i + 100, t, c) for i, t, c in DOCS] + [(500, "  ", "billing")]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    _, predictions = M.train_baseline(df, "id", "text", "label", max_df=1.0)
    assert predictions.count() == 3
    with pytest.raises(ValueError):
        M.train_baseline(df.filter("id = 500"), "id", "text", "label")


def test_the_text_classifiers_see_ten_thousand_terms_and_bigrams(spark, sf_dir):
    train, _ = Q._text_split(spark, sf_dir)
    every = X.fit_tfidf(train, "text", max_features=1 << 18, max_df=0.7, min_df=2, ngram=(1, 2))
    terms = next(s for s in every.stages if type(s).__name__ == "CountVectorizerModel").vocabulary
    features, _ = Q._text_features(spark, sf_dir)
    assert any(" " in t for t in terms)
    assert features.first()["features"].size == min(len(terms), 10000) and Q.TFIDF["max_features"] == 10000


def test_split_in_place_marks_the_same_rows_and_moves_no_text(spark):
    rows = [(i, "x" * 50 + str(i), [None, "a", "b", "c"][i % 4 if i % 7 else 0]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(3)
    marked = lambda d: sorted(((r.id, r.text, r.is_test) for r in d.collect()), key=str)
    got = S.split_in_place(df, "label", "id")
    assert marked(got) == marked(S.stratified_split(df, "label", "id")) and got.columns == [*df.columns, "is_test"]
    # The rows themselves keep their partitions.
    assert got.rdd.getNumPartitions() == 3
    # Copies of keys, on the line between the parts as well, and rows without a key.
    copies = df.unionByName(df).unionByName(df.filter("id < 5").withColumn("id", F.lit(None).cast("long")))
    keys = lambda d: sorted(((r.id, r.is_test) for r in d.collect()), key=str)
    assert keys(S.split_in_place(copies, "label", "id", 0.13)) == keys(S.stratified_split(copies, "label", "id", 0.13))


def test_training_sets_use_the_cores_and_weights_do_not_gather_classes(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label")).coalesce(1)
    assert X.sized(df, 8000).rdd.getNumPartitions() == cores
    assert X.sized(df.repartition(16), 900).rdd.getNumPartitions() == 1
    assert X.sized(df.repartition(60), 500_000, M.GRID_ROWS_PER_TASK).rdd.getNumPartitions() == 10
    assert X.with_class_weight(df.repartition(9), "label").rdd.getNumPartitions() == 9


def test_boosting_on_sparse_rows_is_one_vs_rest_boosting(spark):
    """Same first trees and predictions as MLlib's, one class after the other; features of few and of many values, an empty partition."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        x = np.where(rng.random(6) < 0.5, rng.random(6), 0.0)
        x[4], x[5] = rng.integers(0, 3), 0.0
        k = int(x[0] > 0.4) + int(x[1] > 0.5) if rng.random() < 0.9 else int(rng.integers(0, 3))
        rows.append((i, Vectors.sparse(6, {j: float(v) for j, v in enumerate(x) if v}) if i % 3 else Vectors.dense(x), "abc"[k]))
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    df = df.repartition(3).unionByName(df.limit(0)).cache()
    plain = OneVsRest(classifier=GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.1), labelCol="label_index")
    own, other = M.train(df, M.gradient_boosting(rounds=6), "label"), M.train(df, plain, "label")
    predicted = lambda m: sorted(map(tuple, M.predicted_labels(df, m, ["id"]).collect()))
    assert predicted(own) == predicted(other)
    # All classes grow in one round.
    model = own.stages[-2]
    assert [len(trees) for trees in model.trees] == [3] * 6
    for k, theirs in enumerate(other.stages[-2].models):
        printed = re.search(r"If \(feature (\d+) <= ([\d.]+)\)", theirs.trees[0].toDebugString).groups()
        feature, split = model.trees[0][k]["splits"][0]
        assert (feature, model.points[feature, split]) == (int(printed[0]), pytest.approx(float(printed[1])))


def test_boosting_moves_entries_once_whatever_the_parts(spark, monkeypatch):
    """No level sums up by a shuffle; features in one part or in many, several partitions and none."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        x = np.where(rng.random(30) < 0.4, rng.integers(1, 9, 30) / 8, 0.0)
        rows.append((Vectors.sparse(30, {j: float(v) for j, v in enumerate(x) if v}), "abc"[int(x[3] > 0.4) + int(x[17] > 0.3)]))
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(3).cache()
    calls, partition_by = [], RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, *a, **k: calls.append(a) or partition_by(self, *a, **k))
    found = []
    for entries in (4_000_000, 40):
        monkeypatch.setattr(boosting, "PART_ENTRIES", entries)
        calls.clear()
        model = M.train(df, M.gradient_boosting(rounds=4), "label").stages[-2]
        # Split points and entries by feature.
        assert len(calls) == 2
        found.append([[tree["splits"] for tree in trees] for trees in model.trees])
    assert found[0] == found[1] and all(tree for trees in found[0] for tree in trees)


def test_forests_keep_the_nodes_of_rows_between_passes():
    assert M.random_forest().getCacheNodeIds()


def test_the_language_model_learns_from_texts_that_are_cleaned_once(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "train_logreg", lambda df, *_, **__: seen.append(df))
    Q._language_model(spark, sf_dir)
    assert all("clean-texts" in f for f in seen[0].inputFiles()) and seen[0].inputFiles()


def _sparse_rows(spark, n=400):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        x = np.where(rng.random(40) < 0.3, rng.random(40), 0.0)
        x[1], x[2], x[3] = rng.integers(-2, 3), rng.integers(-3, 0), 0.0
        k = int(x[0] > 0.4) + int(x[1] > 0) if rng.random() < 0.8 else int(rng.integers(0, 3))
        rows.append((i, Vectors.sparse(40, {j: float(v) for j, v in enumerate(x) if v}) if i % 3 else Vectors.dense(x), "abc"[k]))
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    return df.repartition(5).unionByName(df.filter("id < 40")).unionByName(df.limit(0)).cache()


@pytest.mark.parametrize(("local_rows", "part", "cells"), [(20_000, 256, 4_000_000), (30, 16, 4000), (0, 7, 1)])
def test_trees_on_sparse_rows_are_the_trees_of_mllib(spark, monkeypatch, local_rows, part, cells):
    """Grown by one task, by groups of small nodes, or all by sums; negative values, copies of rows, an empty partition."""
    for name, value in (("LOCAL_ROWS", local_rows), ("PART_FEATURES", part), ("PART_CELLS", cells), ("ENTRIES_AT_A_TIME", 500)):
        monkeypatch.setattr(trees, name, value)
    df = _sparse_rows(spark)
    for depth in (0, 2, 30):
        own = M.train(df, M.decision_tree(depth=depth), "label")
        other = M.train(df, DecisionTreeClassifier(labelCol="label_index", maxDepth=depth), "label")
        splits = lambda m: re.findall(r"If \(feature (\d+) <= ([-\d.eE]+)\)", m.stages[-2].toDebugString)
        exact = lambda m: [(int(f), float(t)) for f, t in splits(m)]
        assert exact(own) == exact(other) and own.stages[-2].numNodes == other.stages[-2].numNodes
        predicted = lambda m: sorted(map(str, M.predict_batch(df, m, ["id"]).collect()))
        assert predicted(own) == predicted(other)


def test_trees_send_the_cells_that_rows_touch_not_a_table_of_all_features(spark, monkeypatch):
    """A hundred thousand features: a bin of each for every row, or a table of them for every node, would be large."""
    rng = np.random.default_rng(9)
    rows = [(i, Vectors.sparse(100_000, {int(j): 1.0 for j in {i % 3, *rng.integers(3, 100_000, 5)}}), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, ["id", "features", "label"]).repartition(3).cache()
    sent = []
    cells = trees._cells
    monkeypatch.setattr(trees, "_cells", lambda *a: sent.append(cells(*a)) or sent[-1])
    bins = trees.Bins(np.full((100_000, 1), 0.5))
    rows = trees._rows(((r["features"], "abc".index(r["label"])) for r in df.collect()), bins)
    assert len(rows.codes) == sum(len(r["features"].indices) for r in df.collect())
    grown = trees._grown(rows, np.zeros(300, np.int64), trees.Tree(counts={0: np.array([100, 100, 100])}), bins, 30)
    assert len(grown.splits) == 2 and max(len(keys) for keys, _ in sent) <= len(rows.codes)
    assert M.score(df, M.train(df, M.decision_tree(), "label"), "label") == 1.0


def test_trees_are_saved_and_loaded(spark, tmp_path):
    df = _sparse_rows(spark, 120)
    model = M.train(df, M.decision_tree(), "label")
    G.save_model(model, str(tmp_path / "tree"), {"type": "tree"})
    loaded, _ = G.load_model(spark, str(tmp_path / "tree"))
    predicted = lambda m: sorted(map(str, M.predict_batch(df, m, ["id"]).collect()))
    assert predicted(loaded) == predicted(model) and loaded.stages[-2].toDebugString == model.stages[-2].toDebugString


def test_trees_refuse_what_mllib_refuses(spark):
    df = _sparse_rows(spark, 30)
    with pytest.raises(ValueError, match="depth"):
        M.train(df, M.decision_tree(depth=31), "label")
    with pytest.raises(ValueError, match="finite"):
        trees._rows([(Vectors.dense([float("nan")]), 0.0)], trees.Bins(np.full((1, 1), 0.5)))
