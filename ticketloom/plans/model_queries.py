"""Queries for features, classifiers and streams.

Text models learn the language of the documents, vector models the class of the
stored embeddings; both use the hash split.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.operators import columns as C
from ticketloom.operators import evaluate as E
from ticketloom.operators import features as X
from ticketloom.operators import label as L
from ticketloom.operators import models as M
from ticketloom.operators import monitor as O
from ticketloom.operators import sampling as S
from ticketloom.operators import terms as R
from ticketloom.operators import vectors as V
from ticketloom.plans import sqltext as Q
from ticketloom.plans.label_queries import CLEAN_MESSAGES_SQL, CLEAN_SQL, hash_rank_sql, messages_of
from ticketloom.plans.registry import query, table, table_stream, text_table
from ticketloom.plans.report_queries import DAY, WEEK, class_report_sql
from ticketloom.plans.vector_queries import embed_sql
from ticketloom.plans.views import ticket_view, tickets_of, with_views
from ticketloom.session import broadcast_if_small, materialise, work_path
from ticketloom.sources import logs as G
from ticketloom.streaming import backfill as B
from ticketloom.streaming import jobs as J

LABEL = "category"
# Terms of one and two words, no stop list and no limits by document frequency.
TFIDF = {"max_features": 10000, "min_df": 1, "max_df": 1.0, "ngram": (1, 2), "stopwords": ()}


# --- features ----------------------------------------------------------------------
def tfidf_sql(max_features: int, min_df: int, max_df: float, ngram: bool = False) -> str:
    terms = "w" if not ngram else (
        "list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))"
    )
    return f"""
    WITH words AS (SELECT doc_id, unnest({terms}) AS term
                   FROM (SELECT doc_id, {Q.tokens('text', K.ENGLISH_STOPWORDS)} AS w FROM documents)),
         tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
         n AS (SELECT count(*)::DOUBLE AS n FROM documents),
         vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY term
                   HAVING count(*) >= {min_df} AND count(*) <= (SELECT n FROM n) * {max_df}::DOUBLE
                   ORDER BY sum(tf) DESC, term LIMIT {max_features}),
         weighted AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n)
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted
    """


@query("tfidf", tfidf_sql(3000, 2, 0.7))
def tfidf(spark, sf_dir):
    weights = X.tfidf(text_table(spark, sf_dir, "documents"), "doc_id", "text", 3000, 2, 0.7)
    return weights.withColumn("weight", F.round("weight", 6))


@query("tfidf_bigrams", tfidf_sql(3000, 2, 0.7, ngram=True))
def tfidf_bigrams(spark, sf_dir):
    weights = X.tfidf(text_table(spark, sf_dir, "documents"), "doc_id", "text", 3000, 2, 0.7, ngram=(1, 2))
    return weights.withColumn("weight", F.round("weight", 6))


@query("tfidf_vectors", tfidf_sql(1 << 18, 3, 0.7))
def tfidf_vectors(spark, sf_dir):
    """The MLlib form, unfolded to terms: the same weights."""
    documents = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = X.fit_tfidf(documents, "text", max_features=1 << 18, min_df=3, max_df=0.7)
    counter = next(s for s in model.stages if type(s).__name__ == "CountVectorizerModel")
    terms = spark.createDataFrame(list(enumerate(counter.vocabulary)), "index int, term string")
    entries = X.vector_entries(model.transform(documents), "doc_id", "features")
    return entries.join(F.broadcast(terms), "index").select("doc_id", "term", F.round("value", 6).alias("weight"))


@query(
    "term_counts",
    f"SELECT term, count(*) AS n FROM (SELECT unnest({Q.tokens('text', K.ENGLISH_STOPWORDS)}) AS term FROM documents) "
    "GROUP BY term ORDER BY n DESC, term LIMIT 50",
)
def term_counts(spark, sf_dir):
    return X.term_counts(text_table(spark, sf_dir, "documents"), "text")


@query("label_index", "SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS index FROM documents GROUP BY source")
def label_index(spark, sf_dir):
    return X.label_index(text_table(spark, sf_dir, "documents"), "source")


@query(
    "class_weights",
    with_views(
        "SELECT truth, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS weight "
        "FROM (SELECT truth, count(*) AS n FROM ticket_view GROUP BY truth)"
    ),
)
def class_weights(spark, sf_dir):
    return X.class_weights(ticket_view(spark, sf_dir), "truth")


# --- classifiers -------------------------------------------------------------------
def _documents(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias(LABEL))


def _text_split(spark, sf_dir):
    split = S.split_in_place(_documents(spark, sf_dir), LABEL, "doc_id")
    return split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")


def _text_features(spark, sf_dir):
    """TF-IDF columns of the split, fitted on the training part."""
    train, test = _text_split(spark, sf_dir)
    model = X.fit_tfidf(train, "text", **TFIDF)
    keep = ("doc_id", LABEL, "features")
    return model.transform(train).select(*keep), model.transform(test).select(*keep)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.col("label").cast("string").alias(LABEL))


def _vector_split(spark, sf_dir):
    split = M.with_features(S.stratified_split(_vectors(spark, sf_dir), LABEL, "vec_id"), "vec")
    return split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")


def _test_report(model, test):
    return E.per_class_prf(M.predicted_labels(test, model, [LABEL]), LABEL, "prediction")


def _text_model(spark, sf_dir):
    train, _ = _text_split(spark, sf_dir)
    return M.train_logreg(train, "text", LABEL, **TFIDF)


@query("train_logreg")
def train_logreg(spark, sf_dir):
    _, test = _text_split(spark, sf_dir)
    return _test_report(_text_model(spark, sf_dir), test)


@query("train_logreg_balanced")
def train_logreg_balanced(spark, sf_dir):
    train, test = _text_split(spark, sf_dir)
    return _test_report(M.train_logreg(train, "text", LABEL, c=0.1, balanced=True, **TFIDF), test)


@query("predict_batch")
def predict_batch(spark, sf_dir):
    _, test = _text_split(spark, sf_dir)
    return M.predict_batch(test, _text_model(spark, sf_dir), ["doc_id"]).select("doc_id", "prediction", F.round("confidence", 4).alias("confidence"))


@query("train_linear_svm")
def train_linear_svm(spark, sf_dir):
    train, test = _text_features(spark, sf_dir)
    return _test_report(M.train(train, M.linear_svm, LABEL), test)


def _term_split(spark, sf_dir):
    """Term weights of all documents with their class and part, the training classes' sizes, and the documents' parts."""
    documents = _documents(spark, sf_dir)
    parts = S.stratified_split(documents.select("doc_id", LABEL), LABEL, "doc_id")
    # Only keys and flags are ranked; texts are read in place where the flags are few enough to travel.
    flags = broadcast_if_small(parts.select("doc_id", "is_test"), "split-flags")
    lists = R.term_lists(documents.join(flags, "doc_id"), "text", (), (1, 2), ["doc_id", LABEL, "is_test"])
    training = lists.filter(~F.col("is_test"))
    sizes = parts.filter(~F.col("is_test")).groupBy(LABEL).agg(F.count("*").alias("n"))
    idf = R.idf_of(R.vocabulary(training, 10000, 1, 1.0), training.count())
    return R.term_weights(lists, "doc_id", idf, [LABEL, "is_test"]), sizes, parts, len(idf)


def term_split_sql() -> str:
    """Documents with their part, and unit-length weights over the 10,000 most frequent terms of the training part."""
    grams = "list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))"
    return f"""
    split AS (SELECT doc_id, lang AS category, text,
                     {hash_rank_sql('doc_id', 'lang')} <= floor(count(*) OVER (PARTITION BY lang) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test
              FROM documents),
    words AS (SELECT doc_id, is_test, unnest({grams}) AS term FROM (SELECT doc_id, is_test, {Q.tokens('text', ())} AS w FROM split)),
    tf AS (SELECT doc_id, is_test, term, count(*) AS tf FROM words GROUP BY ALL),
    n AS (SELECT count(*)::DOUBLE AS n FROM split WHERE NOT is_test),
    vocab AS (SELECT term, count(*) AS df FROM tf WHERE NOT is_test GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
    weighted AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n),
    unit AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weighted)
    """


BAYES_SQL = f"""
WITH {term_split_sql()},
sums AS (SELECT category, term, sum(w) AS s FROM unit JOIN split USING (doc_id) WHERE NOT is_test GROUP BY category, term),
classes AS (SELECT category, ln(count(*) + 1) - ln((SELECT n FROM n) + count(*) OVER ()) AS prior FROM split WHERE NOT is_test GROUP BY category),
below AS (SELECT category, any_value(prior) AS prior, ln(coalesce(sum(s), 0) + (SELECT count(*) FROM vocab)) AS below
          FROM classes LEFT JOIN sums USING (category) GROUP BY category),
tests AS (SELECT doc_id, any_value(s.category) AS truth, coalesce(sum(w), 0) AS total
          FROM split s LEFT JOIN unit USING (doc_id) WHERE is_test GROUP BY doc_id),
gains AS (SELECT doc_id, s.category, sum(w * ln(s.s + 1)) AS gain FROM unit JOIN sums s USING (term) GROUP BY doc_id, s.category),
scores AS (SELECT t.doc_id, truth, b.category, prior - total * below + coalesce(gain, 0) AS score
           FROM tests t CROSS JOIN below b LEFT JOIN gains g ON g.doc_id = t.doc_id AND g.category = b.category),
found AS (SELECT doc_id, any_value(truth) AS truth, first(category ORDER BY score DESC, category) AS prediction,
                 1 / sum(exp(score - best)) AS confidence
          FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM scores) GROUP BY doc_id)
"""


def _bayes_predictions(spark, sf_dir):
    weights, sizes, parts, features = _term_split(spark, sf_dir)
    model = R.TermBayes.fit(weights.filter(~F.col("is_test")), sizes, LABEL, features)
    tests = parts.filter("is_test").select("doc_id", LABEL)
    return tests.join(model.predict(tests, weights.filter("is_test").select("doc_id", "term", "weight"), "doc_id"), "doc_id")


@query("naive_bayes_predictions", f"{BAYES_SQL} SELECT doc_id, prediction, round(confidence, 5) AS confidence FROM found")
def naive_bayes_predictions(spark, sf_dir):
    return _bayes_predictions(spark, sf_dir).select("doc_id", "prediction", F.round("confidence", 5).alias("confidence"))


@query("train_naive_bayes", f"{BAYES_SQL}, {class_report_sql('found')}")
def train_naive_bayes(spark, sf_dir):
    """Naive Bayes as tables of class and term sums."""
    return E.per_class_prf(_bayes_predictions(spark, sf_dir), LABEL, "prediction")


KNN_TEXT_SQL = f"""
WITH {term_split_sql()},
near AS (SELECT q.doc_id, d.doc_id AS id, round(sum(q.w * d.w), 6) AS score
         FROM (SELECT unit.* FROM unit JOIN split USING (doc_id) WHERE is_test) q
         JOIN (SELECT unit.* FROM unit JOIN split USING (doc_id) WHERE NOT is_test) d USING (term) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS rank FROM near),
votes AS (SELECT top.doc_id, category, count(*) AS votes FROM top JOIN split s ON s.doc_id = top.id WHERE rank <= 5 GROUP BY ALL)
SELECT doc_id, first(category ORDER BY votes DESC, category) AS prediction, max(votes) AS votes FROM votes GROUP BY doc_id
"""


def _knn_predictions(spark, sf_dir, k=5):
    weights, _, parts, _ = _term_split(spark, sf_dir)
    weights = materialise(weights, "term-weights")
    train, test = (weights.filter(c).select("doc_id", "term", "weight") for c in (~F.col("is_test"), F.col("is_test")))
    return R.knn_on_terms(train, test, parts.select("doc_id", LABEL), LABEL, "doc_id", k)


@query("knn_text", KNN_TEXT_SQL)
def knn_text(spark, sf_dir):
    """Five nearest training documents of every test document by TF-IDF, block by block."""
    return _knn_predictions(spark, sf_dir)


@query("train_decision_tree")
def train_decision_tree(spark, sf_dir):
    train, test = _text_features(spark, sf_dir)
    return _test_report(M.train(train, M.decision_tree(), LABEL), test)


@query("train_random_forest")
def train_random_forest(spark, sf_dir):
    train, test = _vector_split(spark, sf_dir)
    return _test_report(M.train(train, M.random_forest(trees=100), LABEL), test)


@query("train_gbt")
def train_gbt(spark, sf_dir):
    """Boosting on the document languages, 100 rounds per class."""
    train, test = _text_features(spark, sf_dir)
    return _test_report(M.train(train, M.gradient_boosting(), LABEL), test)


@query("train_on_vectors")
def train_on_vectors(spark, sf_dir):
    train, test = _vector_split(spark, sf_dir)
    return _test_report(M.train_on_vectors(train, "vec", LABEL), test)


def _document_vectors(spark, sf_dir):
    return V.embed_texts(_documents(spark, sf_dir), "text", "vec", 64).select("doc_id", "vec")


HYBRID_SQL = f"""
WITH weights AS ({tfidf_sql(2000, 2, 0.8).replace(", 6) AS weight", ", 15) AS weight")}),
sums AS (SELECT doc_id, count(*) AS n_terms, sum(weight) AS terms FROM weights GROUP BY doc_id)
SELECT doc_id, lang AS category, coalesce(n_terms, 0) AS n_terms, round(coalesce(terms, 0), 4) AS term_sum, round(list_sum(vec), 4) AS vector_sum
FROM documents LEFT JOIN sums USING (doc_id) JOIN ({embed_sql("documents", "doc_id", "text")}) USING (doc_id)
"""


@query("hybrid_features", HYBRID_SQL)
def hybrid_features(spark, sf_dir):
    """Term weights and embedding of every document side by side: how many weights, and both sums."""
    both, _ = M.hybrid_features(_documents(spark, sf_dir), "doc_id", "text", _document_vectors(spark, sf_dir), "vec")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    split = both.withColumn("_values", vector_to_array("features")).withColumn("_terms", F.size("_values") - 64)
    terms, vector = F.slice("_values", F.lit(1), F.col("_terms")), F.slice("_values", F.col("_terms") + 1, F.lit(64))
    return split.select(
        "doc_id",
        LABEL,
        F.size(F.filter(terms, lambda x: x != 0)).cast("long").alias("n_terms"),
        F.round(total(terms), 4).alias("term_sum"),
        F.round(total(vector), 4).alias("vector_sum"),
    )


@query("train_hybrid")
def train_hybrid(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    both, _ = M.hybrid_features(documents, "doc_id", "text", _document_vectors(spark, sf_dir), "vec", **TFIDF)
    split = S.split_in_place(both, LABEL, "doc_id")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    return _test_report(M.train(train, M.logreg, LABEL), test)


@query("reduce_dims", "SELECT vec_id, 50 AS dims FROM embeddings")
def reduce_dims(spark, sf_dir):
    reduced, _ = M.reduce_dims(_vectors(spark, sf_dir), "vec", 50)
    return reduced.select("vec_id", F.size("reduced").alias("dims"))


@query(
    "reduce_dims_all",
    "SELECT vec_id, round(sum((x - mean) * (x - mean)), 4) AS length FROM (SELECT vec_id, x, avg(x) OVER (PARTITION BY pos) AS mean "
    "FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)) GROUP BY vec_id",
)
def reduce_dims_all(spark, sf_dir):
    """With all components the projection only turns the centred vectors: squared lengths stay."""
    reduced, _ = M.reduce_dims(_vectors(spark, sf_dir), "vec", 64)
    return reduced.select("vec_id", F.round(F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


def _knn_predictor(train, test):
    near = V.knn_classify(train, test.withColumnRenamed("vec_id", "qid"), LABEL, "vec_id", "qid", k=10)
    return test.select(F.col("vec_id").alias("qid"), LABEL).join(near, "qid")


@query("compare_models")
def compare_models(spark, sf_dir):
    """Logistic regression, linear SVM, random forest and nearest neighbours on the vectors."""
    train, test = _vector_split(spark, sf_dir)
    estimators = {
        "Logistic Regression": M.logreg,
        "Linear SVM": M.linear_svm,
        "Random Forest (200)": M.random_forest(trees=200),
    }
    results = M.compare_models(train, test, estimators, LABEL, {"KNN (k=10)": _knn_predictor})
    return results.select("classifier", F.round("accuracy", 4).alias("accuracy"))


@query("compare_text_models")
def compare_text_models(spark, sf_dir):
    """Seven classifiers on TF-IDF of the document texts, one row each."""
    train, test = _text_features(spark, sf_dir)
    weights, sizes, parts, features = _term_split(spark, sf_dir)
    weights = materialise(weights, "term-weights")
    own = weights.filter("is_test").select("doc_id", "term", "weight")

    def bayes(_, rows):
        model = R.TermBayes.fit(weights.filter(~F.col("is_test")), sizes, LABEL, features)
        return rows.select("doc_id", LABEL).join(model.predict(rows, own, "doc_id"), "doc_id")

    def neighbours(_, rows):
        near = R.knn_on_terms(weights.filter(~F.col("is_test")), own, parts.select("doc_id", LABEL), LABEL, "doc_id", 5)
        usual = sizes.orderBy(F.desc("n"), LABEL).first()[LABEL]
        return rows.select("doc_id", LABEL).join(near, "doc_id", "left").fillna({"prediction": usual})

    estimators = {
        "Logistic Regression": M.logreg,
        "Linear SVM": M.linear_svm,
        "Decision Tree": M.decision_tree(),
        "Random Forest": M.random_forest(trees=100),
        "Gradient Boosting": M.gradient_boosting(),
    }
    results = M.compare_models(train, test, estimators, LABEL, {"Naive Bayes": bayes, "KNN (k=5)": neighbours})
    return results.select("classifier", F.round("accuracy", 4).alias("accuracy"))


@query("grid_search")
def grid_search(spark, sf_dir):
    train, _ = _vector_split(spark, sf_dir)
    weighted = X.with_class_weight(train, LABEL)
    results, _ = M.grid_search(weighted, LABEL, "vec_id", folds=3, weight="weight")
    return results.withColumn("macro_f1", F.round("macro_f1", 4))


@query("tune_and_keep")
def tune_and_keep(spark, sf_dir):
    """Tuned on a subset, refitted on all training rows, kept only where better on the test rows than the model in use."""
    train, test = _vector_split(spark, sf_dir)
    current = M.train_on_vectors(train, "vec", LABEL)
    results, candidate = M.grid_search(train, LABEL, "vec_id", folds=3, tune_rows=20000)
    before = M.score(test, current, LABEL)
    kept, accuracy = M.keep_if_better(current, candidate, test, LABEL)
    best = results.first()
    row = (best["solver"], best["c"], round(best["macro_f1"], 4), kept is candidate, round(before, 4), round(accuracy, 4))
    schema = "solver string, c double, macro_f1 double, replaced boolean, accuracy_before double, accuracy_kept double"
    return spark.createDataFrame([row], schema)


@query("cross_validate")
def cross_validate(spark, sf_dir):
    fit = lambda part: M.train_on_vectors(part, "vec", LABEL)
    folds = M.cross_validate(M.with_features(_vectors(spark, sf_dir), "vec"), LABEL, "vec_id", fit, 5)
    return folds.withColumn("accuracy", F.round("accuracy", 4))


@query("top_features")
def top_features(spark, sf_dir):
    train, _ = _text_split(spark, sf_dir)
    model = M.train_logreg(train, "text", LABEL, max_features=100, min_df=1, max_df=1.0)
    return M.top_features(model, spark).withColumn("coefficient", F.round("coefficient", 4))


@query("low_feature_probe")
def low_feature_probe(spark, sf_dir):
    train, test = _text_split(spark, sf_dir)
    value = M.low_feature_probe(train, test, "text", LABEL, 100)
    return test.groupBy().agg(F.count("*").alias("test_rows")).withColumn("accuracy", F.lit(round(value, 4)))


@query("train_baseline")
def train_baseline(spark, sf_dir):
    """Clean, split, fit and score on the test part."""
    _, predictions = M.train_baseline(_documents(spark, sf_dir), "doc_id", "text", LABEL)
    return E.weighted_prf(predictions, LABEL, "prediction")


def _language_model(spark, sf_dir):
    """Text model on ticket-cleaned documents, as the labeller applies it."""
    train, _ = _text_split(spark, sf_dir)
    clean = C.compute_once(train, clean_text=T.clean_ticket_text(F.col("text"))).select("doc_id", LABEL, "clean_text")
    # Cleaned once and stored: counts, vocabulary and vectors each read these texts.
    usable = materialise(clean.filter(F.col("clean_text") != ""), "clean-texts")
    return M.train_logreg(usable, "clean_text", LABEL, min_df=2, max_features=5000)


SAVED_SQL = f"""
SELECT 'type' AS key, 'tfidf-logreg' AS value UNION ALL SELECT 'classes', 'de,en,es,fr'
UNION ALL SELECT 'predicted alike', CAST(count(*) AS VARCHAR) FROM ({Q.ticket_sql("documents", "doc_id", "text")}) WHERE clean_text <> ''
"""


@query("save_model", SAVED_SQL)
def save_model(spark, sf_dir):
    """Saved, loaded, asked for its classes and held against the model in memory on every document."""
    path = work_path(spark, "model")
    model = _language_model(spark, sf_dir)
    G.save_model(model, path, {"type": "tfidf-logreg", "classes": ",".join(model.stages[-1].getLabels())})
    loaded, config = G.load_model(spark, path)
    documents = C.compute_once(_documents(spark, sf_dir), clean_text=T.clean_ticket_text(F.col("text"))).filter("clean_text <> ''")
    once = M.predict_batch(documents.select("doc_id", "clean_text"), model, ["doc_id", "clean_text"])
    both = M.predict_batch(once.withColumnsRenamed({"prediction": "_class", "confidence": "_sure"}).drop("probability"), loaded, ["_class", "_sure"])
    alike = both.filter((F.col("prediction") == F.col("_class")) & (F.abs(F.col("confidence") - F.col("_sure")) < 1e-9)).count()
    rows = [("type", config["type"]), ("classes", ",".join(loaded.stages[-1].getLabels())), ("predicted alike", str(alike))]
    return spark.createDataFrame(rows, "key string, value string")


def _messages(spark, sf_dir):
    return text_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query("pseudo_label")
def pseudo_label(spark, sf_dir):
    """Conversation texts labelled by a model trained on documents; confident rows only."""
    labelled = L.pseudo_label(_messages(spark, sf_dir), _language_model(spark, sf_dir))
    return labelled.select("conv_id", "turn", "predicted_category", F.round("confidence", 4).alias("confidence"), "source")


@query(
    "pseudo_label_counts",
    f"SELECT count(*) AS total_processed FROM ({Q.ticket_sql('conversations', 'conv_id, turn', 'text')}) WHERE clean_text <> ''",
)
def pseudo_label_counts(spark, sf_dir):
    counts = L.pseudo_label_counts(_messages(spark, sf_dir), _language_model(spark, sf_dir))
    return counts.select("total_processed")


# --- streams -----------------------------------------------------------------------
def _ticket_stream(spark, sf_dir, max_files=100):
    return tickets_of(table_stream(spark, sf_dir, "events", max_files))


def _land(stream, name):
    path = work_path(stream.sparkSession, name)
    return J.run_available(stream, f"{path}/out", f"{path}/checkpoint")


def _replay(spark, sf_dir, name, columns, days, handle, delay=None, max_rows=B.MAX_BATCH_ROWS):
    """The ticket view laid out by time in ranges of so many days, and handled range by range."""
    path = work_path(spark, name)
    view = tickets_of(table(spark, sf_dir, "events")).select(*columns)
    return B.Backfill(view, "ts", days * 86_400, f"{path}/rows").replay(f"{path}/out", handle, delay, max_rows)


STREAM_TEXT_SQL = f"SELECT event_id, clean_text FROM ({CLEAN_SQL}) WHERE length(clean_text) >= 15"


@query(
    "stream_label",
    with_views(
        "SELECT event_id, clean_text, category, round(confidence, 6) AS confidence, 'twitter' AS source FROM ("
        + Q.categorize_sql(STREAM_TEXT_SQL, "event_id", "clean_text", "t.event_id, t.clean_text")
        + ") WHERE confidence >= 0.3"
    ),
)
def stream_label(spark, sf_dir):
    labelled = _land(J.stream_label(_ticket_stream(spark, sf_dir), "event_id"), "stream-label")
    return labelled.withColumn("confidence", F.round("confidence", 6))


@query(
    "stream_dedupe",
    with_views(f"""
    SELECT event_id, clean_text FROM (
        SELECT event_id, clean_text, row_number() OVER (PARTITION BY clean_text ORDER BY ts, event_id) AS r
        FROM ({Q.tweet_sql("ticket_view", "event_id", "text")}) JOIN (SELECT event_id, ts FROM events) USING (event_id)) WHERE r = 1
    """),
)
def stream_dedupe(spark, sf_dir):
    """First copy of every cleaned message by event time, whatever the files or batches."""
    first = B.first_copies("clean_text", "ts", "event_id")

    def handle(batch, earlier):
        clean = C.compute_once(batch, clean_text=T.clean_tweet_text(F.col("text"))).drop("text")
        return first(clean, earlier)

    return _replay(spark, sf_dir, "stream-dedupe", ["event_id", "ts", "text"], 7, handle).select("event_id", "clean_text")


def _closed(bucket: str, days: int) -> str:
    """Windows that end before the watermark: one hour behind the latest event."""
    return f"{bucket} + INTERVAL '{days} days' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)"


@query(
    "stream_monitor",
    with_views(f"""
    SELECT strftime({DAY}, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n,
           round(count(*) FILTER (truth = prediction)::DOUBLE / count(*), 6) AS accuracy,
           round(avg(confidence), 6) AS mean_confidence
    FROM ticket_view WHERE {_closed(DAY, 1)} GROUP BY 1
    """),
)
def stream_monitor(spark, sf_dir):
    """Daily windows that end an hour before the latest event."""
    columns = ["ts", "truth", "prediction", "confidence"]
    monitor = lambda batch, _: J.stream_monitor(batch, *columns)
    return _replay(spark, sf_dir, "stream-monitor", columns, 1, monitor, delay=3600)


@query(
    "stream_drift",
    with_views(f"""
    WITH ref AS (SELECT truth AS category, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM ticket_view GROUP BY truth),
         cur AS (SELECT {WEEK} AS w, prediction AS category, count(*) AS n FROM ticket_view WHERE {_closed(WEEK, 7)} GROUP BY 1, 2),
         shares AS (SELECT w, category, n::DOUBLE / sum(n) OVER (PARTITION BY w) AS q FROM cur),
         gaps AS (SELECT s.w, sum(abs(coalesce(s.q, 0) - ref.p)) / 2 AS score
                  FROM ref JOIN shares s ON s.category = ref.category GROUP BY s.w)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, round(score, 6) AS drift_score, score > 0.1 AS drift FROM gaps
    """),
)
def stream_drift(spark, sf_dir):
    """Weekly prediction shares of the stream against the true shares of the batch table."""
    reference = O.shares(ticket_view(spark, sf_dir), "truth", "share").withColumnRenamed("truth", "category")
    count = lambda batch, _: J.stream_class_counts(batch, "ts", "prediction")
    counts = _replay(spark, sf_dir, "stream-drift", ["ts", "prediction"], 7, count, delay=3600)
    return J.window_drift(counts, reference)


# Truths arrive so many hours after their predictions, none at all for views.
TRUTH_HOURS, WAIT_HOURS = 48, 24


def _late_truth(events):
    hours = F.expr(f"make_dt_interval(0, event_id % {TRUTH_HOURS})")
    arrived = (F.col("ts").cast("timestamp") + hours).alias("truth_ts")
    return tickets_of(events).withColumn("truth_ts", arrived).filter("inbound").select("event_id", "truth_ts", "truth")


@query(
    "prediction_truth_late",
    with_views(f"""
    WITH t AS (SELECT event_id, ts + to_hours(CAST(event_id % {TRUTH_HOURS} AS INTEGER)) AS truth_ts, truth FROM ticket_view WHERE inbound),
         closed AS (SELECT least((SELECT max(ts) FROM ticket_view), (SELECT max(truth_ts) FROM t)) - INTERVAL '1 hour' AS mark)
    SELECT p.event_id, p.prediction, t.truth FROM ticket_view p LEFT JOIN t
           ON t.event_id = p.event_id AND t.truth_ts <= p.ts + INTERVAL '{WAIT_HOURS} hours'
    WHERE t.event_id IS NOT NULL OR p.ts + INTERVAL '{WAIT_HOURS} hours' < (SELECT mark FROM closed)
    """),
)
def prediction_truth_late(spark, sf_dir):
    """Two streams: predictions, and truths that arrive hours later or never."""
    events = table_stream(spark, sf_dir, "events", max_files=None)
    predictions = tickets_of(events).select("event_id", "ts", "prediction")
    truths = _late_truth(table_stream(spark, sf_dir, "events", max_files=None))
    joined = J.stream_truth(predictions, truths, "event_id", "ts", "truth_ts", f"{WAIT_HOURS} hours")
    return _land(joined, "prediction-truth").select("event_id", "prediction", "truth")


@query(
    "stream_label_messages",
    "SELECT message_id, clean_text, category, round(confidence, 6) AS confidence, 'twitter' AS source FROM ("
    + Q.categorize_sql(
        f"SELECT message_id, clean_text FROM ({CLEAN_MESSAGES_SQL}) WHERE length(clean_text) >= 15",
        "message_id", "clean_text", "t.message_id, t.clean_text",
    )
    + ") WHERE confidence >= 0.3",
)
def stream_label_messages(spark, sf_dir):
    """User messages of the conversations, labelled as they arrive."""
    arriving = messages_of(table_stream(spark, sf_dir, "conversations"))
    labelled = _land(J.stream_label(arriving, "message_id"), "stream-label-messages")
    return labelled.withColumn("confidence", F.round("confidence", 6))
