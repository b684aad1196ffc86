"""Queries for profiles, evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.operators import evaluate as E
from ticketloom.operators import monitor as M
from ticketloom.operators import profile as A
from ticketloom.plans import sqltext as Q
from ticketloom.plans.registry import query, table, text_table
from ticketloom.plans.views import sql_in, ticket_view, with_views
from ticketloom.session import work_path
from ticketloom.sources import logs as G


# --- profiles ----------------------------------------------------------------------
@query(
    "category_distribution",
    "SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct "
    "FROM events GROUP BY event_type",
)
def category_distribution(spark, sf_dir):
    return A.category_distribution(table(spark, sf_dir, "events"), "event_type")


@query(
    "text_stats_by_category",
    f"""
    SELECT lang, round_even(avg(l), 2) AS len_mean, round_even(stddev_samp(l), 2) AS len_std, min(l) AS len_min,
           max(l) AS len_max, round_even(avg(w), 2) AS words_mean, round_even(stddev_samp(w), 2) AS words_std,
           min(w) AS words_min, max(w) AS words_max, count(*) AS count
    FROM (SELECT lang, length(coalesce(text, '')) AS l, {Q.word_count('text')} AS w FROM documents) GROUP BY lang
    """,
)
def text_stats_by_category(spark, sf_dir):
    return A.text_stats_by_category(text_table(spark, sf_dir, "documents"), "lang", "text")


@query(
    "null_profile",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS nulls, count(*) AS rows FROM ticket_view"
            for c, t in (
                ("event_id", "bigint"), ("text", "string"), ("inbound", "boolean"), ("source", "string"),
                ("Issue_Category", "string"), ("confidence", "double"),
            )
        )
    ),
)
def null_profile(spark, sf_dir):
    columns = ("event_id", "text", "inbound", "source", "Issue_Category", "confidence")
    return A.null_profile(ticket_view(spark, sf_dir).select(*columns))


def _histogram_sql(bins: int) -> str:
    return f"""
    WITH x AS (SELECT length(coalesce(text, ''))::DOUBLE AS v FROM documents),
         b AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS w FROM x)
    SELECT g.i AS bin, round(b.lo + g.i * b.w, 6) AS lower, round(b.lo + (g.i + 1) * b.w, 6) AS upper,
           (SELECT count(*) FROM x WHERE least(floor((x.v - b.lo) / b.w), {bins - 1}) = g.i) AS n
    FROM b, generate_series(0, {bins - 1}) AS g(i)
    """


@query("length_histogram", _histogram_sql(30))
def length_histogram(spark, sf_dir):
    lengths = text_table(spark, sf_dir, "documents").select(T.char_length(F.col("text")).alias("length"))
    return A.length_histogram(lengths, "length", 30)


_MARKS = (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))


@query(
    "length_quantiles",
    "SELECT lang, "
    + ", ".join(f'round(quantile_cont(length(text)::DOUBLE, {q}), 6) AS "{n}"' for n, q in _MARKS)
    + " FROM documents GROUP BY lang",
)
def length_quantiles(spark, sf_dir):
    lengths = text_table(spark, sf_dir, "documents").select("lang", T.char_length(F.col("text")).alias("length"))
    return A.length_quantiles(lengths, "lang", "length")


@query(
    "imbalance_ratio",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, round(max(n)::DOUBLE / min(n), 6) AS imbalance, "
    "round(sum(c)::DOUBLE / sum(n)::DOUBLE, 6) AS avg_length "
    "FROM (SELECT lang, count(*) AS n, sum(length(coalesce(text, ''))) AS c FROM documents GROUP BY lang)",
)
def imbalance_ratio(spark, sf_dir):
    return A.imbalance_ratio(text_table(spark, sf_dir, "documents"), "lang", "text")


@query(
    "dominant_share",
    with_views(
        "SELECT count(*) FILTER (truth = 'General Inquiry') AS n, "
        "round(count(*) FILTER (truth = 'General Inquiry') * 100.0::DOUBLE / count(*), 6) AS pct FROM ticket_view"
    ),
)
def dominant_share(spark, sf_dir):
    return A.dominant_share(ticket_view(spark, sf_dir), "truth", K.DEFAULT_CATEGORY)


@query(
    "category_presence",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS category, count(*) FILTER (contains(lower(text), '{c.lower()}')) AS n FROM ticket_view"
            for c in K.TWEET_CATEGORIES
        )
    ),
)
def category_presence(spark, sf_dir):
    lowered = ticket_view(spark, sf_dir).select(F.lower("text").alias("text"))
    return A.category_presence(lowered, "text", K.TWEET_CATEGORIES)


_STOPPED = Q.tokens("text", K.ENGLISH_STOPWORDS)


@query(
    "term_profile_by_class",
    f"""
    WITH words AS (SELECT lang, unnest({_STOPPED}) AS term FROM documents),
         counts AS (SELECT lang, term, count(*) AS tf FROM words GROUP BY lang, term),
         vocab AS (SELECT term FROM counts GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 50),
         docs AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
         scored AS (SELECT lang, term, round(tf::DOUBLE / n, 6) AS mean_count
                    FROM counts JOIN vocab USING (term) JOIN docs USING (lang))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mean_count DESC, term) AS rank FROM scored)
    WHERE rank <= 10
    """,
)
def term_profile_by_class(spark, sf_dir):
    return A.term_profile_by_class(text_table(spark, sf_dir, "documents"), "lang", "text")


@query(
    "top_terms_per_class",
    f"""
    SELECT * FROM (SELECT source, term, tf, row_number() OVER (PARTITION BY source ORDER BY tf DESC, term) AS rank
                   FROM (SELECT source, term, count(*) AS tf
                         FROM (SELECT source, unnest({_STOPPED}) AS term FROM documents) GROUP BY source, term))
    WHERE rank <= 10
    """,
)
def top_terms_per_class(spark, sf_dir):
    return A.top_terms_per_class(text_table(spark, sf_dir, "documents"), "source", "text")


@query(
    "class_vocab_size",
    f"SELECT source, count(DISTINCT term) AS vocab_size FROM (SELECT source, unnest({Q.tokens('text')}) AS term FROM documents) "
    "GROUP BY source",
)
def class_vocab_size(spark, sf_dir):
    return A.class_vocab_size(text_table(spark, sf_dir, "documents"), "source", "text")


RESULTS_SQL = (
    "SELECT source AS classifier, count(*) FILTER (truth = prediction)::DOUBLE / count(*) AS accuracy "
    "FROM ticket_view GROUP BY source "
    "UNION ALL SELECT 'all', count(*) FILTER (truth = prediction)::DOUBLE / count(*) FROM ticket_view"
)


def _results(spark, sf_dir):
    """Accuracy of the logged predictions per channel and overall, as a results table."""
    view = ticket_view(spark, sf_dir)
    accuracy = (F.count_if(F.col("truth") == F.col("prediction")) / F.count("*")).alias("accuracy")
    per_source = view.groupBy(F.col("source").alias("classifier")).agg(accuracy)
    return per_source.unionByName(view.agg(accuracy).select(F.lit("all").alias("classifier"), "accuracy"))


@query(
    "improvement_vs_baseline",
    with_views(
        "SELECT classifier, round(r.accuracy, 6) AS accuracy, round(r.accuracy - b.base, 6) AS improvement, "
        "round((r.accuracy - b.base) * 100.0::DOUBLE / b.base, 6) AS improvement_pct "
        f"FROM ({RESULTS_SQL}) r, (SELECT accuracy AS base FROM ({RESULTS_SQL}) WHERE classifier = 'all') b"
    ),
)
def improvement_vs_baseline(spark, sf_dir):
    gains = A.improvement_vs_baseline(_results(spark, sf_dir), "classifier", "accuracy", "all")
    return gains.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "model_report",
    with_views(
        "SELECT classifier, round(r.accuracy, 6) AS accuracy, CASE WHEN classifier = 'all' THEN 'Good baseline' "
        "WHEN r.accuracy > 0.95 THEN 'Suspicious' WHEN r.accuracy < b.base THEN 'Too low' ELSE 'Good' END AS status "
        f"FROM ({RESULTS_SQL}) r, (SELECT accuracy AS base FROM ({RESULTS_SQL}) WHERE classifier = 'all') b"
    ),
)
def model_report(spark, sf_dir):
    report = E.model_report(_results(spark, sf_dir), "classifier", "accuracy", "all")
    return report.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "best_model",
    with_views(
        f"SELECT classifier, round(accuracy, 6) AS accuracy FROM ({RESULTS_SQL}) r ORDER BY r.accuracy DESC, classifier LIMIT 1"
    ),
)
def best_model(spark, sf_dir):
    best = E.best_model(_results(spark, sf_dir), "classifier", "accuracy")
    return best.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "validate_training_data",
    with_views("""
    SELECT 'enough_rows' AS "check", count(*) > 1000 AS passed, count(*) AS observed FROM ticket_view
    UNION ALL SELECT 'labels_match', count(Issue_Category) = count(*), count(Issue_Category) FROM ticket_view
    UNION ALL SELECT 'no_missing_text', count(text) = count(*), count(*) - count(text) FROM ticket_view
    UNION ALL SELECT 'not_empty', count(*) > 0, count(*) FROM ticket_view
    """),
)
def validate_training_data(spark, sf_dir):
    return A.validate_training_data(ticket_view(spark, sf_dir), "text", "Issue_Category")


def _half(at: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(d, {at}, 8) AS BIGINT)) AS VARCHAR)"


@query(
    "dataset_fingerprint",
    f"""
    SELECT count(*) AS rows, sha256(count(*) || ':' || {_half(1)} || ':' || {_half(9)}) AS fingerprint
    FROM (SELECT md5(concat_ws(chr(31), {', '.join(
        f"coalesce(CAST({c} AS VARCHAR), chr(1))" for c in ('doc_id', 'text', 'lang', 'source', 'n_chars'))})) AS d
          FROM documents)
    """,
)
def dataset_fingerprint(spark, sf_dir):
    return A.dataset_fingerprint(text_table(spark, sf_dir, "documents"))


WEEK = "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')"
DAY = "time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')"


def _start(bucket: str) -> str:
    return f"strftime({bucket}, '%Y-%m-%d %H:%M:%S')"


@query(
    "data_quality_metrics",
    with_views(f"""
    WITH per AS (SELECT {WEEK} AS w, Issue_Category AS c, count(*) AS n FROM ticket_view GROUP BY 1, 2),
         classes AS (SELECT w, count(*) AS classes, max(n)::DOUBLE / sum(n)::DOUBLE AS share FROM per GROUP BY w)
    SELECT {_start('v.w')} AS window_start, count(*) AS rows, count(*) - count(text) AS missing,
           round(avg(length(text)), 6) AS len_mean, min(length(text)) AS len_min, max(length(text)) AS len_max,
           any_value(classes) AS classes, round(any_value(share), 6) AS largest_share
    FROM (SELECT *, {WEEK} AS w FROM ticket_view) v JOIN classes USING (w) GROUP BY v.w
    """),
)
def data_quality_metrics(spark, sf_dir):
    return A.data_quality_metrics(ticket_view(spark, sf_dir), "ts", "text", "Issue_Category")


# --- evaluation --------------------------------------------------------------------
@query(
    "accuracy",
    with_views(
        "SELECT count(*) AS n, count(*) FILTER (truth = prediction) AS correct, "
        "round(count(*) FILTER (truth = prediction)::DOUBLE / count(*), 6) AS accuracy FROM ticket_view"
    ),
)
def accuracy(spark, sf_dir):
    return E.accuracy(ticket_view(spark, sf_dir), "truth", "prediction")


def _class_sql(source: str, by: str = "") -> str:
    """Precision, recall, F1 and support per class, unrounded."""
    extra = f"{by}, " if by else ""
    using = f"USING ({extra}category)"
    return f"""
    SELECT {extra}category, coalesce(tp, 0)::DOUBLE / nullif(predicted, 0) AS p0, coalesce(tp, 0) AS tp,
           CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE coalesce(tp, 0)::DOUBLE / predicted END AS precision,
           CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE coalesce(tp, 0)::DOUBLE / support END AS recall,
           2 * coalesce(tp, 0)::DOUBLE / (coalesce(predicted, 0) + coalesce(support, 0)) AS f1,
           coalesce(support, 0) AS support
    FROM (SELECT {extra}truth AS category, count(*) AS support, count(*) FILTER (truth = prediction) AS tp
          FROM {source} GROUP BY {extra}truth)
    FULL JOIN (SELECT {extra}prediction AS category, count(*) AS predicted FROM {source} GROUP BY {extra}prediction) {using}
    """


@query(
    "weighted_prf",
    with_views(f"""
    SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
           round(sum(precision * support) / sum(support), 6) AS precision,
           round(sum(recall * support) / sum(support), 6) AS recall,
           round(sum(f1 * support) / sum(support), 6) AS f1 FROM ({_class_sql('ticket_view')})
    """),
)
def weighted_prf(spark, sf_dir):
    return E.weighted_prf(ticket_view(spark, sf_dir), "truth", "prediction")


def class_report_sql(source: str) -> str:
    """A CTE and a select: the report of (truth, prediction) rows per class, with macro and weighted averages."""
    return f"""c AS ({_class_sql(source)})
    SELECT category, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM c
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
              round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c
    """


@query("per_class_prf", with_views(f"WITH {class_report_sql('ticket_view')}"))
def per_class_prf(spark, sf_dir):
    return E.per_class_prf(ticket_view(spark, sf_dir), "truth", "prediction")


@query(
    "confusion_matrix",
    with_views(
        "SELECT truth, "
        + ", ".join(f"count(*) FILTER (prediction = '{c}') AS \"{c}\"" for c in K.TWEET_CATEGORIES)
        + f" FROM ticket_view WHERE truth IN {sql_in(K.TWEET_CATEGORIES)} GROUP BY truth"
    ),
)
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(ticket_view(spark, sf_dir), "truth", "prediction", K.TWEET_CATEGORIES)


@query(
    "misclassified",
    with_views("SELECT event_id, truth, prediction, confidence FROM ticket_view WHERE truth <> prediction"),
)
def misclassified(spark, sf_dir):
    wrong = E.misclassified(ticket_view(spark, sf_dir), "truth", "prediction")
    return wrong.select("event_id", "truth", "prediction", "confidence")


@query(
    "misclassified_rate",
    with_views(
        "SELECT count(*) AS n, count(*) FILTER (truth <> prediction) AS wrong, "
        "round(count(*) FILTER (truth <> prediction) * 100.0::DOUBLE / count(*), 6) AS wrong_pct FROM ticket_view"
    ),
)
def misclassified_rate(spark, sf_dir):
    return E.misclassified_rate(ticket_view(spark, sf_dir), "truth", "prediction")


@query(
    "confusion_pairs",
    with_views("SELECT truth, prediction, count(*) AS n FROM ticket_view WHERE truth <> prediction GROUP BY truth, prediction"),
)
def confusion_pairs(spark, sf_dir):
    return E.confusion_pairs(ticket_view(spark, sf_dir), "truth", "prediction")


@query(
    "most_confused_with",
    with_views("""
    SELECT truth, CAST(sum(n) AS BIGINT) AS misclassified, first(prediction ORDER BY n DESC, prediction) AS most_confused
    FROM (SELECT truth, prediction, count(*) AS n FROM ticket_view WHERE truth <> prediction GROUP BY truth, prediction)
    GROUP BY truth
    """),
)
def most_confused_with(spark, sf_dir):
    return E.most_confused_with(ticket_view(spark, sf_dir), "truth", "prediction")


@query(
    "prediction_truth",
    "SELECT d.doc_id, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS prediction, l.quality FROM documents d "
    "LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def prediction_truth(spark, sf_dir):
    """A length rule as the prediction; ground truth exists for some documents only."""
    documents = text_table(spark, sf_dir, "documents")
    guess = documents.select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("prediction"))
    return E.prediction_truth(guess, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "first_per_category",
    "SELECT doc_id, lang, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank "
    "FROM documents) WHERE rank <= 5",
)
def first_per_category(spark, sf_dir):
    return E.first_n(text_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "source", "doc_id", 5)


@query(
    "argmax_label",
    "SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS event_type, max(n) AS n "
    "FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id",
)
def argmax_label(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return E.argmax_label(counts, "user_id", "n", "event_type")


@query("recent_n", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_n(spark, sf_dir):
    return E.recent_n(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type", "value")


@query(
    "recent_n_per_model",
    "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r "
    "FROM events) WHERE r <= 100",
)
def recent_n_per_model(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return E.recent_n_per_model(events, "event_type", "ts", "event_id").select("event_id", "event_type")


# --- monitoring --------------------------------------------------------------------
@query(
    "prediction_log",
    with_views(
        "SELECT coalesce(text, '') AS input, prediction, confidence, truth AS ground_truth FROM ticket_view"
    ),
)
def prediction_log(spark, sf_dir):
    """The logged predictions appended in two halves and read back."""
    path = work_path(spark, "prediction-log")
    view = ticket_view(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    for inbound in (True, False):
        part = view.filter(F.col("inbound") == inbound)
        G.append_log(G.prediction_records(part, "text", "prediction", "confidence", "truth", F.col("ts")), path)
    return G.read_log(spark, path).drop("timestamp")


@query(
    "metric_log",
    with_views(
        "SELECT 'ticket-classifier' AS run, 0 AS step, 'accuracy' AS key, "
        "round(count(*) FILTER (truth = prediction)::DOUBLE / count(*), 6) AS value FROM ticket_view "
        "UNION ALL SELECT 'ticket-classifier', 0, 'predictions', count(*)::DOUBLE FROM ticket_view"
    ),
)
def metric_log(spark, sf_dir):
    row = E.accuracy(ticket_view(spark, sf_dir), "truth", "prediction").first()
    path = work_path(spark, "metric-log")
    G.append_log(G.metric_records(spark, "ticket-classifier", {"accuracy": row["accuracy"], "predictions": row["n"]}), path)
    return G.read_log(spark, path).drop("timestamp")


@query(
    "monitor_summary",
    with_views(
        "SELECT 'ticket-classifier' AS model_name, count(*) AS total_predictions, least(count(*), 100) AS recent_predictions "
        "FROM ticket_view"
    ),
)
def monitor_summary(spark, sf_dir):
    return M.monitor_summary(ticket_view(spark, sf_dir), "ticket-classifier")


SPLIT_TS = "2024-01-16 00:00:00"


def _drift_sql(col: str) -> str:
    return f"""
    WITH p AS (SELECT {col} AS c, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM ticket_view
               WHERE ts < TIMESTAMP '{SPLIT_TS}' GROUP BY {col}),
         q AS (SELECT {col} AS c, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM ticket_view
               WHERE ts >= TIMESTAMP '{SPLIT_TS}' GROUP BY {col})
    SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS drift_score,
           sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 > 0.1 AS drift FROM p FULL JOIN q ON p.c IS NOT DISTINCT FROM q.c
    """


def _halves(spark, sf_dir):
    view = ticket_view(spark, sf_dir)
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    return view.filter(F.col("ts") < cut), view.filter(F.col("ts") >= cut)


@query("detect_drift", with_views(_drift_sql("prediction")))
def detect_drift(spark, sf_dir):
    """First half of the log against the second."""
    reference, current = _halves(spark, sf_dir)
    return M.detect_drift(reference, current, "prediction")


@query(
    "should_retrain",
    with_views(f"""
    WITH d AS ({_drift_sql('prediction')}),
         f AS (SELECT (SELECT count(*) FILTER (truth = prediction)::DOUBLE / count(*) FROM ticket_view) < 0.75 AS low_accuracy,
                      (SELECT drift FROM d) AS drift, true AS scheduled, false AS manual)
    SELECT *, low_accuracy OR drift OR scheduled OR manual AS retrain FROM f
    """),
)
def should_retrain(spark, sf_dir):
    reference, current = _halves(spark, sf_dir)
    return M.should_retrain(
        E.accuracy(ticket_view(spark, sf_dir), "truth", "prediction"),
        M.detect_drift(reference, current, "prediction"),
        last_trained="2024-01-20",
        now="2024-01-31",
    )


WEEKLY = f"(SELECT *, {_start(WEEK)} AS window_start FROM ticket_view)"


@query(
    "accuracy_over_time",
    with_views(f"""
    SELECT window_start, CAST(sum(support) AS BIGINT) AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
           round(avg(f1), 6) AS macro_f1 FROM ({_class_sql(WEEKLY, 'window_start')}) GROUP BY window_start
    """),
)
def accuracy_over_time(spark, sf_dir):
    return M.accuracy_over_time(ticket_view(spark, sf_dir), "ts", "truth", "prediction")


@query(
    "class_scores_over_time",
    with_views(
        "SELECT window_start, category, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support "
        f"FROM ({_class_sql(WEEKLY, 'window_start')})"
    ),
)
def class_scores_over_time(spark, sf_dir):
    return M.class_scores_over_time(ticket_view(spark, sf_dir), "ts", "truth", "prediction")


@query(
    "latency_percentiles",
    with_views(f"""
    SELECT {_start(WEEK)} AS window_start, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
           round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
    FROM ticket_view GROUP BY 1
    """),
)
def latency_percentiles(spark, sf_dir):
    return M.latency_percentiles(ticket_view(spark, sf_dir), "ts", "latency_ms")


@query(
    "error_rate_throughput",
    with_views(f"""
    SELECT {_start(DAY)} AS window_start, count(*) AS requests, count(*) FILTER (is_error) AS errors,
           round(count(*) FILTER (is_error)::DOUBLE / count(*), 6) AS error_rate,
           round(count(*)::DOUBLE / 86400, 6) AS per_second FROM ticket_view GROUP BY 1
    """),
)
def error_rate_throughput(spark, sf_dir):
    return M.error_rate_throughput(ticket_view(spark, sf_dir), "ts", F.col("is_error"))


@query(
    "alert_rules",
    with_views(f"""
    WITH m AS (SELECT {_start(WEEK)} AS window_start, count(*) FILTER (truth = prediction)::DOUBLE / count(*) AS accuracy,
                      quantile_cont(latency_ms, 0.99) AS p99 FROM ticket_view GROUP BY 1)
    SELECT window_start, 'accuracy' AS metric, round(accuracy, 6) AS value, 'accuracy_drop' AS alert, '<' AS comparison,
           0.75::DOUBLE AS threshold, 'email' AS notification FROM m WHERE round(accuracy, 6) < 0.75
    UNION ALL
    SELECT window_start, 'p99_latency', round(p99, 6), 'high_latency', '>', 5000.0, 'slack' FROM m WHERE round(p99, 6) > 5000
    """),
)
def alert_rules(spark, sf_dir):
    view = ticket_view(spark, sf_dir)
    weekly = M.accuracy_over_time(view, "ts", "truth", "prediction").select(
        "window_start", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")
    )
    latency = M.latency_percentiles(view, "ts", "latency_ms").select(
        "window_start", F.lit("p99_latency").alias("metric"), F.col("p99").alias("value")
    )
    return M.alert_rules(weekly.unionByName(latency))


@query(
    "promote_model",
    with_views("""
    SELECT *, new_accuracy > current_accuracy AS promote FROM (
        SELECT round(count(*) FILTER (truth = prediction AND source = 'ticket')::DOUBLE / count(*) FILTER (source = 'ticket'), 6)
                   AS current_accuracy,
               round(count(*) FILTER (truth = prediction AND source = 'twitter')::DOUBLE / count(*) FILTER (source = 'twitter'), 6)
                   AS new_accuracy FROM ticket_view)
    """),
)
def promote_model(spark, sf_dir):
    view = ticket_view(spark, sf_dir)
    return M.promote_model(
        view.filter(F.col("source") == "ticket"), view.filter(F.col("source") == "twitter"), "truth", "prediction"
    )


