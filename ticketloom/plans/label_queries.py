"""Queries for rule labelling, routing, deduplication and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.operators import columns as C
from ticketloom.operators import corpus as U
from ticketloom.operators import evaluate as E
from ticketloom.operators import label as L
from ticketloom.operators import profile as A
from ticketloom.operators import sampling as X
from ticketloom.plans import sqltext as Q
from ticketloom.plans.registry import query, table, text_table
from ticketloom.plans.views import sql_in, ticket_view, with_views

VIEW = "SELECT event_id, text FROM ticket_view"


@query(
    "phrase_label",
    with_views(
        f"SELECT t.event_id, p.phrase_category AS phrase_label FROM ticket_view t "
        f"LEFT JOIN ({Q.first_phrase_sql(VIEW, 'event_id', 'text')}) p ON p.event_id = t.event_id"
    ),
)
def phrase_label(spark, sf_dir):
    return ticket_view(spark, sf_dir).select("event_id", L.phrase_label(F.col("text")).alias("phrase_label"))


@query(
    "keyword_scores",
    with_views(f"SELECT event_id, category, score_x100 FROM ({Q.scores_sql(VIEW, 'event_id', 'text')})"),
)
def keyword_scores(spark, sf_dir):
    return L.keyword_scores(ticket_view(spark, sf_dir), "event_id", "text")


@query(
    "keyword_scores_documents",
    f"SELECT doc_id, category, score_x100 FROM ({Q.scores_sql('SELECT doc_id, text FROM documents', 'doc_id', 'text')})",
)
def keyword_scores_documents(spark, sf_dir):
    return L.keyword_scores(text_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "categorize",
    with_views(
        "SELECT event_id, category, round(confidence, 6) AS confidence FROM ("
        + Q.categorize_sql(VIEW, "event_id", "text", "t.event_id")
        + ")"
    ),
)
def categorize(spark, sf_dir):
    labelled = L.categorize(ticket_view(spark, sf_dir).select("event_id", "text"), "text")
    return labelled.select("event_id", "category", F.round("confidence", 6).alias("confidence"))


CLEAN_SQL = Q.tweet_sql("(SELECT * FROM ticket_view WHERE inbound)", "event_id", "text")
UNIQUE_SQL = (
    f"SELECT min(event_id) AS event_id, clean_text FROM ({CLEAN_SQL}) WHERE length(clean_text) >= 15 GROUP BY clean_text"
)
PROCESSED_SQL = (
    "SELECT event_id, clean_text, category, confidence, 'twitter' AS source FROM ("
    + Q.categorize_sql(UNIQUE_SQL, "event_id", "clean_text", "t.event_id, t.clean_text")
    + ") WHERE confidence >= 0.3"
)


@query(
    "process_messages",
    with_views(
        f"SELECT event_id, clean_text, category, round(confidence, 6) AS confidence, source FROM ({PROCESSED_SQL})"
    ),
)
def process_messages(spark, sf_dir):
    done = L.process_messages(ticket_view(spark, sf_dir), "event_id")
    return done.withColumn("confidence", F.round("confidence", 6))


@query(
    "labelled_category_distribution",
    with_views(
        f"SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct "
        f"FROM ({PROCESSED_SQL}) GROUP BY category"
    ),
)
def labelled_category_distribution(spark, sf_dir):
    """Clean, dedupe and label the messages, then count the labels."""
    return A.category_distribution(L.process_messages(ticket_view(spark, sf_dir), "event_id"), "category")


def _ladder_sql(col: str, ladder, default: str) -> str:
    text = f"lower(coalesce({col}, ''))"
    branches = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{k}')" for k in keywords) + f" THEN '{label}'"
        for keywords, label in ladder
    )
    return f"CASE {branches} ELSE '{default}' END"


SIMPLE_SQL = _ladder_sql("text", K.SIMPLE_LADDER, K.SIMPLE_LADDER_DEFAULT)
EXPECTED_SQL = _ladder_sql("text", K.EXPECTED_LADDER, K.EXPECTED_LADDER_DEFAULT)


@query("ladder_label", with_views(f"SELECT event_id, {SIMPLE_SQL} AS label FROM ticket_view"))
def ladder_label(spark, sf_dir):
    return ticket_view(spark, sf_dir).select("event_id", L.simple_label(F.col("text")).alias("label"))


@query(
    "drop_other",
    with_views(f"SELECT * FROM (SELECT event_id, {SIMPLE_SQL} AS label FROM ticket_view) WHERE label <> 'other'"),
)
def drop_other(spark, sf_dir):
    return C.drop_other(ladder_label(spark, sf_dir))


@query("expected_label", with_views(f"SELECT event_id, {EXPECTED_SQL} AS expected FROM ticket_view"))
def expected_label(spark, sf_dir):
    return ticket_view(spark, sf_dir).select("event_id", L.expected_label(F.col("text")).alias("expected"))


# --- the same over given messages -------------------------------------------------
MESSAGES_SQL = "SELECT conv_id * 1000000 + turn AS message_id, text, role = 'user' AS inbound FROM conversations"


def messages(spark, sf_dir):
    """The turns of the conversations; those of users are inbound."""
    return messages_of(text_table(spark, sf_dir, "conversations"))


def messages_of(turns):
    """The same of a batch or streaming table."""
    number = (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("message_id")
    return turns.select(number, "text", (F.col("role") == "user").alias("inbound"))


@query(
    "phrase_label_messages",
    f"SELECT t.message_id, p.phrase_category AS phrase_label FROM ({MESSAGES_SQL}) t "
    f"LEFT JOIN ({Q.first_phrase_sql(MESSAGES_SQL, 'message_id', 'text')}) p ON p.message_id = t.message_id",
)
def phrase_label_messages(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", L.phrase_label(F.col("text")).alias("phrase_label"))


@query("keyword_scores_messages", f"SELECT message_id, category, score_x100 FROM ({Q.scores_sql(MESSAGES_SQL, 'message_id', 'text')})")
def keyword_scores_messages(spark, sf_dir):
    return L.keyword_scores(messages(spark, sf_dir), "message_id", "text")


@query(
    "categorize_messages",
    "SELECT message_id, category, round(confidence, 6) AS confidence FROM ("
    + Q.categorize_sql(MESSAGES_SQL, "message_id", "text", "t.message_id")
    + ")",
)
def categorize_messages(spark, sf_dir):
    labelled = L.categorize(messages(spark, sf_dir).select("message_id", "text"), "text")
    return labelled.select("message_id", "category", F.round("confidence", 6).alias("confidence"))


CLEAN_MESSAGES_SQL = Q.tweet_sql(f"(SELECT * FROM ({MESSAGES_SQL}) WHERE inbound)", "message_id", "text")
UNIQUE_MESSAGES_SQL = (
    f"SELECT min(message_id) AS message_id, clean_text FROM ({CLEAN_MESSAGES_SQL}) WHERE length(clean_text) >= 15 GROUP BY clean_text"
)
PROCESSED_MESSAGES_SQL = (
    "SELECT message_id, clean_text, category, confidence, 'twitter' AS source FROM ("
    + Q.categorize_sql(UNIQUE_MESSAGES_SQL, "message_id", "clean_text", "t.message_id, t.clean_text")
    + ") WHERE confidence >= 0.3"
)


@query(
    "process_user_messages",
    f"SELECT message_id, clean_text, category, round(confidence, 6) AS confidence, source FROM ({PROCESSED_MESSAGES_SQL})",
)
def process_user_messages(spark, sf_dir):
    """Users' turns, cleaned, of enough length, each text once, labelled, confident ones."""
    return L.process_messages(messages(spark, sf_dir), "message_id").withColumn("confidence", F.round("confidence", 6))


@query(
    "message_category_distribution",
    f"SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct "
    f"FROM ({PROCESSED_MESSAGES_SQL}) GROUP BY category",
)
def message_category_distribution(spark, sf_dir):
    return A.category_distribution(L.process_messages(messages(spark, sf_dir), "message_id"), "category")


@query("ladder_label_messages", f"SELECT message_id, {SIMPLE_SQL} AS label FROM ({MESSAGES_SQL})")
def ladder_label_messages(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", L.simple_label(F.col("text")).alias("label"))


@query("expected_label_messages", f"SELECT message_id, {EXPECTED_SQL} AS expected FROM ({MESSAGES_SQL})")
def expected_label_messages(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", L.expected_label(F.col("text")).alias("expected"))


def _hit_sql(words) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in quoted) + ")"


@query(
    "fraud_detect",
    with_views(f"""
    SELECT event_id,
           CASE WHEN stage = 'keyword_match' THEN 'Fraud' ELSE prediction END AS category,
           CASE WHEN stage = 'keyword_match' THEN 0.95::DOUBLE ELSE confidence END AS confidence,
           stage AS method, stage IN ('model_low', 'suspicious') AS needs_review
    FROM (SELECT *, CASE WHEN {_hit_sql(K.DETECTOR_FRAUD_KEYWORDS)} THEN 'keyword_match'
                         WHEN prediction = 'Fraud' AND confidence >= 0.3::DOUBLE THEN 'model_high'
                         WHEN prediction = 'Fraud' AND confidence >= 0.15::DOUBLE THEN 'model_low'
                         WHEN {_hit_sql(K.DETECTOR_SUSPICIOUS_KEYWORDS)} THEN 'suspicious'
                         ELSE 'normal' END AS stage FROM ticket_view)
    """),
)
def fraud_detect(spark, sf_dir):
    decision = L.fraud_detect(F.col("text"), F.col("prediction"), F.col("confidence"))
    return ticket_view(spark, sf_dir).select("event_id", decision.alias("d")).select("event_id", "d.*")


_LIMITS = " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in K.ROUTER_THRESHOLDS.items())


@query(
    "route_predictions",
    with_views(f"""
    SELECT event_id,
           CASE stage WHEN 'keyword_match' THEN 'Fraud' WHEN 'fallback' THEN 'General Inquiry' ELSE prediction END AS category,
           CASE WHEN stage = 'keyword_match' THEN 0.95::DOUBLE ELSE confidence END AS confidence,
           stage AS method,
           CASE stage WHEN 'keyword_match' THEN false WHEN 'model' THEN
                confidence < CASE prediction {_LIMITS} ELSE 0.6::DOUBLE END ELSE true END AS needs_review
    FROM (SELECT *, CASE WHEN {_hit_sql(K.ROUTER_FRAUD_KEYWORDS)} THEN 'keyword_match'
                         WHEN prediction = 'Fraud' AND confidence < 0.3::DOUBLE AND {_hit_sql(K.ROUTER_SUSPICIOUS_KEYWORDS)}
                              THEN 'model_low'
                         WHEN prediction = 'Fraud' AND confidence < 0.3::DOUBLE THEN 'fallback'
                         ELSE 'model' END AS stage FROM ticket_view)
    """),
)
def route_predictions(spark, sf_dir):
    decision = L.route_predictions(F.col("text"), F.col("prediction"), F.col("confidence"))
    return ticket_view(spark, sf_dir).select("event_id", decision.alias("d")).select("event_id", "d.*")


@query(
    "confidence_band",
    with_views(
        "SELECT event_id, CASE WHEN confidence > 0.8::DOUBLE THEN 'auto' WHEN confidence >= 0.5::DOUBLE THEN 'review' "
        "ELSE 'human' END AS band FROM ticket_view"
    ),
)
def confidence_band(spark, sf_dir):
    return ticket_view(spark, sf_dir).select("event_id", L.confidence_band(F.col("confidence")).alias("band"))


@query(
    "pseudo_label_precision",
    with_views(f"""
    SELECT p.category AS label, count(*) AS n, count(*) FILTER (p.category = v.truth) AS correct,
           round(count(*) FILTER (p.category = v.truth)::DOUBLE / count(*), 6) AS precision
    FROM ({PROCESSED_SQL}) p JOIN ticket_view v ON v.event_id = p.event_id GROUP BY p.category
    """),
)
def pseudo_label_precision(spark, sf_dir):
    view = ticket_view(spark, sf_dir)
    return E.pseudo_label_precision(L.process_messages(view, "event_id"), view, "event_id", "category", "truth")


# --- set operations and deduplication ----------------------------------------------
@query(
    "union_sources",
    with_views(
        "SELECT 0 AS priority, event_id AS id, text FROM ticket_view UNION ALL "
        "SELECT 1, doc_id, text FROM documents"
    ),
)
def union_sources(spark, sf_dir):
    first = ticket_view(spark, sf_dir).select(F.col("event_id").alias("id"), "text")
    second = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return U.union_sources([first, second])


@query(
    "dedupe_keep_first",
    "SELECT arg_min(doc_id, doc_id) AS doc_id, text, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source "
    "FROM documents GROUP BY text",
)
def dedupe_keep_first(spark, sf_dir):
    documents = text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return U.dedupe_keep_first(documents, ["text"], "doc_id")


TICKET_CLEAN_SQL = Q.ticket_sql(
    "(SELECT min(event_id) AS event_id, coalesce(text, '') AS text, arg_min(Issue_Category, event_id) AS Issue_Category "
    "FROM ticket_view WHERE source = 'ticket' GROUP BY coalesce(text, ''))",
    "event_id, Issue_Category",
    "text",
)
TICKETS_SQL = f"""
SELECT min(event_id) AS event_id, clean_text, arg_min(Issue_Category, event_id) AS Issue_Category, 'ticket' AS source
FROM ({TICKET_CLEAN_SQL}) WHERE clean_text <> '' GROUP BY clean_text
"""


@query("clean_then_dedupe", with_views(TICKETS_SQL))
def clean_then_dedupe(spark, sf_dir):
    tickets = ticket_view(spark, sf_dir).filter(F.col("source") == "ticket")
    return U.clean_then_dedupe(tickets, "event_id", "text", "Issue_Category")


MERGED_SQL = f"""
SELECT arg_min(event_id, priority * 1000000000000 + event_id) AS event_id, clean_text,
       arg_min(category, priority * 1000000000000 + event_id) AS category,
       arg_min(source, priority * 1000000000000 + event_id) AS source,
       round(arg_min(confidence, priority * 1000000000000 + event_id), 6) AS confidence
FROM (SELECT 0 AS priority, event_id, clean_text, Issue_Category AS category, 'ticket' AS source, 1.0::DOUBLE AS confidence
      FROM ({TICKETS_SQL}) WHERE Issue_Category IN {sql_in(K.TICKET_CATEGORIES)}
      UNION ALL
      SELECT 1, event_id, clean_text, category, 'twitter', confidence FROM ({PROCESSED_SQL})
      WHERE category IN {sql_in(K.TWEET_CATEGORIES)})
GROUP BY clean_text
"""


@query("merge_corpora", with_views(MERGED_SQL))
def merge_corpora(spark, sf_dir):
    """Cleaned tickets and labelled messages in one corpus."""
    view = ticket_view(spark, sf_dir)
    tickets = U.clean_then_dedupe(view.filter(F.col("source") == "ticket"), "event_id", "text", "Issue_Category")
    tweets = L.process_messages(view, "event_id")
    return U.merge_corpora(tickets, tweets, "event_id").withColumn("confidence", F.round("confidence", 6))


@query(
    "duplicate_rows",
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) "
    "AS duplicate_rows FROM documents",
)
def duplicate_rows(spark, sf_dir):
    return U.duplicate_rows(text_table(spark, sf_dir, "documents"), ["lang", "source", "text"])


@query(
    "duplicate_texts",
    "SELECT count(*) AS rows, count(DISTINCT text) AS distinct_texts, count(*) - count(DISTINCT text) AS duplicated, "
    "count(*) = count(DISTINCT text) AS all_unique FROM documents",
)
def duplicate_texts(spark, sf_dir):
    return U.duplicate_texts(text_table(spark, sf_dir, "documents"), "text")


@query(
    "duplicate_rate",
    with_views(
        "SELECT count(*) AS rows, count(DISTINCT coalesce(text, '')) AS distinct_texts, "
        "round((count(*) - count(DISTINCT coalesce(text, ''))) * 100.0::DOUBLE / count(*), 6) AS duplicate_rate, "
        "(count(*) - count(DISTINCT coalesce(text, ''))) * 100.0::DOUBLE / count(*) > 10 AS high FROM ticket_view"
    ),
)
def duplicate_rate(spark, sf_dir):
    return U.duplicate_rate(C.fill_missing_text(ticket_view(spark, sf_dir), ["text"]), "text")


@query(
    "vocab_overlap",
    f"""
    WITH words AS (SELECT DISTINCT lang, unnest({Q.tokens('text')}) AS term FROM documents),
         langs AS (SELECT DISTINCT lang FROM documents),
         grid AS (SELECT a.lang AS class_a, b.lang AS class_b FROM langs a JOIN langs b ON a.lang < b.lang),
         shared AS (SELECT a.lang AS class_a, b.lang AS class_b, a.term,
                           row_number() OVER (PARTITION BY a.lang, b.lang ORDER BY a.term) AS r
                    FROM words a JOIN words b ON a.term = b.term AND a.lang < b.lang)
    SELECT g.class_a, g.class_b, count(s.term) AS overlap,
           coalesce(string_agg(s.term, ',' ORDER BY s.term) FILTER (s.r <= 5), '') AS examples,
           count(s.term) < 10 AS very_little
    FROM grid g LEFT JOIN shared s ON s.class_a = g.class_a AND s.class_b = g.class_b GROUP BY g.class_a, g.class_b
    """,
)
def vocab_overlap(spark, sf_dir):
    return U.vocab_overlap(text_table(spark, sf_dir, "documents"), "lang", "text")


def hash_rank_sql(key: str, group: str | None = None, seed: int = 42) -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)), {key})"


SPLIT_SQL = f"""
SELECT *, {hash_rank_sql('doc_id', 'lang')} <= floor(count(*) OVER (PARTITION BY lang) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test
FROM (SELECT doc_id, text, lang FROM documents)
"""


def _split(spark, sf_dir):
    documents = text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return X.stratified_split(documents, "lang", "doc_id")


@query(
    "split_leakage",
    f"SELECT doc_id, lang FROM ({SPLIT_SQL}) WHERE is_test AND text IN (SELECT text FROM ({SPLIT_SQL}) WHERE NOT is_test)",
)
def split_leakage(spark, sf_dir):
    """Test documents whose text also sits in the training part."""
    split = _split(spark, sf_dir)
    return U.split_leakage(split.filter(~F.col("is_test")), split.filter("is_test"), "text").select("doc_id", "lang")


@query(
    "split_leakage_complement",
    f"SELECT doc_id, lang FROM ({SPLIT_SQL}) WHERE is_test AND text NOT IN (SELECT text FROM ({SPLIT_SQL}) WHERE NOT is_test)",
)
def split_leakage_complement(spark, sf_dir):
    split = _split(spark, sf_dir)
    return U.unleaked(split.filter(~F.col("is_test")), split.filter("is_test"), "text").select("doc_id", "lang")


# --- sampling, splitting, balancing ------------------------------------------------
@query("sample_n", f"SELECT event_id, event_type FROM (SELECT *, {hash_rank_sql('event_id')} AS r FROM events) WHERE r <= 500")
def sample_n(spark, sf_dir):
    return X.sample_n(table(spark, sf_dir, "events").select("event_id", "event_type"), 500, "event_id")


@query("stratified_split", f"SELECT doc_id, lang, is_test FROM ({SPLIT_SQL})")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "lang", "is_test")


BALANCE_TARGET = 2000


@query(
    "balance_classes",
    f"""
    WITH ranked AS (SELECT event_id, event_type, {hash_rank_sql('event_id', 'event_type')} AS r,
                           count(*) OVER (PARTITION BY event_type) AS n FROM events),
         draws AS (SELECT event_type, i AS copy,
                          CAST('0x' || substr(md5('42:' || event_type || ':' || CAST(i AS VARCHAR)), 1, 12) AS BIGINT) % n + 1 AS r
                   FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) < {BALANCE_TARGET}),
                        generate_series(1, {BALANCE_TARGET}) AS g(i))
    SELECT event_id, event_type, r AS copy, CASE WHEN n > {BALANCE_TARGET} THEN 'undersampled' ELSE 'kept' END AS method
    FROM ranked WHERE n >= {BALANCE_TARGET} AND r <= {BALANCE_TARGET}
    UNION ALL
    SELECT event_id, event_type, copy, 'oversampled' FROM ranked JOIN draws USING (event_type, r)
    """,
)
def balance_classes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.balance_classes(events, "event_type", "event_id", BALANCE_TARGET)


@query(
    "cap_per_class",
    f"SELECT event_id, event_type FROM (SELECT *, {hash_rank_sql('event_id', 'event_type')} AS r FROM events) WHERE r <= 2000",
)
def cap_per_class(spark, sf_dir):
    return X.cap_per_class(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(
    "kfold_assign",
    f"SELECT doc_id, lang, ({hash_rank_sql('doc_id', 'lang')} - 1) % 5 AS fold FROM documents",
)
def kfold_assign(spark, sf_dir):
    return X.kfold_assign(text_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(
    "sample_in_category",
    f"SELECT event_id, event_type FROM (SELECT *, {hash_rank_sql('event_id')} AS r FROM events WHERE event_type = 'error') "
    "WHERE r <= 3",
)
def sample_in_category(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.sample_in_category(events, "event_type", "error", 3, "event_id")


@query(
    "stratified_sample",
    f"""
    SELECT event_id, event_type FROM (
        SELECT *, {hash_rank_sql('event_id', 'event_type')} AS r, count(*) OVER (PARTITION BY event_type) AS c,
               count(*) OVER () AS n FROM events)
    WHERE r <= floor(1000 * c::DOUBLE / n + 0.5::DOUBLE)
    """,
)
def stratified_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.stratified_sample(events, "event_type", "event_id", 1000)


