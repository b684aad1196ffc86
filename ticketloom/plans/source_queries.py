"""Queries for sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.operators import columns as C
from ticketloom.operators import evaluate as E
from ticketloom.plans.registry import query, table, table_stream
from ticketloom.plans.views import sql_in, ticket_view, with_views
from ticketloom.session import work_path
from ticketloom.sources import tables as S
from ticketloom.sources import vectors as SV
from ticketloom.streaming import jobs as J

DOC_COLUMNS = ("doc_id", "lang", "source", "n_chars")


@query("load_table", "SELECT doc_id, lang, source, n_chars FROM documents")
def load_table(spark, sf_dir):
    return S.load_table(spark, f"{sf_dir}/documents.parquet", "parquet").select(*DOC_COLUMNS)


@query("save_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def save_table(spark, sf_dir):
    """Round trip of the whole table through json lines."""
    documents = table(spark, sf_dir, "documents")
    path = work_path(spark, "save-table")
    S.save_table(documents, path, "json")
    return S.load_table(spark, path, "json", schema=documents.schema)


@query("read_messages_csv", "SELECT conv_id, turn, role, text FROM conversations")
def read_messages_csv(spark, sf_dir):
    """Messages written as quoted CSV (texts hold commas, quotes and newlines) and read back."""
    messages = table(spark, sf_dir, "conversations")
    path = work_path(spark, "messages-csv")
    S.save_table(messages, path, "csv")
    return S.read_messages_csv(spark, path, messages.schema)


@query("scan_pruned", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def scan_pruned(spark, sf_dir):
    return S.scan_pruned(spark, f"{sf_dir}/events.parquet", [("event_id", "string"), ("event_type", "string")])


@query("stream_source", "SELECT event_id, event_type, value FROM events")
def stream_source(spark, sf_dir):
    """The events table as an incremental file stream, landed once."""
    stream = table_stream(spark, sf_dir, "events", max_files=1)
    path = work_path(spark, "stream-source")
    return J.run_available(stream.select("event_id", "event_type", "value"), f"{path}/out", f"{path}/checkpoint")


@query("append_sink", "SELECT conv_id, turn, role FROM conversations")
def append_sink(spark, sf_dir):
    """Two runs over the same input: the second adds nothing."""
    path = work_path(spark, "append-sink")
    for _ in range(2):
        stream = table_stream(spark, sf_dir, "conversations")
        landed = J.run_available(stream.select("conv_id", "turn", "role"), f"{path}/out", f"{path}/checkpoint")
    return landed


@query("materialise_once", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def materialise_once(spark, sf_dir):
    """Built on the first call, loaded on the second."""
    path = work_path(spark, "materialise-once")
    build = lambda: table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    S.materialise_once(spark, path, build)
    return S.materialise_once(spark, path, build)


@query(
    "first_available_source",
    "SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark",
)
def first_available_source(spark, sf_dir):
    """No merged table, so the parts that exist are united."""
    parts = [f"{sf_dir}/{n}.parquet" for n in ("documents", "tickets_absent", "benchmark")]
    return S.first_available(spark, f"{sf_dir}/merged_absent.parquet", parts).select("doc_id", "item_id", "text")


@query("head_sample", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 1000")
def head_sample(spark, sf_dir):
    return S.head_sample(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), 1000, "event_id")


VECTOR_ROWS_SQL = "SELECT vec_id, label, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"


def _vector_rows(df):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"))


@query("write_read_vectors", VECTOR_ROWS_SQL)
def write_read_vectors(spark, sf_dir):
    path = work_path(spark, "vectors")
    SV.write_vectors(table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding", keep=["label"])
    return _vector_rows(SV.read_vectors(spark, path))


@query(
    "add_documents",
    """
    SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(list_transform(embedding, lambda x: -(x::DOUBLE))), 6) AS total
    FROM embeddings
    UNION ALL SELECT -vec_id - 1, label, len(embedding), round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6)
    FROM embeddings
    """,
)
def add_documents(spark, sf_dir):
    """A corpus that gets as many new ids, then other vectors for its old ids, these twice."""
    vectors = table(spark, sf_dir, "embeddings")
    path = work_path(spark, "corpus")
    SV.write_vectors(vectors, path, "vec_id", "embedding", keep=["label"])
    newer = vectors.withColumn("vec_id", -F.col("vec_id") - 1)
    SV.add_documents(newer, path, "vec_id", "embedding", keep=["label"])
    turned = vectors.withColumn("embedding", F.transform("embedding", lambda x: -x))
    for _ in range(2):
        SV.add_documents(turned, path, "vec_id", "embedding", keep=["label"], batch="turned")
    return _vector_rows(SV.read_vectors(spark, path))


@query("run_stats", "SELECT count(*) AS total_documents, max(len(embedding)) AS embedding_dimension FROM embeddings")
def run_stats(spark, sf_dir):
    stats = SV.run_stats(table(spark, sf_dir, "embeddings"), "embedding", "stored-vectors", 60.0)
    return stats.select("total_documents", F.col("embedding_dimension").cast("long").alias("embedding_dimension"))


@query(
    "save_results",
    with_views("SELECT truth, prediction, count(*) AS n FROM ticket_view GROUP BY truth, prediction"),
)
def save_results(spark, sf_dir):
    """Confusion counts exported as CSV and read back."""
    path = work_path(spark, "results")
    S.save_results({"confusion": E.confusion_counts(ticket_view(spark, sf_dir), "truth", "prediction")}, path)
    return S.load_table(spark, f"{path}/confusion", "csv", schema="truth string, prediction string, n long")


# --- projections and filters -------------------------------------------------------
@query(
    "standardise_tickets",
    with_views(
        "SELECT event_id, text AS clean_text, Issue_Category AS category, 'ticket' AS source, "
        "1.0::DOUBLE AS confidence FROM ticket_view WHERE source = 'ticket'"
    ),
)
def standardise_tickets(spark, sf_dir):
    tickets = ticket_view(spark, sf_dir).filter(F.col("source") == "ticket")
    return C.standardise_tickets(tickets, "text", "Issue_Category", keep=["event_id"])


@query(
    "standardise_tweets",
    with_views(
        "SELECT event_id, text AS clean_text, truth AS category, 'twitter' AS source, "
        "0.7::DOUBLE AS confidence FROM ticket_view WHERE source = 'twitter'"
    ),
)
def standardise_tweets(spark, sf_dir):
    """No confidence column, so the default applies."""
    tweets = ticket_view(spark, sf_dir).filter(F.col("source") == "twitter").drop("confidence")
    return C.standardise_tweets(tweets, "text", "truth", keep=["event_id"])


@query("pick_text_column", "SELECT doc_id, text AS full_text FROM documents")
def pick_text_column(spark, sf_dir):
    return C.pick_text_column(table(spark, sf_dir, "documents")).select("doc_id", "full_text")


@query("pick_category_column", with_views("SELECT event_id, coalesce(Issue_Category, 'unknown') AS category FROM ticket_view"))
def pick_category_column(spark, sf_dir):
    return C.pick_category_column(ticket_view(spark, sf_dir)).select("event_id", "category")


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, sf_dir):
    return C.drop_columns(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal", "Customer_Email"])


@query("concat_text", with_views("SELECT event_id, coalesce(truth, '') || ' ' || coalesce(text, '') AS full_text FROM ticket_view"))
def concat_text(spark, sf_dir):
    return C.concat_text(ticket_view(spark, sf_dir), ["truth", "text"], "full_text").select("event_id", "full_text")


@query("filter_inbound", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def filter_inbound(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").withColumn("inbound", F.col("role") == "user")
    return C.filter_inbound(messages).select("conv_id", "turn", "text")


@query(
    "filter_ticket_categories",
    with_views(f"SELECT event_id, Issue_Category FROM ticket_view WHERE Issue_Category IN {sql_in(K.TICKET_CATEGORIES)}"),
)
def filter_ticket_categories(spark, sf_dir):
    return C.filter_ticket_categories(ticket_view(spark, sf_dir), "Issue_Category").select("event_id", "Issue_Category")


@query(
    "filter_tweet_categories",
    with_views(f"SELECT event_id, Issue_Category FROM ticket_view WHERE Issue_Category IN {sql_in(K.TWEET_CATEGORIES)}"),
)
def filter_tweet_categories(spark, sf_dir):
    return C.filter_tweet_categories(ticket_view(spark, sf_dir), "Issue_Category").select("event_id", "Issue_Category")


@query("filter_min_length", with_views("SELECT event_id, text FROM ticket_view WHERE length(text) >= 15"))
def filter_min_length(spark, sf_dir):
    return C.filter_min_length(ticket_view(spark, sf_dir), "text").select("event_id", "text")


@query(
    "filter_nonempty",
    with_views("SELECT event_id, trim(text) AS text FROM ticket_view WHERE trim(coalesce(text, '')) <> ''"),
)
def filter_nonempty(spark, sf_dir):
    return C.filter_nonempty(ticket_view(spark, sf_dir).select("event_id", "text"), ["text"])


@query("filter_confidence", with_views("SELECT event_id, prediction, confidence FROM ticket_view WHERE confidence >= 0.7::DOUBLE"))
def filter_confidence(spark, sf_dir):
    view = ticket_view(spark, sf_dir).select("event_id", "prediction", "confidence")
    return C.filter_confidence(view, K.MIN_MODEL_CONFIDENCE)


@query("fill_missing_text", with_views("SELECT event_id, coalesce(text, '') AS text FROM ticket_view"))
def fill_missing_text(spark, sf_dir):
    return C.fill_missing_text(ticket_view(spark, sf_dir).select("event_id", "text"), ["text"])


@query(
    "assign_index",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS embedding_index FROM orders",
)
def assign_index(spark, sf_dir):
    """A narrow range width, so that many ranges take part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return C.assign_index(orders, "o_orderkey")


AUDIT_SQL = with_views("""
SELECT 1 AS step_no, 'inbound' AS step, count(*) AS rows_in, count(*) FILTER (inbound) AS rows_out,
       count(*) - count(*) FILTER (inbound) AS removed FROM ticket_view
UNION ALL
SELECT 2, 'has text', count(*) FILTER (inbound), count(*) FILTER (inbound AND text <> ''),
       count(*) FILTER (inbound) - count(*) FILTER (inbound AND text <> '') FROM ticket_view
UNION ALL
SELECT 3, 'long enough', count(*) FILTER (inbound AND text <> ''), count(*) FILTER (inbound AND text <> '' AND length(text) >= 15),
       count(*) FILTER (inbound AND text <> '') - count(*) FILTER (inbound AND text <> '' AND length(text) >= 15) FROM ticket_view
""")


@query("filter_by_audit", AUDIT_SQL)
def filter_by_audit(spark, sf_dir):
    steps = [
        ("inbound", lambda d: d["inbound"]),
        ("has text", lambda d: d["text"] != ""),
        ("long enough", lambda d: F.length(d["text"]) >= K.MIN_MESSAGE_LENGTH),
    ]
    return C.audit_steps(ticket_view(spark, sf_dir), steps)


