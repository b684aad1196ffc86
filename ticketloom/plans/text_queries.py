"""Queries for the text functions: whole texts of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import prompts as P
from ticketloom.functions import text as T
from ticketloom.plans import sqltext as Q
from ticketloom.plans.registry import query, text_table
from ticketloom.plans.views import ticket_view, with_views

DOCS = ("documents", "doc_id", "text")


@query("truncate_at_punctuation", Q.truncate_sql(*DOCS, "head"))
def truncate_at_punctuation(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", T.truncate_at_punctuation(F.col("text")).alias("head"))


@query("remove_greetings", with_views(Q.greetings_sql("ticket_view", "event_id", "text", "body")))
def remove_greetings(spark, sf_dir):
    return ticket_view(spark, sf_dir).select("event_id", T.remove_greetings(F.col("text")).alias("body"))


# What users of the conversations wrote.
USER = ("(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')", "conv_id, turn", "text")


def user_messages(spark, sf_dir):
    return text_table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")


@query("remove_greetings_messages", Q.greetings_sql(*USER, "body"))
def remove_greetings_messages(spark, sf_dir):
    return user_messages(spark, sf_dir).select("conv_id", "turn", T.remove_greetings(F.col("text")).alias("body"))


@query("clean_ticket_text", with_views(Q.ticket_sql("ticket_view", "event_id", "text")))
def clean_ticket_text(spark, sf_dir):
    return ticket_view(spark, sf_dir).select("event_id", T.clean_ticket_text(F.col("text")).alias("clean_text"))


@query("clean_ticket_text_documents", Q.ticket_sql(*DOCS))
def clean_ticket_text_documents(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", T.clean_ticket_text(F.col("text")).alias("clean_text"))


@query("clean_ticket_text_twitter", with_views(Q.ticket_sql("ticket_view", "event_id", "text", twitter=True)))
def clean_ticket_text_twitter(spark, sf_dir):
    clean = T.clean_ticket_text(F.col("text"), is_twitter=True)
    return ticket_view(spark, sf_dir).select("event_id", clean.alias("clean_text"))


@query("clean_ticket_text_twitter_messages", Q.ticket_sql(*USER, twitter=True))
def clean_ticket_text_twitter_messages(spark, sf_dir):
    clean = T.clean_ticket_text(F.col("text"), is_twitter=True)
    return user_messages(spark, sf_dir).select("conv_id", "turn", clean.alias("clean_text"))


@query("clean_tweet_text", with_views(Q.tweet_sql("ticket_view", "event_id", "text")))
def clean_tweet_text(spark, sf_dir):
    return ticket_view(spark, sf_dir).select("event_id", T.clean_tweet_text(F.col("text")).alias("clean_text"))


@query("clean_tweet_text_documents", Q.tweet_sql(*DOCS))
def clean_tweet_text_documents(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", T.clean_tweet_text(F.col("text")).alias("clean_text"))


@query("clean_eda_text", Q.eda_sql(*DOCS))
def clean_eda_text(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", T.clean_eda_text(F.col("text")).alias("clean_text"))


@query("clean_label_text", Q.label_text_sql(*DOCS))
def clean_label_text(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", T.clean_label_text(F.col("text")).alias("clean_text"))


@query("clean_query_text", Q.query_text_sql("pages", "page_id", "html"))
def clean_query_text(spark, sf_dir):
    """Raw pages: URLs, mark-up and symbols."""
    return text_table(spark, sf_dir, "pages").select("page_id", T.clean_query_text(F.col("html")).alias("clean_text"))


@query(
    "text_metrics",
    f"SELECT doc_id, length(coalesce(text, '')) AS text_length, {Q.word_count('text')} AS word_count FROM documents",
)
def text_metrics(spark, sf_dir):
    text = F.col("text")
    return text_table(spark, sf_dir, "documents").select(
        "doc_id", T.char_length(text).alias("text_length"), T.word_count(text).alias("word_count")
    )


_TOKENS = Q.tokens("text", K.ENGLISH_STOPWORDS)


@query(
    "tokenise_terms",
    f"""
    SELECT doc_id, len(w) + greatest(len(w) - 1, 0) AS n_terms,
           array_to_string(list_concat(w, list_transform(generate_series(1, len(w) - 1),
                                                         lambda i: w[i] || ' ' || w[i + 1])), '|') AS terms
    FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)
    """,
)
def tokenise_terms(spark, sf_dir):
    terms = T.tokenise_terms(F.col("text"), K.ENGLISH_STOPWORDS, (1, 2))
    return text_table(spark, sf_dir, "documents").select(
        "doc_id", F.size(terms).cast("long").alias("n_terms"), F.array_join(terms, "|").alias("terms")
    )


@query(
    "contains_keyword",
    with_views(
        "SELECT event_id, contains(lower(coalesce(text, '')), 'order') AS part, "
        f"regexp_matches(lower(coalesce(text, '')), '(^|[^{Q.LETTERS}])order($|[^{Q.LETTERS}])') AS word FROM ticket_view"
    ),
)
def contains_keyword(spark, sf_dir):
    text = F.col("text")
    return ticket_view(spark, sf_dir).select(
        "event_id",
        T.contains_keyword(text, "order").alias("part"),
        T.contains_keyword(text, "order", whole_word=True).alias("word"),
    )


@query(
    "contains_keyword_documents",
    "SELECT doc_id, contains(lower(coalesce(text, '')), 'who') AS part, "
    f"regexp_matches(lower(coalesce(text, '')), '(^|[^{Q.LETTERS}])who($|[^{Q.LETTERS}])') AS word FROM documents",
)
def contains_keyword_documents(spark, sf_dir):
    text = F.col("text")
    return text_table(spark, sf_dir, "documents").select(
        "doc_id",
        T.contains_keyword(text, "who").alias("part"),
        T.contains_keyword(text, "who", whole_word=True).alias("word"),
    )


def template_sql(template: str, **values: str) -> str:
    sql = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


_LISTING = "'" + "\n".join(f"- {c}" for c in K.TICKET_CATEGORIES) + "'"


@query(
    "build_prompt",
    with_views(
        "SELECT event_id, "
        + template_sql(
            K.CLASSIFICATION_TEMPLATE, categories=_LISTING, context="truth", ticket_content="coalesce(text, '')"
        )
        + " AS prompt, "
        + template_sql(K.RAG_TEMPLATE, context="truth", question="coalesce(text, '')")
        + " AS answer_prompt FROM ticket_view"
    ),
)
def build_prompt(spark, sf_dir):
    text = T.text_or_empty(F.col("text"))
    return ticket_view(spark, sf_dir).select(
        "event_id",
        P.prompt_for("classification", ticket=text, context=F.col("truth"), categories=K.TICKET_CATEGORIES).alias("prompt"),
        P.prompt_for("rag", context=F.col("truth"), question=text).alias("answer_prompt"),
    )


@query(
    "build_prompt_messages",
    "SELECT conv_id, turn, "
    + template_sql(K.CLASSIFICATION_TEMPLATE, categories=_LISTING, context="role", ticket_content="coalesce(text, '')")
    + " AS prompt, "
    + template_sql(K.RAG_TEMPLATE, context="role", question="coalesce(text, '')")
    + " AS answer_prompt FROM conversations",
)
def build_prompt_messages(spark, sf_dir):
    text = T.text_or_empty(F.col("text"))
    return text_table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        P.prompt_for("classification", ticket=text, context=F.col("role"), categories=K.TICKET_CATEGORIES).alias("prompt"),
        P.prompt_for("rag", context=F.col("role"), question=text).alias("answer_prompt"),
    )


@query("preview", "SELECT doc_id, substr(coalesce(text, ''), 1, 150) || '...' AS preview FROM documents")
def preview(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text"), 150).alias("preview"))
