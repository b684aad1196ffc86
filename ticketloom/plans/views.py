"""Support-message views over the generic tables, in Spark and as SQL.

The given corpora are invented prose in which rule keywords hardly occur, so a
ticket view is derived from ``events``: every event becomes one message whose
sentence is chosen by its id and closed by its user id.  The same literals make
the Spark view and the SQL view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions.constants import TWEET_CATEGORIES
from ticketloom.plans.registry import text_table

# (message, true category)
MESSAGES = (
    ("@support my card was stolen and someone used it for a fake transaction!", "Fraud"),
    ("I did not authorize this payment, looks like a scam", "Fraud"),
    ("Suspicious login from another country, that was not me. Please check", "Fraud"),
    ("Someone hacked my account and changed the password", "Fraud"),
    ("unknown charge on my statement, wasn't me", "Fraud"),
    ("identity theft alert, who do I call?", "Fraud"),
    ("Double charge on my package order http://t.co/abc123", "Billing"),
    ("Please refund my last payment, the invoice is wrong", "Billing"),
    ("I want my money back!!! This subscription is a joke", "Billing"),
    ("billing issue: credit card charged twice for the same price", "Billing"),
    ("Thanks for nothing, you overcharged me and kept the fee", "Billing"),
    ("how do i cancel subscription and get a discount?", "Billing"),
    ("The app crashes every time I open it. Error 500 again", "Technical"),
    ("RT @news the update broke my phone, battery drain is awful", "Technical"),
    ("website is down and not working since morning", "Technical"),
    ("keeps freezing on a white screen? Please fix", "Technical"),
    ("slow loading, network glitch, stuck at login error", "Technical"),
    ("bug after ios update. It won't load. Really bad.", "Technical"),
    ("Hi support I cannot login to my account please help me", "Account"),
    ("can't login since the password reset", "Account"),
    ("locked out of my account after verify account email", "Account"),
    ("Forgot password, the verification code never comes", "Account"),
    ("dear team my profile username is wrong, change password link fails", "Account"),
    ("two factor authentication code does not reach my phone", "Account"),
    ("where is my package? tracking number shows nothing", "Delivery"),
    ("never received my parcel, delivery was late", "Delivery"),
    ("shipment delay again, courier lost the envelope", "Delivery"),
    ("my order did not arrive and the mail box is empty", "Delivery"),
    ("Out for delivery for three days @courier https://www.example.com/track", "Delivery"),
    ("waiting for dispatch of the shipping label", "Delivery"),
    ("I wish you had a dark mode, would be great", "Feature Request"),
    ("please add an option to export, nice improvement idea", "Feature Request"),
    ("I suggest a new feature: ability to sort", "Feature Request"),
    ("would like an enhancement for the future release", "Feature Request"),
    ("request: recommend more functionality for teams", "Feature Request"),
    ("hello team i propose to upgrade the search capability", "Feature Request"),
    ("start the support team chat, I need to speak to representative", "Customer Support"),
    ("nobody will answer or reply, poor service from this agent", "Customer Support"),
    ("your customer service is great, thank you", "Customer Support"),
    ("live chat has a long wait, please escalate my complaint", "Customer Support"),
    ("Please help, the call center never picks up", "Customer Support"),
    ("report via email trivia night to the helpline", "Customer Support"),
    ("How does it work and what is the price of the guide?", "General Inquiry"),
    ("Can you tell me where to find more information", "General Inquiry"),
    ("thank you for the details, I understand it now", "General Inquiry"),
    ("which documents explain when the shop opens", "General Inquiry"),
    ("just a question about the opening hours", "General Inquiry"),
    ("xyzzy plugh", "General Inquiry"),
    ("café résumé naïve über straße \U0001f621 what a day", "General Inquiry"),
    ("help", "General Inquiry"),
    ("d1", "General Inquiry"),
    ("", "General Inquiry"),
    (None, "General Inquiry"),
    ("hi supporter", "General Inquiry"),
)

# What an agent entered for a ticket; not every value is a valid ticket category.
TICKET_LABELS = ("Account", "Billing", "Fraud", "General Inquiry", "Technical", "Delivery", "Misc")

TICKETS_PER_LABEL = 7
# Predictions below this roll are wrong.
WRONG_BELOW = 25


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


def pick(values, position):
    """Element of a literal list by a 0-based position column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def ticket_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One support message per event, with a logged prediction."""
    return tickets_of(text_table(spark, sf_dir, "events"))


def tickets_of(events: DataFrame) -> DataFrame:
    """The view over a batch or streaming events table."""
    which = F.col("event_id") % len(MESSAGES)
    sentence = pick([m for m, _ in MESSAGES], which)
    roll = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    truth = pick([c for _, c in MESSAGES], which)
    return events.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.length(sentence) >= 5, F.concat(sentence, F.lit(" ref "), F.col("user_id").cast("string")))
        .otherwise(sentence)
        .alias("text"),
        (F.col("event_type") != "view").alias("inbound"),
        F.when(F.col("event_type") == "signup", F.lit("ticket")).otherwise(F.lit("twitter")).alias("source"),
        pick(TICKET_LABELS, F.floor(F.col("event_id") / TICKETS_PER_LABEL) % len(TICKET_LABELS)).alias("Issue_Category"),
        truth.alias("truth"),
        F.when(roll >= WRONG_BELOW, truth)
        .otherwise(pick(TWEET_CATEGORIES, roll % len(TWEET_CATEGORIES)))
        .alias("prediction"),
        (roll / F.lit(100.0)).alias("confidence"),
        (F.col("value") * 100).alias("latency_ms"),
        (F.col("event_type") == "error").alias("is_error"),
    )


TICKET_VIEW_SQL = f"""
SELECT event_id, ts, user_id,
       CASE WHEN length(sentence) >= 5 THEN sentence || ' ref ' || CAST(user_id AS VARCHAR) ELSE sentence END AS text,
       event_type <> 'view' AS inbound,
       CASE WHEN event_type = 'signup' THEN 'ticket' ELSE 'twitter' END AS source,
       ({sql_list(TICKET_LABELS)})[(event_id // {TICKETS_PER_LABEL}) % {len(TICKET_LABELS)} + 1] AS Issue_Category,
       truth,
       CASE WHEN roll >= {WRONG_BELOW} THEN truth
            ELSE ({sql_list(TWEET_CATEGORIES)})[roll % {len(TWEET_CATEGORIES)} + 1] END AS prediction,
       roll / 100.0::DOUBLE AS confidence,
       value * 100 AS latency_ms,
       event_type = 'error' AS is_error
FROM (SELECT *, ({sql_list([m for m, _ in MESSAGES])})[event_id % {len(MESSAGES)} + 1] AS sentence,
             ({sql_list([c for _, c in MESSAGES])})[event_id % {len(MESSAGES)} + 1] AS truth,
             CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS roll
      FROM events)
"""


def with_views(sql: str, **extra: str) -> str:
    """Prefix a statement with the views it names."""
    views = {"ticket_view": TICKET_VIEW_SQL, **extra}
    used = {n: body for n, body in views.items() if n in sql or any(n in b for b in extra.values())}
    if not used:
        return sql
    views_sql = "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in used.items())
    body = sql.strip()
    # A statement with its own WITH list joins the same list.
    return f"{views_sql},\n{body[4:]}" if body.startswith("WITH") else f"{views_sql}\n{body}"
