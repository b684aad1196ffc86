"""Word lists, label sets, thresholds and templates.

These must equal the published behaviour for results to agree, so they are
stated plainly here and nowhere else.
"""

from __future__ import annotations

# --- fixed values: label domains -------------------------------------------------
TICKET_CATEGORIES = ("Account", "Billing", "Fraud", "General Inquiry", "Technical")

TWEET_CATEGORIES = (
    "Account", "Billing", "Fraud", "General Inquiry", "Technical",
    "Delivery", "Feature Request", "Customer Support",
)

DEFAULT_CATEGORY = "General Inquiry"
UNKNOWN_CATEGORY = "unknown"

# --- fixed values: ticket cleaning -------------------------------------------------
TICKET_STOPWORDS = (
    "hi", "hello", "hey", "dear", "support", "team", "please", "thanks", "thank",
    "would", "could", "get", "make", "want", "need", "ask", "tell", "via", "rt", "amp",
)

GREETING_PREFIXES = (
    "hi support", "hello support", "dear support", "hi team", "hello team",
    "dear team", "thank you for", "thanks for", "please help",
)

# First word dropped after a greeting has been removed.
GREETING_FOLLOWERS = ("i", "my", "the", "a", "to", "with")

MAX_TICKET_WORDS = 8
MIN_MESSAGE_LENGTH = 15
MIN_RULE_CONFIDENCE = 0.3
MIN_MODEL_CONFIDENCE = 0.7
DEFAULT_TWEET_CONFIDENCE = 0.7

# --- fixed values: the public NLTK English stop list -------------------------------
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours
    yourself yourselves he him his himself she she's her hers herself it it's its itself
    they them their theirs themselves what which who whom this that that'll these those
    am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such
    no nor not only own same so than too very s t can will just don don't should should've
    now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn
    hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
    needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
    wouldn't
    """.split()
)

# --- fixed values: keyword ladders -------------------------------------------------
# (keywords, label), first match wins.
SIMPLE_LADDER = (
    (("account", "login", "password"), "account"),
    (("payment", "refund", "charge"), "payment"),
    (("not working", "error", "bug"), "technical"),
    (("delivery", "shipping"), "delivery"),
)
SIMPLE_LADDER_DEFAULT = "other"

EXPECTED_LADDER = (
    (("refund", "money back"), "Billing"),
    (("package", "delivery"), "Delivery"),
    (("suggest", "feature"), "Feature Request"),
    (("locked", "hacked", "password"), "Account"),
    (("crash", "error"), "Technical"),
)
EXPECTED_LADDER_DEFAULT = "Unknown"

# --- fixed values: fraud routing ---------------------------------------------------
DETECTOR_FRAUD_KEYWORDS = (
    "fraud", "scam", "unauthorized", "stolen", "hack", "compromised",
    "did not authorize", "didn't authorize", "false charge", "fake transaction",
)
DETECTOR_SUSPICIOUS_KEYWORDS = (
    "unknown charge", "suspicious", "didn't make", "wasn't me",
    "not me", "someone used", "my card was used",
)
ROUTER_FRAUD_KEYWORDS = (
    "fraud", "scam", "unauthorized", "stolen", "hack", "compromised",
    "did not authorize", "didn't authorize", "false charge",
)
ROUTER_SUSPICIOUS_KEYWORDS = (
    "unknown charge", "suspicious", "wasn't me", "not me",
    "someone used", "my card was used",
)
ROUTER_THRESHOLDS = {
    "Fraud": 0.25,
    "Technical": 0.50,
    "General Inquiry": 0.60,
    "Customer Support": 0.60,
    "Billing": 0.65,
    "Delivery": 0.65,
    "Account": 0.65,
    "Feature Request": 0.65,
}
ROUTER_DEFAULT_THRESHOLD = 0.60
KEYWORD_CONFIDENCE = 0.95

# --- fixed values: prompt templates ------------------------------------------------
CLASSIFICATION_TEMPLATE = """You are an expert support ticket classifier. Based on the ticket content and relevant context, classify this ticket into one of the predefined categories.

Ticket:
{ticket_content}

Relevant Context:
{context}

Categories:
{categories}

Provide your classification and confidence level (0-1)."""

RAG_TEMPLATE = """You are a helpful support assistant. Use the provided context to answer questions.

Context:
{context}

Question:
{question}

Answer based only on the provided context."""

# --- fixed values: monitoring thresholds -------------------------------------------
RETRAIN_MIN_ACCURACY = 0.75
RETRAIN_INTERVAL_DAYS = 7
DRIFT_THRESHOLD = 0.1
# (alert, metric, comparison, limit, channel)
ALERT_RULES = (
    ("accuracy_drop", "accuracy", "<", 0.75, "email"),
    ("high_latency", "p99_latency", ">", 5000.0, "slack"),
    ("data_drift", "drift_score", ">", 0.15, "email, slack"),
)
