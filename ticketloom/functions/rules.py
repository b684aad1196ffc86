"""Rule base for keyword labelling.

A rule base is a parameter of every labelling operator.  ``RuleBase.from_dict``
takes the usual nested dictionary (category -> primary / secondary / tertiary
keyword lists and a weight) plus a phrase map, ``RuleBase.read`` takes a rule
table on disk.  ``STARTER_RULES`` is the built-in base: all 284 keywords and 39
phrases of the published categorizer, in its order.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Score of a keyword hit, in multiples of the category weight.
TIER_FACTOR = {"primary": 2.0, "secondary": 1.0, "tertiary": 0.5}
# Extra multiple when a primary keyword occurs as a whole word.
WHOLE_WORD_FACTOR = 1.0

RULE_SCHEMA = "category_order int, category string, tier string, keyword string, weight double"
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    category: str
    tier: str
    keyword: str
    weight: float

    @property
    def points(self) -> int:
        """Score of a substring hit, times 100 so that sums are exact."""
        return round(self.weight * TIER_FACTOR[self.tier] * 100)

    @property
    def word_points(self) -> int:
        """Extra score when the keyword is also a whole word."""
        return round(self.weight * WHOLE_WORD_FACTOR * 100) if self.tier == "primary" else 0


@dataclass(frozen=True)
class RuleBase:
    rules: tuple[Rule, ...]
    phrases: tuple[tuple[str, str], ...]
    categories: tuple[str, ...]

    @classmethod
    def from_dict(cls, keywords: Mapping[str, Mapping], phrases: Mapping[str, str]) -> RuleBase:
        """Build from ``{category: {primary, secondary, tertiary, weight}}`` and a phrase map."""
        rules = []
        for category, spec in keywords.items():
            for tier in TIER_FACTOR:
                # A keyword listed twice in one tier still counts once per listing.
                rules += [Rule(category, tier, k, float(spec["weight"])) for k in spec.get(tier, ())]
        return cls(tuple(rules), tuple(phrases.items()), tuple(keywords))

    @classmethod
    def from_rows(cls, rows: Iterable, phrases: Mapping[str, str]) -> RuleBase:
        """Build from rows with the columns of ``RULE_SCHEMA``."""
        rows = list(rows)
        order = {r["category"]: r["category_order"] for r in rows}
        rules = tuple(Rule(r["category"], r["tier"], r["keyword"], float(r["weight"])) for r in rows)
        return cls(rules, tuple(phrases.items()), tuple(sorted(order, key=order.get)))

    @classmethod
    def read(cls, spark: SparkSession, path: str, phrases: Mapping[str, str], fmt: str = "csv") -> RuleBase:
        """Read a rule table; a rule base becomes part of the plan, so its size is checked."""
        table = spark.read.schema(RULE_SCHEMA).option("header", True).format(fmt).load(path)
        rows = table.limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"rule table {path} has more than {MAX_RULES} rows")
        return cls.from_rows(rows, phrases)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        order = {c: i for i, c in enumerate(self.categories)}
        rows = [(order[r.category], r.category, r.tier, r.keyword, r.weight) for r in self.rules]
        return spark.createDataFrame(rows, RULE_SCHEMA)


# --- fixed values: starter keywords ------------------------------------------------
STARTER_KEYWORDS = {
    "Fraud": {
        "primary": [
            "fraud", "scam", "unauthorized", "stolen", "hack", "compromised", "identity theft",
            "security breach", "fake transaction", "phishing", "money stolen", "card stolen",
            "account takeover", "breach",
        ],
        "secondary": [
            "suspicious", "fake", "not me", "wasn't me", "didn't authorize", "did not authorize",
            "unknown charge", "unrecognized", "fraudulent",
        ],
        "tertiary": [
            "stole", "theft", "hijack", "impersonation", "scammer", "hacker",
        ],
        "weight": 3.0,
    },
    "Billing": {
        "primary": [
            "refund", "charge", "billing", "payment", "invoice", "subscription", "overcharged",
            "double charge", "wrong charge", "billing issue", "payment failed", "chargeback",
            "credit card", "debit card",
        ],
        "secondary": [
            "money", "cost", "price", "overcharge", "cancel subscription", "renew subscription",
            "bill", "charged", "refund request", "money back", "return money", "get refund",
        ],
        "tertiary": [
            "fee", "tax", "discount", "coupon", "promo", "voucher", "credit", "statement",
            "receipt", "transaction", "withdrawal",
        ],
        "weight": 2.5,
    },
    "Technical": {
        "primary": [
            "crash", "error", "bug", "freeze", "not working", "failed", "broken", "glitch", "down",
            "offline", "unresponsive", "won't load", "won't open", "won't start", "stuck",
            "loading", "spinning wheel", "white screen", "black screen",
        ],
        "secondary": [
            "slow", "battery drain", "battery life", "update broke", "ios update", "android update",
            "connection issue", "wifi issue", "internet issue", "signal", "network", "lag", "delay",
            "timeout", "server error", "500 error", "404 error", "login error", "sync issue",
        ],
        "tertiary": [
            "hang", "stutter", "fps", "performance", "memory", "storage", "installation", "setup",
            "configure", "compatibility",
        ],
        "weight": 2.0,
    },
    "Account": {
        "primary": [
            "login", "password", "account", "signin", "access", "locked", "reset password",
            "forgot password", "change password", "verify account", "authentication", "two factor",
            "2fa", "email verification", "phone verification",
        ],
        "secondary": [
            "reset", "verification", "code", "profile", "email", "username", "user id",
            "credentials", "log in", "sign in", "can't login", "can't access", "locked out",
        ],
        "tertiary": [
            "register", "sign up", "create account", "delete account", "deactivate", "reactivate",
            "recover", "restore",
        ],
        "weight": 2.0,
    },
    "Delivery": {
        "primary": [
            "delivery", "shipping", "package", "order", "track", "arrive", "delivered", "shipment",
            "courier", "mail", "package not received", "order not delivered", "late delivery",
            "tracking number", "tracking update", "estimated delivery",
        ],
        "secondary": [
            "delay", "waiting", "received", "ship", "dispatch", "out for delivery", "in transit",
            "shipped", "fulfillment", "lost package", "missing package", "damaged package",
            "return", "exchange", "refund shipping",
        ],
        "tertiary": [
            "box", "envelope", "parcel", "freight", "expedite", "rush", "priority",
            "standard shipping", "free shipping",
        ],
        "weight": 1.8,
    },
    "Feature Request": {
        "primary": [
            "suggest", "feature", "improvement", "would like", "wish", "add feature", "new feature",
            "enhancement", "capability", "functionality", "option to", "ability to",
        ],
        "secondary": [
            "idea", "recommend", "propose", "request", "want to see", "hope to see",
            "it would be great", "it would be nice", "missing feature", "lack of", "doesn't have",
        ],
        "tertiary": [
            "upgrade", "update suggestion", "future release", "roadmap", "planned",
            "consider adding", "please add",
        ],
        "weight": 1.5,
    },
    "Customer Support": {
        "primary": [
            "help", "support", "assist", "customer service", "representative", "live chat",
            "call center", "helpline", "tech support", "customer care", "service team",
            "support team",
        ],
        "secondary": [
            "respond", "answer", "reply", "contact", "agent", "speak to", "talk to", "reach out",
            "get through", "wait time", "hold time", "escalate",
        ],
        "tertiary": [
            "complaint", "poor service", "bad support", "unhelpful", "great service",
            "excellent support", "helpful agent",
        ],
        "weight": 1.2,
    },
    "General Inquiry": {
        "primary": [
            "how", "what", "where", "when", "why", "who", "which", "question", "information",
            "about", "tell me", "explain", "clarify", "understand", "confused", "unsure",
        ],
        "secondary": [
            "help me understand", "can you tell", "do you know", "is it possible",
            "how does it work", "what is the", "where can I", "when will", "why is it",
        ],
        "tertiary": [
            "info", "details", "guidance", "instruction", "tutorial", "walkthrough", "example",
            "documentation",
        ],
        "weight": 1.0,
    },
}

# --- fixed values: phrases, tested in this order before any keyword ----------------
PHRASES = {
    "battery drain": "Technical",
    "battery life": "Technical",
    "update ruined": "Technical",
    "update broke": "Technical",
    "ios update": "Technical",
    "won't load": "Technical",
    "keep crashing": "Technical",
    "keeps freezing": "Technical",
    "spinning wheel": "Technical",
    "white screen": "Technical",
    "black screen": "Technical",
    "not responding": "Technical",
    "taking forever": "Technical",
    "double charge": "Billing",
    "wrong charge": "Billing",
    "money back": "Billing",
    "refund please": "Billing",
    "cancel subscription": "Billing",
    "can't login": "Account",
    "can't access": "Account",
    "locked out": "Account",
    "forgot password": "Account",
    "reset password": "Account",
    "identity theft": "Fraud",
    "security breach": "Fraud",
    "unauthorized transaction": "Fraud",
    "never received": "Delivery",
    "didn't arrive": "Delivery",
    "where is my package": "Delivery",
    "tracking number": "Delivery",
    "out for delivery": "Delivery",
    "would be nice": "Feature Request",
    "would be great": "Feature Request",
    "i wish": "Feature Request",
    "please add": "Feature Request",
    "customer service": "Customer Support",
    "live chat": "Customer Support",
    "talk to agent": "Customer Support",
    "speak to representative": "Customer Support",
}

STARTER_RULES = RuleBase.from_dict(STARTER_KEYWORDS, PHRASES)

