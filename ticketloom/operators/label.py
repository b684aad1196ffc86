"""Rule-based labelling, routing of model predictions and pseudo-labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.functions.matching import HAS_AUTOMATON, match_rules
from ticketloom.functions.rules import STARTER_RULES, RuleBase
from ticketloom.operators import columns as C
from ticketloom.operators.corpus import dedupe_keep_first
from ticketloom.operators.sampling import sample_n

MIN_RULE_TEXT = 5


def phrase_label(col: Column, rules: RuleBase = STARTER_RULES) -> Column:
    """Category of the first phrase, in rule order, that the lower-cased text contains."""
    text = F.lower(T.text_or_empty(col))
    # Neighbouring phrases of one category share a branch; the first hit still wins.
    branches: list[tuple[str, list[str]]] = []
    for phrase, category in rules.phrases:
        if branches and branches[-1][0] == category:
            branches[-1][1].append(phrase)
        else:
            branches.append((category, [phrase]))
    label = F
    for category, phrases in branches:
        label = label.when(T.contains_any(text, phrases), F.lit(category))
    return label if branches else F.lit(None).cast("string")


def _with_match(df: DataFrame, text_col: str, rules: RuleBase, native: bool) -> DataFrame:
    """Add the match struct of the lower-cased text."""
    lowered = F.lower(T.text_or_empty(F.col(text_col)))
    return C.compute_once(df, _match=match_rules(lowered, rules, native))


def keyword_scores(
    df: DataFrame, key: str, text_col: str, rules: RuleBase = STARTER_RULES, native: bool = not HAS_AUTOMATON
) -> DataFrame:
    """Positive keyword scores (times 100) in long form: key, category, score_x100."""
    names = F.array(*[F.lit(c) for c in rules.categories])
    scored = _with_match(df.select(key, text_col), text_col, rules, native)
    return (
        scored.select(key, F.posexplode("_match.scores").alias("_pos", "score_x100"))
        .filter(F.col("score_x100") > 0)
        .select(key, F.element_at(names, F.col("_pos") + 1).alias("category"), F.col("score_x100").cast("long").alias("score_x100"))
    )


def categorize(
    df: DataFrame, text_col: str, rules: RuleBase = STARTER_RULES, native: bool = not HAS_AUTOMATON
) -> DataFrame:
    """Add ``category`` and ``confidence``: short text, then phrases, then keyword scores."""
    matched = _with_match(df, text_col, rules, native)
    scores = F.col("_match.scores")
    best = F.array_max(scores)
    total = F.lit(0)
    for i in range(len(rules.categories)):
        total = total + scores[i]
    names = F.array(*[F.lit(c) for c in rules.categories])
    phrase_names = F.array(*[F.lit(c) for _, c in rules.phrases])
    # array_position returns the first match, so ties go to the earlier category.
    winner = F.element_at(names, F.array_position(scores, best).cast("int"))
    is_short = F.length(T.text_or_empty(F.col(text_col))) < MIN_RULE_TEXT
    has_phrase = F.col("_match.phrase") >= 0
    category = (
        F.when(is_short, F.lit(K.DEFAULT_CATEGORY))
        .when(has_phrase, F.element_at(phrase_names, F.col("_match.phrase") + 1))
        .when(best == 0, F.lit(K.DEFAULT_CATEGORY))
        .otherwise(winner)
    )
    confidence = (
        F.when(is_short, F.lit(0.5))
        .when(has_phrase, F.lit(K.KEYWORD_CONFIDENCE))
        .when(best == 0, F.lit(0.5))
        .otherwise(F.least(best / total, F.lit(K.KEYWORD_CONFIDENCE)))
    )
    return matched.withColumns({"category": category, "confidence": confidence}).drop("_match")


def process_messages(
    df: DataFrame,
    key: str,
    text_col: str = "text",
    inbound_col: str = "inbound",
    min_length: int = K.MIN_MESSAGE_LENGTH,
    sample: int | None = None,
    min_confidence: float = K.MIN_RULE_CONFIDENCE,
    rules: RuleBase = STARTER_RULES,
) -> DataFrame:
    """Messages -> labelled rows: inbound, clean, length, dedupe, categorise, confidence."""
    if sample is not None:
        df = sample_n(df, sample, key)
    inbound = C.filter_inbound(df, inbound_col)
    clean = C.compute_once(inbound.select(key, text_col), clean_text=T.clean_tweet_text(F.col(text_col))).drop(text_col)
    long_enough = C.filter_min_length(clean, "clean_text", min_length)
    unique = dedupe_keep_first(long_enough, ["clean_text"], key)
    labelled = C.filter_confidence(categorize(unique, "clean_text", rules), min_confidence)
    return labelled.select(key, "clean_text", "category", "confidence", F.lit("twitter").alias("source"))


def ladder_label(col: Column, ladder: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """First ladder step with a keyword in the lower-cased text."""
    text = F.lower(T.text_or_empty(col))
    label = F
    for keywords, name in ladder:
        label = label.when(T.contains_any(text, keywords), F.lit(name))
    return label.otherwise(F.lit(default))


def simple_label(col: Column) -> Column:
    """account / payment / technical / delivery / other."""
    return ladder_label(col, K.SIMPLE_LADDER, K.SIMPLE_LADDER_DEFAULT)


def expected_label(col: Column) -> Column:
    """Expected category of an evaluation query."""
    return ladder_label(col, K.EXPECTED_LADDER, K.EXPECTED_LADDER_DEFAULT)


def _decision(category: Column, confidence: Column, method: str, review: bool | Column) -> Column:
    needs_review = F.lit(review) if isinstance(review, bool) else review
    return F.struct(
        category.alias("category"),
        confidence.cast("double").alias("confidence"),
        F.lit(method).alias("method"),
        needs_review.alias("needs_review"),
    )


def fraud_detect(text: Column, prediction: Column, confidence: Column) -> Column:
    """Keyword match, then model thresholds, then suspicious words; struct of the decision."""
    lowered = F.lower(T.text_or_empty(text))
    fraud = F.lit("Fraud")
    return (
        F.when(
            T.contains_any(lowered, K.DETECTOR_FRAUD_KEYWORDS),
            _decision(fraud, F.lit(K.KEYWORD_CONFIDENCE), "keyword_match", False),
        )
        .when((prediction == fraud) & (confidence >= 0.3), _decision(fraud, confidence, "model_high", False))
        .when((prediction == fraud) & (confidence >= 0.15), _decision(fraud, confidence, "model_low", True))
        .when(
            T.contains_any(lowered, K.DETECTOR_SUSPICIOUS_KEYWORDS),
            _decision(prediction, confidence, "suspicious", True),
        )
        .otherwise(_decision(prediction, confidence, "normal", False))
    )


def route_predictions(
    text: Column,
    prediction: Column,
    confidence: Column,
    thresholds: Mapping[str, float] = K.ROUTER_THRESHOLDS,
    default_threshold: float = K.ROUTER_DEFAULT_THRESHOLD,
) -> Column:
    """Production routing: keyword match, weak fraud fallback, per-class review threshold."""
    lowered = F.lower(T.text_or_empty(text))
    fraud = F.lit("Fraud")
    limit = F.lit(default_threshold)
    for name, value in thresholds.items():
        limit = F.when(prediction == name, F.lit(value)).otherwise(limit)
    weak_fraud = (prediction == fraud) & (confidence < 0.3)
    return (
        F.when(
            T.contains_any(lowered, K.ROUTER_FRAUD_KEYWORDS),
            _decision(fraud, F.lit(K.KEYWORD_CONFIDENCE), "keyword_match", False),
        )
        .when(
            weak_fraud & T.contains_any(lowered, K.ROUTER_SUSPICIOUS_KEYWORDS),
            _decision(fraud, confidence, "model_low", True),
        )
        .when(weak_fraud, _decision(F.lit(K.DEFAULT_CATEGORY), confidence, "fallback", True))
        .otherwise(_decision(prediction, confidence, "model", confidence < limit))
    )


def confidence_band(confidence: Column) -> Column:
    """auto above 0.8, review from 0.5, human below."""
    return (
        F.when(confidence > 0.8, F.lit("auto")).when(confidence >= 0.5, F.lit("review")).otherwise(F.lit("human"))
    )


def pseudo_label(
    df: DataFrame,
    model: PipelineModel,
    text_col: str = "text",
    threshold: float = K.MIN_MODEL_CONFIDENCE,
) -> DataFrame:
    """Clean, score with a fitted text model, keep confident rows.  Works on batch and stream.

    The model reads ``clean_text`` and yields ``probability`` and ``predicted_label``.
    """
    clean = C.compute_once(df, clean_text=T.clean_ticket_text(F.col(text_col)))
    scored = model.transform(clean.filter(F.col("clean_text") != ""))
    return scored.select(
        *clean.columns,
        F.col("predicted_label").alias("predicted_category"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
        F.lit("twitter").alias("source"),
    ).filter(F.col("confidence") >= threshold)


def pseudo_label_counts(
    df: DataFrame,
    model: PipelineModel,
    text_col: str = "text",
    threshold: float = K.MIN_MODEL_CONFIDENCE,
) -> DataFrame:
    """Rows processed and rows retained by ``pseudo_label``, in one pass."""
    every = pseudo_label(df, model, text_col, threshold=0.0)
    return every.agg(
        F.count("*").alias("total_processed"),
        F.count_if(F.col("confidence") >= threshold).alias("high_confidence_retained"),
    )
