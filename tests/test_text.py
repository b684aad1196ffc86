import re

import pytest
from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import prompts as P
from ticketloom.functions import text as T

TEXTS = [
    "a. b? c", "hi supporter", "d1", "start the support team", "report via email trivia night", None, "", "   ",
    "HTTP://x HTTPS://abc hello there. b! c", "RT @bob Hi support my app crashes!! Why? ok",
    "Hi support I cannot login to my account please help me now with a very long story",
    "can’t é über café\xa0naïve https://t.co/x www.foo.bar ok. two! three? four",
    "to get to make an idea", "ends with rt ", "dear team   my order\x1cis late", "thanks for the i my refund",
    "one\ntwo\tthree\x0bfour\x85five", "emoji 😡😡 here ... done", "rt  rt Via x", "hi team i", "@a_b1@c http www x",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)


def run(spark, col):
    rows = frame(spark).select("id", col.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["id"])]


def expected_tweet(text):
    """Step by step with Python's own regex engine."""
    text = re.sub(r"@\w+", "", text or "")
    text = re.sub(r"(?:http|www)\S+", "", text)
    text = " ".join(re.sub(r"[^\w\s.?!]", " ", text).split()).lower()
    pieces = re.split("[.!?]", text)
    text = f"{pieces[0]}.{pieces[1]}." if len(pieces) > 2 else text
    for noise in (r"rt\s+", r"via\s+", r"https?\S+"):
        text = re.sub(noise, "", text)
    return " ".join(text.split())


def expected_ticket(text):
    text = re.sub(r"(?:http|www)\S+", "", (text or "").lower())
    mark = next((m for m in "?.!" if m in text), None)
    text = text[: text.index(mark)] if mark else text
    text = " ".join(re.sub(r"[^a-z\s]", " ", text).split())
    greeting = next((g for g in K.GREETING_PREFIXES if text.startswith(g)), None)
    if greeting:
        text = text[len(greeting):].strip()
        head, _, tail = text.partition(" ")
        text = tail if tail and head in K.GREETING_FOLLOWERS else text
    return " ".join([w for w in text.split() if len(w) > 2 and w not in K.TICKET_STOPWORDS][:8])


def test_tweet_cleaning_matches_python(spark):
    assert run(spark, T.clean_tweet_text(F.col("t"))) == [expected_tweet(t) for t in TEXTS]


def test_ticket_cleaning_matches_python(spark):
    assert run(spark, T.clean_ticket_text(F.col("t"))) == [expected_ticket(t) for t in TEXTS]


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (T.truncate_at_punctuation, "a. b? c", "a. b?"),
        (T.truncate_at_punctuation, "wow! yes", "wow!"),
        (T.truncate_at_punctuation, None, ""),
        (T.remove_greetings, "hi supporter", "er"),
        (T.remove_greetings, "Hello team  I want this", "want this"),
        (T.remove_greetings, "hi team i", "i"),
        (T.clean_ticket_text, "d1", ""),
        (T.clean_tweet_text, "start the support team", "stathe suppoteam"),
        (T.clean_tweet_text, "report via email trivia night", "repoemail trinight"),
        (T.clean_label_text, " A-b http://x c", " a b c"),
        (T.clean_query_text, "See https://x.y Error 404!!", "see error 404"),
        (T.clean_eda_text, "Don't panic, it is FINE", "dont panic fine"),
        (T.word_count, "  a  b c ", 3),
        (T.word_count, " ", 0),
        (T.preview, "abc", "abc..."),
    ],
)
def test_literal_cases(spark, fn, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fn(F.col("t"))).first()[0] == want


def test_anchored_noise_keeps_words(spark):
    df = spark.createDataFrame([("start the support team rt x",)], "t string")
    assert df.select(T.clean_tweet_text(F.col("t"), anchored=True)).first()[0] == "start the support team x"


def test_terms_and_ngrams(spark):
    df = spark.createDataFrame([("The big_one a éa x2",), ("solo",), ("",)], "t string")
    got = [r[0] for r in df.select(T.tokenise_terms(F.col("t"), ("the",), (1, 2))).collect()]
    assert got == [["big_one", "éa", "x2", "big_one éa", "éa x2"], ["solo"], []]


def test_whole_word(spark):
    df = spark.createDataFrame([("reorder now",), ("my order!",), ("order_id",)], "t string")
    got = [tuple(r) for r in df.select(T.contains_keyword(F.col("t"), "order"), T.contains_keyword(F.col("t"), "order", True)).collect()]
    assert got == [(True, False), (True, True), (True, False)]


def test_prompts(spark):
    df = spark.createDataFrame([("my ticket", "ctx")], "t string, c string")
    prompt = df.select(P.build_prompt(F.col("t"), F.col("c"), ["A", "B"])).first()[0]
    assert prompt == K.CLASSIFICATION_TEMPLATE.format(ticket_content="my ticket", context="ctx", categories="- A\n- B")
    with pytest.raises(ValueError):
        P.prompt_for("other")
