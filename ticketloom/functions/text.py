"""Text functions: ``Column -> Column``, native expressions only.

Character classes are spelled out because ``\\w`` and ``\\s`` differ between
regex dialects: words are Unicode letters, numbers and underscore, whitespace is
the full Unicode set.  A null text is treated as the empty string.  Every step
names its input once, so that no step is evaluated twice.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions import constants as K

# Whitespace for patterns that start with the Unicode flag (?U): there \\s is the Unicode
# property, a bit test that is several times faster than a listed class; the four
# separators after it are whitespace as well.
BLANK = r"\s\x{1c}-\x{1f}"
NOT_BLANK = f"[^{BLANK}]"
# The same characters one by one, for trimming.
BLANK_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

MENTION = f"@{WORD}+"
# The https form is covered by the http form.
URL = f"(?U)(?:http|www){NOT_BLANK}+"


def text_or_empty(col: Column) -> Column:
    """Null text becomes the empty string."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.btrim(col, F.lit(BLANK_CHARS))


def squeeze(col: Column) -> Column:
    """Collapse every whitespace run to one blank."""
    return F.regexp_replace(col, f"(?U)[{BLANK}]+", " ")


def remove_urls(col: Column) -> Column:
    return F.regexp_replace(col, URL, "")


def any_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """True when the text contains at least one of the words as a substring."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(col, F.lit(w))
    return hit


def _up_to_punctuation(col: Column) -> Column:
    # Ordered alternatives: the first one that can match decides.
    return F.regexp_extract(col, r"(?s)^(?:[^?]*\?|[^.]*\.|[^!]*!|.*)", 0)


def truncate_at_punctuation(col: Column) -> Column:
    """Keep the text up to the first ``?``, else the first ``.``, else the first ``!``."""
    return strip(_up_to_punctuation(text_or_empty(col)))


def _without_greeting(stripped: Column) -> Column:
    followers = any_of(K.GREETING_FOLLOWERS)
    return F.regexp_replace(
        stripped, f"(?U)^(?:{any_of(K.GREETING_PREFIXES)})[{BLANK}]*(?:(?:{followers}) )?", ""
    )


def remove_greetings(col: Column) -> Column:
    """Drop one leading greeting (a plain prefix, not word bounded) and one follower word."""
    return _without_greeting(strip(F.lower(text_or_empty(col))))


def clean_ticket_text(
    col: Column,
    max_words: int = K.MAX_TICKET_WORDS,
    greetings: bool = True,
    is_twitter: bool = False,
) -> Column:
    """Ticket cleaning: first sentence, letters only, stop words out, first ``max_words`` words."""
    text = text_or_empty(col)
    if is_twitter:
        text = F.regexp_replace(text, MENTION, "")
        text = F.regexp_replace(text, f"(?U)^[rR][tT][{BLANK}]+", "")
    text = _up_to_punctuation(remove_urls(F.lower(text)))
    text = F.trim(F.regexp_replace(text, "[^a-z]+", " "))
    if greetings and not is_twitter:
        text = _without_greeting(text)
    # Only a-z and single blanks are left, so ASCII word boundaries are exact here.
    text = F.regexp_replace(text, rf"\b(?:[a-z]{{1,2}}|{any_of(K.TICKET_STOPWORDS)})\b", "")
    return F.trim(F.substring_index(F.trim(F.regexp_replace(text, " +", " ")), " ", max_words))


def clean_tweet_text(col: Column, anchored: bool = False) -> Column:
    """Message cleaning: mentions, URLs and symbols out, first two sentences, noise out.

    The noise patterns are unanchored by default ("support team" loses its "rt ");
    ``anchored=True`` restricts them to whole words.
    """
    text = remove_urls(F.regexp_replace(text_or_empty(col), MENTION, ""))
    # Sentence ends survive the symbol step unchanged, so long texts are cut before it.
    text = F.regexp_replace(text, r"(?s)^([^.!?]*)[.!?]([^.!?]*)[.!?].*$", "$1.$2.")
    # Symbols become blanks and blanks are collapsed, in one step.
    text = F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_.?!]+", " ")))
    edge = f"(?<!{WORD})" if anchored else ""
    # Symbols are gone by now, so entity patterns such as "&amp;" cannot occur.
    for noise in ("rt +", "via +", "https?[^ ]+"):
        text = F.regexp_replace(text, edge + noise, "")
    return F.trim(F.regexp_replace(text, " +", " "))


def clean_eda_text(col: Column, stopwords: Sequence[str] = K.ENGLISH_STOPWORDS) -> Column:
    """Lower case, delete symbols, drop stop words."""
    text = F.regexp_replace(F.lower(text_or_empty(col)), f"(?U)[^a-z0-9{BLANK}]+", "")
    words = F.split(strip(text), f"(?U)[{BLANK}]+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stopwords)), " ")


def clean_label_text(col: Column) -> Column:
    """Lower case, drop URLs, letters only, blanks collapsed but not trimmed."""
    text = F.regexp_replace(F.lower(text_or_empty(col)), f"(?U)http{NOT_BLANK}+", "")
    return F.regexp_replace(text, "[^a-z]+", " ")


def clean_query_text(col: Column) -> Column:
    """Lower case, drop URLs, letters and digits only, trimmed."""
    text = F.regexp_replace(F.lower(text_or_empty(col)), URL, "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def char_length(col: Column) -> Column:
    return F.length(text_or_empty(col)).cast("long")


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    words = F.split(strip(text_or_empty(col)), f"(?U)[{BLANK}]+")
    # A blank text splits into one empty string; no other text yields an empty one.
    return F.size(F.array_remove(words, "")).cast("long")


def tokenise_terms(
    col: Column,
    stopwords: Sequence[str] = (),
    ngram: tuple[int, int] = (1, 1),
) -> Column:
    """Lower-case word tokens of two or more characters, minus stop words, as n-grams."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit(f"({WORD}{{2,}})"), F.lit(1))
    if stopwords:
        tokens = F.filter(tokens, lambda w: ~w.isin(*stopwords))
    if ngram == (1, 1):
        return tokens
    # The lambda variable holds the tokens, so they are extracted once per text.
    return F.element_at(F.transform(F.array(tokens), lambda words: _ngrams(words, *ngram)), 1)


def _ngrams(words: Column, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` neighbouring words, each joined by blanks."""
    parts, grams = [], words
    for n in range(1, high + 1):
        if n > 1:
            # A run of n is a run of n - 1 and the word after it.
            pairs = F.greatest(F.size(words) - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), pairs), F.slice(words, F.lit(n), pairs), lambda a, b: F.concat_ws(" ", a, b)
            )
        if n >= low:
            parts.append(grams)
    return F.concat(*parts)


def contains_keyword(col: Column, keyword: str, whole_word: bool = False) -> Column:
    """Lower-cased substring test, or whole-word test guarded by the substring test."""
    text = F.lower(text_or_empty(col))
    hit = F.contains(text, F.lit(keyword))
    if not whole_word:
        return hit
    return F.when(hit, F.rlike(text, F.lit(whole_word_pattern(keyword)))).otherwise(F.lit(False))


def whole_word_pattern(keyword: str) -> str:
    return f"(?<!{WORD}){re.escape(keyword)}(?!{WORD})"


def preview(col: Column, n: int = 60) -> Column:
    """First ``n`` characters followed by an ellipsis."""
    return F.concat(F.substring(text_or_empty(col), 1, n), F.lit("..."))
