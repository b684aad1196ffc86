"""Keyword matching of a rule base: one column with the first phrase and the category scores.

Testing every keyword on its own costs one scan of the text per keyword.  The
default matcher finds all of them in one scan with a keyword automaton inside an
Arrow-batched pandas UDF; where the automaton library is missing the same
result comes from native expressions.
"""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.functions.rules import RuleBase
from ticketloom.session import ship_by_value

ship_by_value(__name__)

# first phrase: number of the phrase or -1; scores: one integer per category, times 100.
MATCH_TYPE = "phrase int, scores array<int>"
HAS_AUTOMATON = importlib.util.find_spec("ahocorasick") is not None
# Wraps every word, so that whole-word hits become substring hits.
_MARK = "\x01"


def match_rules(lowered: Column, rules: RuleBase, native: bool = not HAS_AUTOMATON) -> Column:
    """Struct (phrase, scores) of a lower-cased, non-null text column."""
    return _native_match(lowered, rules) if native else _automaton_match(rules)(lowered)


def _automaton_match(rules: RuleBase):
    keyword_rules = [
        (r.keyword, rules.categories.index(r.category), r.points, r.word_points) for r in rules.rules
    ]
    phrases = [p for p, _ in rules.phrases]
    width = len(rules.categories)

    @F.pandas_udf(MATCH_TYPE)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        # One automaton entry per distinct word: its rules and its first phrase number.
        entries: dict[str, tuple[list, int]] = {}
        for word, category, points, word_points in keyword_rules:
            entries.setdefault(word, ([], len(phrases)))[0].append((category, points, word_points))
        for number, phrase in enumerate(phrases):
            found, first = entries.setdefault(phrase, ([], len(phrases)))
            entries[phrase] = (found, min(first, number))
        automaton = ahocorasick.Automaton()
        for word, entry in entries.items():
            automaton.add_word(word, (word, entry))
        automaton.make_automaton()

        for texts in batches:
            scores = np.zeros((len(texts), width), dtype=np.int32)
            first_phrases = np.full(len(texts), len(phrases), dtype=np.int32)
            for row, text in enumerate(texts):
                whole = _whole_words(automaton, text)
                for word, is_whole in whole.items():
                    word_rules, phrase = entries[word]
                    first_phrases[row] = min(first_phrases[row], phrase)
                    for category, points, word_points in word_rules:
                        scores[row, category] += points + (word_points if is_whole else 0)
            first_phrases[first_phrases == len(phrases)] = -1
            yield pd.DataFrame({"phrase": first_phrases, "scores": list(scores)})

    return match


def _whole_words(automaton, text: str) -> dict[str, bool]:
    """Words found in the text, and whether any occurrence stands as a whole word."""
    whole: dict[str, bool] = {}
    last = len(text) - 1
    for end, (word, _) in automaton.iter(text):
        if not whole.get(word, False):
            start = end - len(word) + 1
            whole[word] = (start == 0 or not _is_word(text[start - 1])) and (end == last or not _is_word(text[end + 1]))
    return whole


def _is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def _marked(keyword: str) -> str:
    return re.sub(r"(\w+)", rf"{_MARK}\1{_MARK}", keyword)


def _native_match(lowered: Column, rules: RuleBase) -> Column:
    """The same struct from higher-order functions over literal rule lists."""
    marked = F.regexp_replace(lowered, f"({T.WORD}+)", f"{_MARK}$1{_MARK}")
    scores = []
    for category in rules.categories:
        listing = [
            {"k": r.keyword, "m": _marked(r.keyword), "p": r.points, "w": r.word_points}
            for r in rules.rules
            if r.category == category
        ]
        literal = F.from_json(F.lit(json.dumps(listing)), "array<struct<k:string,m:string,p:int,w:int>>")
        scores.append(F.aggregate(literal, F.lit(0), lambda total, r: total + _points(lowered, marked, r)))
    words = F.from_json(F.lit(json.dumps([p for p, _ in rules.phrases])), "array<string>")
    hits = F.transform(words, lambda p: F.contains(lowered, p))
    phrase = F.coalesce(F.array_position(hits, F.lit(True)), F.lit(0)) - 1
    return F.struct(phrase.cast("int").alias("phrase"), F.array(*scores).alias("scores"))


def _points(lowered: Column, marked: Column, rule: Column) -> Column:
    whole = F.when((rule["w"] > 0) & F.contains(marked, rule["m"]), rule["w"]).otherwise(0)
    return F.when(F.contains(lowered, rule["k"]), rule["p"] + whole).otherwise(0)
