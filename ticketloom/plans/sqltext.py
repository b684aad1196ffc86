"""SQL statements for the text functions, written apart from the Spark expressions."""

from __future__ import annotations

import re

from ticketloom.functions import constants as K
from ticketloom.functions.rules import STARTER_RULES, RuleBase
from ticketloom.plans.views import sql_in

BLANKS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = r"\p{L}\p{N}_"
URLS = f"http[^{BLANKS}]+|www[^{BLANKS}]+|https[^{BLANKS}]+"


def chain(source: str, keep: str, first: str, *steps: str, out: str = "x") -> str:
    """Nested selects: each step rewrites column x of the one before."""
    sql = f"SELECT {keep}, {first} AS x FROM {source}"
    for step in steps:
        sql = f"SELECT {keep}, {step} AS x FROM ({sql})"
    return sql if out == "x" else f"SELECT {keep}, x AS {out} FROM ({sql})"


def replace_all(pattern: str, by: str = "", x: str = "x") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


STRIP = replace_all(f"^[{BLANKS}]+|[{BLANKS}]+$")
TRUNCATE = (
    "CASE WHEN contains(x, '?') THEN split_part(x, '?', 1) || '?' "
    "WHEN contains(x, '.') THEN split_part(x, '.', 1) || '.' "
    "WHEN contains(x, '!') THEN split_part(x, '!', 1) || '!' ELSE x END"
)


def _followers(rest: str) -> str:
    starts = " OR ".join(f"starts_with({rest}, '{w} ')" for w in K.GREETING_FOLLOWERS)
    return f"CASE WHEN {starts} THEN substr({rest}, strpos({rest}, ' ') + 1) ELSE {rest} END"


def _greetings() -> str:
    branches = []
    for g in K.GREETING_PREFIXES:
        rest = replace_all(f"^[{BLANKS}]+", x=f"substr(x, {len(g) + 1})")
        branches.append(f"WHEN starts_with(x, '{g}') THEN {_followers(rest)}")
    return f"CASE {' '.join(branches)} ELSE x END"


GREETINGS = _greetings()
TICKET_WORDS = (
    "array_to_string(list_slice(list_filter(string_split(x, ' '), "
    f"lambda w: length(w) > 2 AND w NOT IN {sql_in(K.TICKET_STOPWORDS)}), 1, {K.MAX_TICKET_WORDS}), ' ')"
)


def truncate_sql(source: str, keep: str, col: str, out: str) -> str:
    return chain(source, keep, f"coalesce({col}, '')", TRUNCATE, STRIP, out=out)


def greetings_sql(source: str, keep: str, col: str, out: str) -> str:
    return chain(source, keep, f"lower(coalesce({col}, ''))", STRIP, GREETINGS, out=out)


def ticket_sql(source: str, keep: str, col: str, out: str = "clean_text", twitter: bool = False) -> str:
    head = [replace_all(f"@[{LETTERS}]+"), f"regexp_replace(x, '^rt[{BLANKS}]+', '', 'i')"] if twitter else []
    tail = [] if twitter else [GREETINGS]
    return chain(
        source, keep, f"coalesce({col}, '')", *head, "lower(x)", replace_all(URLS), TRUNCATE,
        replace_all("[^a-z]", " "), "trim(" + replace_all(" +", " ") + ")", *tail, TICKET_WORDS, out=out,
    )


def tweet_sql(source: str, keep: str, col: str, out: str = "clean_text") -> str:
    pieces = "string_split_regex(x, '[.!?]')"
    return chain(
        source, keep, f"coalesce({col}, '')",
        replace_all(f"@[{LETTERS}]+"), replace_all(URLS), replace_all(f"[^{LETTERS}{BLANKS}.?!]", " "),
        "lower(trim(" + replace_all(f"[{BLANKS}]+", " ") + "))",
        f"CASE WHEN len({pieces}) > 2 THEN array_to_string(list_slice({pieces}, 1, 2), '.') || '.' ELSE x END",
        replace_all("rt +"), replace_all("via +"), replace_all("https?[^ ]+"),
        "trim(" + replace_all(" +", " ") + ")", out=out,
    )


def eda_sql(source: str, keep: str, col: str, out: str = "clean_text") -> str:
    words = f"list_filter(string_split(x, ' '), lambda w: w NOT IN {sql_in(K.ENGLISH_STOPWORDS)})"
    return chain(
        source, keep, f"lower(coalesce({col}, ''))", replace_all(f"[^a-zA-Z0-9{BLANKS}]"),
        "trim(" + replace_all(f"[{BLANKS}]+", " ") + ")", f"array_to_string({words}, ' ')", out=out,
    )


def label_text_sql(source: str, keep: str, col: str, out: str = "clean_text") -> str:
    return chain(
        source, keep, f"lower(coalesce({col}, ''))", replace_all(f"http[^{BLANKS}]+"),
        replace_all("[^a-zA-Z ]", " "), replace_all(" +", " "), out=out,
    )


def query_text_sql(source: str, keep: str, col: str, out: str = "clean_text") -> str:
    return chain(
        source, keep, f"lower(coalesce({col}, ''))", replace_all(f"http[^{BLANKS}]+|www[^{BLANKS}]+"),
        replace_all(f"[^a-z0-9{BLANKS}]", " "), "trim(" + replace_all(f"[{BLANKS}]+", " ") + ")", out=out,
    )


def tokens(col: str, stopwords=()) -> str:
    """List of word tokens of two or more characters."""
    found = f"regexp_extract_all(lower(coalesce({col}, '')), '[{LETTERS}][{LETTERS}]+')"
    return f"list_filter({found}, lambda w: w NOT IN {sql_in(stopwords)})" if stopwords else found


def word_count(col: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({col}, ''), '[{BLANKS}]+'), lambda w: w <> ''))"


# --- rule engine -------------------------------------------------------------------
FENCE = "\u241f"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fenced(keyword: str) -> str:
    """Keyword with a fence at both ends of every word."""
    return re.sub(r"(\w+)", rf"{FENCE}\1{FENCE}", keyword)


def rules_values(rules: RuleBase = STARTER_RULES) -> str:
    order = {c: i for i, c in enumerate(rules.categories)}
    rows = [
        f"({order[r.category]}, '{r.category}', {_literal(r.keyword)}, {_literal(fenced(r.keyword))}, {r.points}, {r.word_points})"
        for r in rules.rules
    ]
    return (
        "SELECT * FROM (VALUES " + ", ".join(rows)
        + ") AS r(category_order, category, keyword, whole_keyword, points, word_points)"
    )


def phrases_values(rules: RuleBase = STARTER_RULES) -> str:
    rows = [f"({i}, {_literal(p)}, '{c}')" for i, (p, c) in enumerate(rules.phrases)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS p(phrase_order, phrase, category)"


def scores_sql(source: str, key: str, col: str) -> str:
    """Long scores: every text against every rule."""
    texts = (
        f"SELECT {key}, lower({col}) AS lowered, "
        f"regexp_replace(lower({col}), '([{LETTERS}]+)', '{FENCE}\\1{FENCE}', 'g') AS fenced FROM ({source})"
    )
    return (
        f"SELECT t.{key}, r.category, r.category_order, CAST(sum(r.points + CASE WHEN contains(t.fenced, r.whole_keyword) "
        f"THEN r.word_points ELSE 0 END) AS BIGINT) AS score_x100 "
        f"FROM ({texts}) t JOIN ({rules_values()}) r ON contains(t.lowered, r.keyword) "
        f"GROUP BY t.{key}, r.category, r.category_order"
    )


def first_phrase_sql(source: str, key: str, col: str) -> str:
    return (
        f"SELECT t.{key}, arg_min(p.category, p.phrase_order) AS phrase_category FROM ({source}) t "
        f"JOIN ({phrases_values()}) p ON contains(lower(t.{col}), p.phrase) GROUP BY t.{key}"
    )


def categorize_sql(source: str, key: str, col: str, keep: str) -> str:
    """(keep..., category, confidence) for every row of source; ``keep`` is a list of t.columns."""
    return f"""
    SELECT {keep},
           CASE WHEN length(coalesce(t.{col}, '')) < 5 THEN 'General Inquiry'
                WHEN ph.phrase_category IS NOT NULL THEN ph.phrase_category
                WHEN sc.best IS NULL THEN 'General Inquiry' ELSE sc.best END AS category,
           CASE WHEN length(coalesce(t.{col}, '')) < 5 THEN 0.5::DOUBLE
                WHEN ph.phrase_category IS NOT NULL THEN 0.95::DOUBLE
                WHEN sc.best IS NULL THEN 0.5::DOUBLE
                ELSE least(sc.top::DOUBLE / sc.total::DOUBLE, 0.95::DOUBLE) END AS confidence
    FROM ({source}) t
    LEFT JOIN ({first_phrase_sql(source, key, col)}) ph ON ph.{key} = t.{key}
    LEFT JOIN (SELECT {key}, max(score_x100) AS top, sum(score_x100) AS total,
                      arg_min(category, (-score_x100) * 100 + category_order) AS best
               FROM ({scores_sql(source, key, col)}) GROUP BY {key}) sc ON sc.{key} = t.{key}
    """
