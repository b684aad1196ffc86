"""Quality rules as a short-circuit cascade.

A sample gives each rule's cost and the documents it rejects.  Rules are put
in the order of rejection per cost, each judged on what the rules before it
let through, and become one conditional expression: a rule runs only on
documents that passed all earlier ones.  The order never changes the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import SPACES, let, store, text_of, words_of

# Documents of the sample that estimates costs and rejections.
SAMPLE_DOCS = 2000


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that occur twice or more in the text, first ones included."""

    def covered(windows: Column) -> Column:
        twice = F.filter(
            windows,
            lambda x, k: F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False))
            | ((k > 0) & (F.get(windows, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])),
        )
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def counted(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i")),
        )
        return F.when(F.size(w) >= width, let(F.sort_array(windows), covered)).otherwise(F.lit(0))

    return let(words, counted)


def left_of(text: Column, pattern: str) -> Column:
    """Code points that remain when a pattern is deleted."""
    return F.char_length(F.regexp_replace(text, pattern, ""))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


# What rules look at, by name; each takes the text (never null).
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words_of(t)),
    "word_chars": lambda t: left_of(t, SPACES),
    "n_symbols": lambda t: left_of(t, r"[^#*$%&|<>]+"),
    "n_dup_lines": lambda t: let(worded_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda t: repeated_window_words(words_of(t)),
    "n_lines": lambda t: F.size(worded_lines(t)),
    "n_capitals": lambda t: left_of(t, r"[^A-Z]+"),
    "n_marks": lambda t: left_of(t, r"[^!?]+"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document; `rejects` gets a function from a measure's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("capitals", lambda m: 100 * m("n_capitals") > 50 * m("word_chars")),
    Rule("marks", lambda m: 2 * m("n_marks") > m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
)


def estimate(sample: DataFrame, rejections: dict[str, Column]) -> list[str]:
    """Rule names in the order of rejection per cost, from a stored sample."""
    costs = {}
    for name, rejects in rejections.items():
        began = time.perf_counter()
        sample.agg(F.sum(rejects.cast("int"))).collect()
        costs[name] = time.perf_counter() - began
    verdicts = [r.cast("boolean").alias(f"rule_{k}") for k, r in enumerate(rejections.values())]
    # At most one row per document of the bounded sample.
    seen = [(r[:-1], r[-1]) for r in sample.select(*verdicts).groupBy(*[f"rule_{k}" for k in range(len(verdicts))]).count().collect()]
    names, order = list(rejections), []
    while len(order) < len(names):
        def gain(name: str) -> float:
            return sum(n for v, n in seen if v[names.index(name)]) / max(costs[name], 1e-6)

        best = max((x for x in names if x not in order), key=lambda x: (gain(x), -costs[x]))
        order.append(best)
        seen = [(v, n) for v, n in seen if not v[names.index(best)]]
    return order


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), text: str = "text",
            verdict: str = "kept", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """`docs` with the measures named in `report` and the boolean `verdict`, false where any rule rejects.

    Null texts count as empty.  An input column with the name of an output
    column is replaced.  Without rules, or without rows, nothing is rejected.
    The sample takes about `sample_docs` rows from all of `docs`.
    """
    lean = docs.select(text_of(text).alias("text"))
    rows = docs.count()
    share = min(1.0, sample_docs / max(rows, 1))
    sample = store(lean.sample(share, seed=7), "rule-sample")
    direct = lambda name: MEASURES[name](F.col("text"))
    order = estimate(sample, {r.name: F.coalesce(r.rejects(direct), F.lit(False)) for r in rules}) if rules else []
    measured = docs.withColumns({m: MEASURES[m](text_of(text)).cast("long") for m in report}) if report else docs
    known = lambda name: F.col(name) if name in report else MEASURES[name](text_of(text))
    by_name = {r.name: r for r in rules}
    passes = F.lit(True)
    for name in reversed(order):
        passes = F.when(F.coalesce(by_name[name].rejects(known), F.lit(False)), F.lit(False)).otherwise(passes)
    return measured.withColumn(verdict, passes)


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    verdict = "rules_verdict" + "_" * max([0, *(len(c) for c in docs.columns)])
    return cascade(docs, rules, (), text, verdict).where(F.col(verdict)).select(*docs.columns)
