"""License scans through a positional index of rare words, with DataFrame operations only.

Of every file only the words of the license vocabulary are kept, with their
positions.  Of every template whose key words the file holds, the rarest ones
over the whole corpus are looked up in the index; postings that agree on the
offset between file and template vote for that place, and a template counts
where its mandatory key phrases stand at exactly that offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import let, numbered, text_of

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that must be found wherever their words stand in a row, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A notice by its words, and the phrases of it that must be there; neither has stop words in its phrases."""

    label: str
    words: str
    phrases: tuple[str, ...]


# Wording of public license notices.
TEMPLATES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-notice", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission", "hereby granted free", "person obtaining")),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution", "binary forms", "permitted provided")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("without fee", "hereby granted")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
)
STOP_WORDS = frozenset("a and any are as by can for form in is it of or that the this to use with you 0 1 2 3 4 v".split())

# How much of a template must stand at its place.
SHARE = 0.6


class Index:
    """Postings of the templates' words, and the vocabulary that is kept of every file."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = templates
        self.postings = [(t, k, w) for t, x in enumerate(templates) for k, w in enumerate(x.words.split()) if w not in STOP_WORDS]
        phrase_words = {w for x in templates for p in x.phrases for w in p.split()}
        self.lookup = sorted({w for _, _, w in self.postings})
        self.vocabulary = sorted({*self.lookup, *phrase_words, *(w for p in BASE_PHRASES for w in p.split())})

    def key_words(self, t: int) -> list[str]:
        """The words of a template's key phrases that are looked up; a file without one of them holds it nowhere."""
        return sorted({w for p in self.templates[t].phrases for w in p.split()} - STOP_WORDS)

    def anchors(self, t: int, frequency: Mapping[str, int]) -> list[str]:
        """Words of a template of which two vote wherever it stands: its two rarest key words, or all its words where it has fewer."""
        keys = sorted(self.key_words(t), key=lambda w: (frequency.get(w, 0), w))
        return keys[:2] if len(keys) > 1 else sorted({w for u, _, w in self.postings if u == t})

    def keys(self, template: Template) -> list[tuple[int, str]]:
        """(place, word) of the key phrases, at their first place in the template."""
        words, found = template.words.split(), []
        for phrase in template.phrases:
            p = phrase.split()
            at = next(k for k in range(len(words)) if words[k : k + len(p)] == p)
            found += [(at + j, w) for j, w in enumerate(p)]
        return sorted(set(found))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, as far as ASCII words go: the one other character that lower() maps to ASCII is the Kelvin sign."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("Å")))


def literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def phrase_places(tokens: Column, phrase: str) -> Column:
    """Start positions of a phrase among tokens sorted by position that hold all its words."""
    words = phrase.split()

    def here(t: Column, k: Column) -> Column:
        test = t["word"] == words[0]
        for j, w in enumerate(words[1:], 1):
            after = F.get(tokens, k + j)
            test = test & F.coalesce((after["word"] == w) & (after["pos"] == t["pos"] + j), F.lit(False))
        return test

    return F.transform(F.filter(tokens, here), lambda t: t["pos"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Null and empty texts have no words and no labels ('' and score 0).  The
    score is the best found template's share that stands at its place, at
    least one half where a base phrase stands.  Repeated rows and null ids are
    scanned one by one; other columns are not read.
    """
    index = Index(templates)

    def kept(words: Column) -> Column:
        def tokens(met: Column) -> Column:
            own = F.filter(
                F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda t: F.array_contains(met, t["word"])
            )
            return F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.size(met) > 0, own).otherwise(F.slice(own, 1, 0)).alias("tokens"))

        return let(F.array_intersect(words, literals(index.vocabulary)), tokens)

    words = F.filter(F.split(lower_ascii(text_of(text)), WORD_GAP), lambda w: w != "")
    files = numbered(docs, "license-words", doc_id=F.col(doc_id), found=let(words, kept))
    files = files.select("row", "doc_id", "found.n_words", "found.tokens")

    # Document frequencies of the license words over the whole corpus: as many rows as the index has words.
    present = files.where(F.size("tokens") > 0).select(F.explode(F.array_distinct(F.transform("tokens", lambda t: t["word"]))).alias("word"))
    frequency = {r["word"]: r["count"] for r in present.groupBy("word").count().collect()}
    anchors = [index.anchors(t, frequency) for t in range(len(templates))]

    spark = docs.sparkSession
    # As many rows as the templates have words.
    anchored = [(t, k, w) for t, k, w in index.postings if w in anchors[t]]
    postings = F.broadcast(spark.createDataFrame(anchored, "template int, place int, word string"))
    notices = F.broadcast(
        spark.createDataFrame(
            [
                (t, x.label, [(k, w) for u, k, w in index.postings if u == t], index.keys(x))
                for t, x in enumerate(templates)
            ],
            "template int, label string, posts array<struct<place:int,word:string>>, keys array<struct<place:int,word:string>>",
        )
    )
    distinct = F.array_distinct(F.transform("tokens", lambda t: t["word"]))

    def rare(own: Column) -> Column:
        """The anchors of every template whose key words are all there, however many templates these are."""
        none = F.array().cast("array<string>")
        held = [F.size(F.array_except(literals(index.key_words(t)), own)) == 0 for t in range(len(templates))]
        return F.array_distinct(F.flatten(F.array(*[F.when(h, literals(anchors[t])).otherwise(none) for t, h in enumerate(held)])))

    looked_up = files.where(F.size("tokens") > 1).withColumn("rare", let(distinct, rare))
    # One word alone never places a template: two different words must agree on the offset.
    hits = looked_up.where(F.size("rare") > 1).select(
        "row", F.explode(F.filter("tokens", lambda t: F.array_contains(F.col("rare"), t["word"]))).alias("t")
    )
    votes = hits.select("row", "t.pos", "t.word").join(postings, "word")
    places = votes.groupBy("row", "template", (F.col("pos") - F.col("place")).alias("offset")).agg(F.count_distinct("word").alias("votes"))
    stands = lambda p: F.array_contains("tokens", F.struct((F.col("offset") + p["place"]).alias("pos"), p["word"].alias("word")))
    checked = places.where("votes > 1").join(files.select("row", "tokens"), "row").join(notices, "template")
    checked = checked.where(F.forall("keys", stands))
    checked = checked.withColumn("share", F.size(F.filter("posts", stands)) / F.size("posts")).where(F.col("share") >= SHARE)
    found = checked.groupBy("row").agg(F.collect_set("label").alias("own_labels"), F.max("share").alias("share"))

    places_of = {label: phrase_places(F.col("tokens"), phrase) for phrase, label in BASE_PHRASES.items()}
    # A lone token has no phrase; most files stop here.
    based = files.withColumns({f"at_{k}": p for k, p in enumerate(places_of.values())})
    every = F.flatten(F.array(*[F.col(f"at_{k}") for k in range(len(places_of))]))
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(places_of)]))
    based = based.select("row", "doc_id", "n_words", every.alias("places"), F.array_sort(F.array_distinct(base)).alias("base"))
    none = F.array().cast("array<string>")
    return based.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own_labels", none))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
