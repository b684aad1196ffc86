"""The whole job where a shorter one looked the same: notices beside others, ids in order and decoded."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ticketloom.llm import licenses, sentencepieces


def notices_of(text):
    """Every template at every offset, by its key phrases and its share."""
    words = [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]
    index, found = licenses.Index(licenses.TEMPLATES), {}
    for t, template in enumerate(licenses.TEMPLATES):
        posts, keys = [(k, w) for u, k, w in index.postings if u == t], index.keys(template)
        for offset in range(-len(template.words.split()), len(words)):
            stands = lambda k, w: 0 <= offset + k < len(words) and words[offset + k] == w  # noqa: B023, E731
            share = sum(stands(*p) for p in posts) / len(posts)
            if all(stands(*p) for p in keys) and share >= licenses.SHARE:
                found[template.label] = max(share, found.get(template.label, 0))
    base = {label for phrase, label in licenses.BASE_PHRASES.items() if f" {phrase} " in f" {' '.join(words)} "}
    return ",".join(sorted({*found, *base})), max([0.0, 0.5 if base else 0.0, *found.values()])


def test_a_notice_is_found_beside_others_and_in_a_long_text(spark):
    rng = random.Random(4)
    whole = [t.words for t in licenses.TEMPLATES]
    vocabulary = licenses.Index(licenses.TEMPLATES).vocabulary
    bsd, apache = (next(t.words for t in licenses.TEMPLATES if t.label == k) for k in ("bsd", "apache-2.0"))
    # The words of the short notices are the frequent ones here, those of the others the rare ones.
    texts = [f"licensed under the apache license version 2 0 and released under the mit license, file {k}" for k in range(40)]
    texts += [f"{bsd}. {apache}", f"{apache} xx {bsd}", " ".join(whole), " x ".join(reversed(whole))]
    texts += [" ".join(rng.choices(vocabulary, k=400)) + f" {w} " + " ".join(rng.choices(vocabulary, k=400)) for w in whole]
    # Notices with words left out, some below the share or without a key word.
    texts += [" ".join(w for w in " ".join(rng.sample(whole, 3)).split() if rng.random() > 0.1) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(rows).collect()}
    assert got == dict(enumerate(map(notices_of, texts)))
    assert "apache-2.0" in got[40][0] and "bsd" in got[40][0]


def test_the_digest_is_of_the_ids_in_order_and_of_their_text(spark, edge_rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    table, lib = sentencepieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "the cat sat on the mat"), (2, "on the mat sat the cat"), (3, "a\u2581b"), (1, "the cat sat on the mat"), (4, "x" * 90 + " 日本語 😀")]
    rows += [(r[0], r[1]) for r in edge_rows]
    ids = [(d, t, lib.encode(t or "")) for d, t in rows]
    wanted = spark.createDataFrame([(d, i, lib.decode(i) == (t or "")) for d, t, i in ids], "doc_id long, ids array<int>, round_trip boolean")
    hashed = F.when(F.size("ids") > 0, F.xxhash64("ids")).otherwise(0)
    wanted = Counter(map(tuple, wanted.select("doc_id", F.size("ids"), hashed, "round_trip").collect()))
    for frequent in (4, 1 << 23):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        digest = sentencepieces.encoding_digest(docs, table, frequent=frequent)
        assert Counter(map(tuple, digest.select("doc_id", "n_pieces", "pieces_hash", "round_trip").collect())) == wanted


def test_the_helper_finds_what_the_lattice_finds(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    bpe = sentencepieces.Pieces.load(path)
    assert sentencepieces.unit_pattern(bpe).count("|") == 3
    rng = random.Random(5)
    letters = ["a", "b", "c"]
    made = {"".join(rng.choice(letters) for _ in range(n)) for n in (2, 3, 4) for _ in range(6)} | {"\u2581a", "\u2581", *letters}
    unigram = sentencepieces.Pieces(tuple((i + 1, p, -rng.random() * 5) for i, p in enumerate(sorted(made))), None, len(made) + 1, "unigram")
    words = {"\u2581" + "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(0, 25))) for _ in range(150)}
    for table in (bpe, unigram):
        fold = sentencepieces.helper(table)
        got = sentencepieces.folded_units(spark.createDataFrame([(u, 1) for u in words], "unit string, times long"), table).collect()
        assert len(got) == len(words) and all(np.array(r.ids, "<i4").tobytes() == fold(r.unit) for r in got)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    longer = "".join(rng.choice("abcdehinorst") for _ in range(500))
    assert np.frombuffer(sentencepieces.helper(bpe)("\u2581" + longer), "<i4").tolist() == lib.encode(longer)


def test_pipeline_takes_edges_and_an_empty_table(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").count() <= 12, name
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, "")
            assert left.columns == docs.columns, name
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, left, "").collect()} <= {r[0] for r in docs.select("doc_id").collect()}


def test_a_stage_deletes_what_earlier_ones_stored(spark, documents, tmp_path):
    docs, before = documents, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, "")
        assert not any(p in corpus_pipeline.EARLIER for p in before)
        docs.write.parquet(str(tmp_path / str(k)))
        before = list(corpus_pipeline.EARLIER)
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0
