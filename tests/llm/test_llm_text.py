"""Token counts, SentencePiece, license scan, mixing and quality rules against libraries and plain Python."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketloom.llm import licenses, mixing, quality_rules, sentencepieces, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")


def encode_counts(texts):
    return [len(e) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(documents, texts):
    got = {r.doc_id: r for r in token_counts.token_counts(documents, BPE).collect()}
    assert [got[i].n_tokens for i in texts] == encode_counts(list(texts.values()))
    assert all(r.over_limit == (r.n_tokens > 1024) and r.n_bytes == len(texts[i].encode()) for i, r in got.items())


def test_spliced_counts_equal_whole_ones():
    rng = random.Random(1)
    words = ["the", "cat's", "1234", "<|endoftext|>", "😀", "\n\n", "  ", "\t", "naïve", "x" * 50, "!!!", "日本語"]
    for chunk, overlap in ((64, 8), (100, 40), (37, 1)):
        for _ in range(30):
            text = "".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 200)))
            assert token_counts.counts_of([text], BPE, chunk, overlap) == encode_counts([text])
    solid = "abcdefgh" * 500
    assert token_counts.counts_of([solid], BPE, 64, 8) == encode_counts([solid])


class Counting:
    """A tokenizer that notes how many bytes it is given at once."""

    def __init__(self, inner):
        self.inner, self.sizes = inner, []

    def encode_batch_fast(self, texts, **options):
        self.sizes.append(sum(len(t.encode()) for t in texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_equal_units_are_encoded_once_in_bounded_groups(monkeypatch):
    rng, whole = random.Random(5), Tokenizer.from_file(BPE)
    odd = ["\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "\x1c", "\x1f", "\x0b", "\r\n", " ", "  ", " \t "]
    words = ["the", "cat's", "don't", "x'll.", "1,234.5", "<|endoftext|>", "a<|endoftext|>.", "😀", "Ünï", "été,", "日本語。", "(b)!", '"c"?!', "'s", ""]
    mixed = ["".join(rng.choice(words) + rng.choice([*odd, ""]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    plain = [" ".join(rng.choice(["alpha", "beta,", "gamma.", "delta"]) for _ in range(200)) for _ in range(200)]
    rare = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(50)) for _ in range(20)]
    monkeypatch.setattr(token_counts, "ENCODED", 4096, raising=False)
    for texts, most in ((plain, 100), (mixed, None), (rare, None)):
        lib = Counting(whole)
        monkeypatch.setitem(token_counts._LOADED, BPE, lib)
        assert token_counts.counts_of(texts, BPE) == encode_counts(texts)
        # Texts whose units hardly repeat are encoded whole.
        assert sum(lib.sizes) <= (most or sum(len(t.encode()) for t in texts)) and max(lib.sizes) <= 4096
    monkeypatch.setattr(token_counts, "REPEATS", 0)
    monkeypatch.setitem(token_counts._LOADED, BPE, whole)
    for texts in ([], [""], ["", "a", ""], [" "], ["\xa0  x"], ["a\xa0", "  x"], mixed, rare):
        want = encode_counts(texts)
        assert token_counts.count_by_units(whole, texts) == want
        assert [token_counts.count_by_units(whole, [t]) for t in texts] == [[n] for n in want]
        assert token_counts.counts_of(texts, BPE, 16, 4) == want


def test_slices_hold_every_row_once():
    rng = random.Random(6)
    for sizes in ([], [0], [9], [0, 0, 9, 0], [rng.randint(0, 8) for _ in range(300)]):
        cut = list(token_counts.slices(np.array(sizes, np.int64), 7))
        assert [i for at, n in cut for i in range(at, at + n)] == list(range(len(sizes)))
        assert all(n == 1 or sum(sizes[at : at + n]) <= 7 for at, n in cut)


def test_token_count_edges(edge_docs, edge_rows, no_docs):
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(edge_docs, BPE).collect())
    assert got == Counter((r[0], n) for r, n in zip(edge_rows, encode_counts([r[1] or "" for r in edge_rows]), strict=True))
    assert token_counts.token_counts(no_docs, BPE).collect() == []


def test_pieces_equal_the_library(spark, edge_docs, edge_rows, no_docs):
    table, lib = sentencepieces.Pieces.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcde hinotrs éü\n日①") for _ in range(rng.randint(1, 300)))) for i in range(40)]
    rows += [(90, "  a  b\nc\td "), (91, " " * 70 + "x"), (92, "ab" * 90), (93, "<0x0A> <s> </s>")]
    got = {r.doc_id: r for r in sentencepieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert all(got[i].ids == lib.encode(t) and got[i].text == t for i, t in rows)
    edges = sentencepieces.encode_documents(edge_docs, table).collect()
    assert Counter((r.doc_id, tuple(r.ids or ())) for r in edges) == Counter((r[0], tuple(lib.encode(r[1] or ""))) for r in edge_rows)
    digest = sentencepieces.encoding_digest(edge_docs, table).collect()
    assert Counter((r.doc_id, r.n_pieces) for r in digest) == Counter((r[0], len(lib.encode(r[1] or ""))) for r in edge_rows)
    assert all(r.round_trip for r in digest) and sentencepieces.encoding_digest(no_docs, table).collect() == []


def test_the_bound_of_broadcast_units_leaves_the_rows(documents):
    table = sentencepieces.Pieces.load(PIECES)
    few, many = ([*map(tuple, sentencepieces.encoding_digest(documents, table, frequent=n).collect())] for n in (256, 1 << 23))
    assert sorted(few) == sorted(many) and few


def test_viterbi_equals_all_segmentations(spark):
    rng = random.Random(4)
    letters = ["▁", "a", "b", "c"]
    pieces = {"".join(rng.choice(letters[1:]) for _ in range(n)) for n in (1, 2, 3) for _ in range(6)} | {"▁a", "▁", "a", "b", "c"}
    table = sentencepieces.Pieces(tuple((i + 1, p, -rng.random() * 5) for i, p in enumerate(sorted(pieces))), None, len(pieces) + 1, "unigram")
    score = {p: s for _, p, s in table.rows}
    units = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(20)]
    got = sentencepieces.folded_units(spark.createDataFrame([(u, 1) for u in set(units)], "unit string, times long"), table).collect()
    for r in got:
        cuts = [c for k in range(len(r.unit)) for c in itertools.combinations(range(1, len(r.unit)), k)]
        parts = [[r.unit[a:b] for a, b in zip((0, *c), (*c, len(r.unit)), strict=True)] for c in cuts]
        best = max(sum(score[p] for p in x) for x in parts if all(p in score for p in x))
        by_id = {i: p for i, p, _ in table.rows}
        assert "".join(by_id[i] for i in r.ids) == r.unit and abs(sum(score[by_id[i]] for i in r.ids) - best) < 1e-9


def base_of(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark, documents, texts, edge_docs, edge_rows, no_docs):
    found = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
    got = {r.doc_id: r for r in licenses.scan_licenses(documents).collect()}
    assert all(found(got[i]) == base_of(t) for i, t in texts.items())
    edges = licenses.scan_licenses(edge_docs).collect()
    assert Counter((r.doc_id, found(r)) for r in edges) == Counter((r[0], base_of(r[1])) for r in edge_rows)
    assert licenses.scan_licenses(no_docs).collect() == []
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"
    rows = [(1, "x " * 30 + grant), (2, "hereby granted free permission person obtaining"), (3, "Licensed under CC BY-NC 4.0."), (4, "by by license")]
    labels = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert labels == {1: "mit-grant", 2: "", 3: "cc-by,cc-by-nc", 4: ""}


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        want = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if want[s] > most * sizes[s] + 1e-9}
        if not over:
            return want | {s: most * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("which", ["documents", "edge_docs"])
def test_mixture_meets_its_targets(which, request):
    docs = request.getfixturevalue(which)
    source = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = Counter()
    for _, s, n in source:
        sizes[s] += n
    want = targets(sizes)
    got = mixing.mixture(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, n, sizes[s]) for i, s, n in source)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[round(r.target, 6), r.source_size] += r.taken
    groups = Counter((round(want[s], 6), sizes[s]) for s in sizes)
    assert all(abs(taken[k] - k[0] * n) <= n for k, n in groups.items())
    again = mixing.mixture(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    lengths = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in mixed.select("doc_id", "text").collect())
    assert lengths == Counter((r.doc_id, r.taken) for r in got if r.taken or not r.size)


def test_shards_hold_what_the_mix_takes(spark, documents, edge_docs, no_docs):
    for docs in (documents, edge_docs):
        texts = Counter((r.doc_id, r.source, " ".join(WORD.findall(r.text or ""))) for r in docs.select("doc_id", "source", "text").collect())
        got = mixing.mixture(docs).collect()
        pieces = mixing.mixed_shards(docs).collect()
        taken, shards = Counter(), {}
        for r in pieces:
            assert r.words == len(r.text.split()) > 0 and any(r.text in t for d, s, t in texts if (d, s) == (r.doc_id, r.source))
            taken[r.doc_id] += r.words
            shards.setdefault(r.doc_id, set()).add(r.shard)
        want = Counter()
        for r in got:
            want[r.doc_id] += r.taken
        assert taken == +want
        ids = Counter(r.doc_id for r in got)
        assert all(r.n_shards == len(shards.get(r.doc_id, ())) for r in got if ids[r.doc_id] == 1)
        # A block that a pass visits is in one shard, whole.
        placed = {}
        for r in pieces:
            placed.setdefault((r.source, r["pass"], r.block), set()).add(r.shard)
        assert all(len(s) == 1 for s in placed.values())
        if docs is documents:
            # Slots fall into 64 shards evenly, as a multinomial draw does: chi-square of 63 degrees of freedom.
            n = Counter(next(iter(s)) for s in placed.values())
            even = len(placed) / 64
            assert sum((n[k] - even) ** 2 / even for k in range(64)) < 110
            by_source = Counter((next(iter(s)), k[0]) for k, s in placed.items())
            assert len(by_source) > 500
    assert mixing.mixed_shards(no_docs).collect() == []


def test_mixture_of_nothing_and_permutation(spark, no_docs):
    assert mixing.mixture(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
    for n in (1, 2, 3, 10, 97, 1000):
        size = F.lit(n).cast("long")
        there = mixing.permuted(F.col("id"), size, F.lit(9).cast("long"))
        rows = spark.range(n).select(there.alias("y"), mixing.permuted(there, size, F.lit(9).cast("long"), True).alias("z"), "id").collect()
        assert sorted(r.y for r in rows) == list(range(n)) and all(r.z == r.id for r in rows)


def test_rule_order_never_changes_the_verdict(edge_docs, no_docs, documents):
    rules = quality_rules.RULES
    kept = [sorted(str(r.doc_id) for r in quality_rules.quality_filter(documents, x).collect()) for x in (rules, rules[::-1])]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < documents.count()
    out = quality_rules.quality_filter(edge_docs)
    assert out.columns == edge_docs.columns and sorted(r.doc_id for r in out.collect()) == []
    assert quality_rules.cascade(edge_docs, rules=()).where("kept").count() == 12
    assert quality_rules.cascade(no_docs).collect() == []


def test_rules_go_by_rejection_per_cost(spark):
    sample = spark.range(100).select(F.col("id"))
    order = quality_rules.estimate(sample, {"none": F.col("id") < 0, "most": F.col("id") < 90, "same": F.col("id") < 89})
    assert order[0] in ("most", "same") and set(order) == {"none", "most", "same"}
