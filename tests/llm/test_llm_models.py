"""Classifiers by held-out accuracy, and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ticketloom.llm import quality_net, toxicity

SF = "/root/testdata/sf0.01"


def graded(spark, score, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def auc(found):
    good, bad = [s for s, _, y in found if y], [s for s, _, y in found if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_net_on_held_out_rows(spark):
    found = graded(spark, quality_net.score_quality, "quality")
    assert auc(found) > 0.9 and sum(p == y for _, p, y in found) / len(found) > 0.9


def test_toxicity_on_held_out_rows(spark):
    found = graded(spark, toxicity.score_toxicity, "toxic")
    assert auc(found) > 0.85 and sum(p == y for _, p, y in found) / len(found) > 0.9


def plain_differences(labelled, texts):
    """The same by dictionaries of words: per text, the summed difference and that of its strongest words."""
    words_of = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    stem = lambda w: w.encode()[: toxicity.STEM]
    d, everywhere, stems_everywhere = toxicity.discount, Counter(), Counter()
    for t in texts:
        everywhere.update(words_of(t))
        stems_everywhere.update(map(stem, words_of(t)))
    total, models = sum(everywhere.values()), []
    rest = lambda t, n: sum(map(d, t.values())) / n if t else 1
    for k in (0, 1):
        pairs = Counter(p for t, label in labelled if label == k for p in zip([None, *words_of(t)], words_of(t), strict=False))
        seen, lost, types, stem_types = Counter(), Counter(), Counter(), Counter()
        for (v, w), n in pairs.items():
            seen[v] += n
            lost[v] += d(n)
            types[w] += 1
            stem_types[stem(w)] += 1
        n = max(len(pairs), 1)
        models.append((pairs, seen, lost, types, stem_types, n, rest(types, n), rest(stem_types, n)))

    def probability(k, v, w):
        pairs, seen, lost, types, stem_types, n, word_rest, stem_rest = models[k]
        own = lambda count: count - d(count)
        p = own(stem_types[stem(w)]) / n + stem_rest * stems_everywhere[stem(w)] / total
        p = own(types[w]) / n + word_rest * p * everywhere[w] / stems_everywhere[stem(w)]
        return own(pairs[v, w]) / seen[v] + lost[v] / seen[v] * p if seen[v] else p

    found = []
    for t in texts:
        terms = [math.log(probability(1, v, w) / probability(0, v, w)) for v, w in zip([None, *words_of(t)], words_of(t), strict=False)]
        found.append((len(terms), sum(terms), sum(sorted(terms)[-toxicity.STRONGEST :])))
    return found


def test_toxicity_differences_equal_plain_models(spark, texts):
    some = defaultdict(list)
    for k, t in sorted(texts.items()):
        some[k % 3].append(t or "")
    own = ["", "Zwölf ZWÖLF zwölfte", "a", "a a a b a", "only here onlyhere", *some[0][:40], *some[1][:40]]
    labelled = [(t, k % 2) for k, t in enumerate([*some[1][:40], "a b a", "", "zwölf a"])]
    assert {t for t, _ in labelled} - set(own) == {"a b a", "zwölf a"}
    every = [*own, "a b a", "zwölf a"]
    rows = spark.createDataFrame(labelled, "text string, label int").repartition(3)
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
    models = spark.sparkContext.broadcast(toxicity.models_of(rows, docs.select("text")))
    got = toxicity.with_features(docs, models, {"doc_id": "long"}).orderBy("doc_id").collect()
    for r, (n, difference, strongest) in zip(got, plain_differences(labelled, every), strict=True):
        assert r.words == n and r.difference == pytest.approx(difference, abs=1e-9, rel=1e-9)
        assert r.strongest == pytest.approx(strongest, abs=1e-9)


@pytest.mark.parametrize("score", [quality_net.score_quality, toxicity.score_toxicity])
def test_classifier_edges(spark, edge_docs, no_docs, score):
    label = "quality" if score is quality_net.score_quality else "toxic"
    schema = f"doc_id long, {label} int"
    some = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 1), (8, None), (None, 1)], schema)
    assert score(edge_docs, some).count() == 12 and score(no_docs, some).collect() == []
    assert all(0 <= r.score <= 1 for r in score(edge_docs, some.limit(0)).collect())


def test_network_equals_plain_convolution():
    rng, net = np.random.default_rng(1), quality_net.Network.fresh(3)
    net.bias[:] = rng.normal(0, 0.5, quality_net.FILTERS)
    net.shift = 0.25
    texts = [b"", b"abc", rng.integers(0, 256, 700, np.uint8).tobytes(), rng.integers(0, 256, 40000, np.uint8).tobytes()]
    cuts = [quality_net.chunks_of(t) for t in texts]
    got = net.scores(np.concatenate(cuts), np.cumsum([0, *map(len, cuts)]))
    for text, value in zip(texts, got, strict=True):
        answers = []
        for at in range(0, max(1, len(text) - (quality_net.CHUNK - quality_net.STEP)), quality_net.STEP):
            chunk = text[at : at + quality_net.CHUNK].ljust(quality_net.CHUNK, b"\0")
            places = range(0, quality_net.CHUNK - quality_net.WIDTH + 1, quality_net.STRIDE)
            every = [sum(net.filters[k][chunk[i + k]].astype(float) for k in range(quality_net.WIDTH)) for i in places]
            answers.append(np.maximum(np.max(every, 0) + net.bias, 0))
        logit = np.concatenate([np.mean(answers, 0), np.max(answers, 0)]) @ net.weights + net.shift
        assert value == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


def test_quality_net_learns_from_whole_texts(spark):
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5][:12]
    texts = {i: "x" * 20000 * (k % 3) + f"end {i}" for k, i in enumerate(ids)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    cuts, marks = quality_net.training_rows(docs, labels, "quality", 4, "doc_id", "text")
    assert len(cuts) == 8 and sorted(marks.tolist()) == [0] * 4 + [1] * 4
    whole = {quality_net.chunks_of(t.encode()).tobytes() for t in texts.values()}
    assert {c.tobytes() for c in cuts} <= whole


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        values = rng.integers(-(1 << 63), 1 << 63, n, np.int64)
        assert (toxicity.unpacked(toxicity.packed(values)) == values).all()
    parts = [np.arange(3, dtype=np.uint8), np.zeros(0, np.uint8), np.array([700], np.uint16)]
    assert toxicity.joined(parts).tolist() == [0, 1, 2, 700]


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(k % 251 + 1 for k in range(n))
        chunks = quality_net.chunks_of(data)
        back = b"".join(c.tobytes()[: quality_net.STEP] for c in chunks[:-1]) + chunks[-1].tobytes()
        assert back.rstrip(b"\0") == data


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= rows, name
        rows = left


def test_pipeline_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.round_trip and r.n_pieces > 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
