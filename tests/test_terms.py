"""Vocabularies from summaries, the inverted index, naive Bayes as tables and the neighbour index, against plain forms."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketloom.operators import features as X
from ticketloom.operators import terms as R
from ticketloom.operators import vectors as V
from ticketloom.operators.neighbours import NeighbourIndex, recall


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))), "abc"[i % 3]) for i in range(300)]
    return [*rows, (300, None, "a"), (301, "", "b"), (302, "w1 " * 500 + "only", None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, label string").repartition(6).cache()


def expected_vocabulary(texts, most, least, share):
    cf, df = Counter(), Counter()
    for _, t, _ in texts:
        w = (t or "").split()
        cf.update(w)
        df.update(set(w))
    kept = [(t, df[t], n) for t, n in cf.items() if least <= df[t] <= len(texts) * share]
    return sorted(kept, key=lambda x: (-x[2], x[0]))[:most]


@pytest.mark.parametrize("summary", [1 << 17, 60, 5])
@pytest.mark.parametrize("most,least,share", [(10, 1, 1.0), (10, 2, 0.3), (120, 2, 0.8), (5000, 1, 1.0)])
def test_vocabulary_is_exact_whatever_the_summary_holds(docs, texts, summary, most, least, share, monkeypatch):
    monkeypatch.setattr(R, "SPARE_TERMS", 5)
    got = R.vocabulary(R.term_lists(docs, "text"), most, least, share, summary_terms=summary).collect()
    assert sorted(((r.term, r.df, r.cf) for r in got), key=lambda x: (-x[2], x[0])) == expected_vocabulary(texts, most, least, share)


def test_summaries_bound_every_count(docs, texts):
    found = {r.term: r.n for r in R.term_summary(R.term_lists(docs, "text"), 30).collect()}
    error, true = found.pop(None), Counter(w for _, t, _ in texts for w in (t or "").split())
    assert error > 0 and all(found.get(t, 0) <= n <= found.get(t, 0) + error for t, n in true.items())


@pytest.mark.parametrize("k,first", [(1, 1), (3, 2), (10, 3), (500, 3)])
def test_top_k_equals_all_products(docs, k, first):
    weights = X.tfidf(docs, "doc_id", "text", 300, 1, 1.0, stopwords=()).cache()
    own = defaultdict(dict)
    for r in weights.collect():
        own[r.doc_id][r.term] = r.weight
    queries = weights.filter("doc_id % 7 = 0").withColumnRenamed("doc_id", "qid")
    got = R.TermIndex.build(weights, "doc_id").top_k(queries, "qid", k, first, exclude_self=True).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r.qid].append((r.id, r.score))
    for q in [d for d in own if d % 7 == 0]:
        all_ = [(d, round(sum(w * v.get(t, 0) for t, w in own[q].items()), 6)) for d, v in own.items() if d != q and own[q].keys() & v.keys()]
        want = sorted(all_, key=lambda x: (-x[1], x[0]))[:k]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want], abs=2e-6) and len({d for d, _ in found[q]}) == len(want)


def test_top_k_skips_postings_that_cannot_matter(spark):
    rows = [(i, "common", 0.1) for i in range(500)] + [(i, f"rare{i % 5}", 0.99) for i in range(20)]
    index = R.TermIndex.build(spark.createDataFrame(rows, "id long, term string, weight double"), "id")
    query = spark.createDataFrame([(1, "common", 0.5), (1, "rare0", 0.8), (2, "absent", 1.0)], "qid long, term string, weight double")
    got = index.top_k(query, "qid", 4, first_terms=1).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in got] == [(1, 0), (1, 5), (1, 10), (1, 15)] and got[0].score == round(0.05 + 0.792, 6)


def test_naive_bayes_tables_equal_mllib(docs):
    rows = docs.filter("label IS NOT NULL AND text IS NOT NULL")
    lists = R.term_lists(rows, "text", keep=["doc_id", "label"])
    idf = R.idf_of(R.vocabulary(lists, 200, 1, 1.0), rows.count())
    weights = R.term_weights(lists, "doc_id", idf, ["label"])
    model = R.TermBayes.fit(weights, rows.groupBy("label").agg(F.count("*").alias("n")), "label", len(idf))
    got = {(r.doc_id, r["class"]): r.score for r in model.log_scores(rows, weights, "doc_id").collect()}
    stages = X.fit_tfidf(rows, "text", max_features=200, min_df=1, max_df=1.0, stopwords=())
    indexed = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    prepared = indexed.transform(stages.transform(rows))
    fitted = NaiveBayes(featuresCol="features", labelCol="y", smoothing=1.0).fit(prepared).transform(prepared)
    for r in fitted.select("doc_id", vector_to_array("rawPrediction").alias("raw"), vector_to_array("probability").alias("p"), "prediction").collect():
        assert [got[r.doc_id, c] for c in "abc"] == pytest.approx(r.raw, abs=1e-9)
    best = {r.doc_id: (r.prediction, r.confidence) for r in model.predict(rows, weights, "doc_id").collect()}
    assert len(best) == rows.count()
    for r in fitted.select("doc_id", vector_to_array("probability").alias("p")).collect():
        assert best[r.doc_id][1] == pytest.approx(max(r.p), abs=1e-9)


def test_neighbours_on_terms(docs):
    weights = X.tfidf(docs, "doc_id", "text", 300, 1, 1.0, stopwords=())
    near = R.knn_on_terms(weights.filter("doc_id >= 100"), weights.filter("doc_id < 100"), docs, "label", "doc_id", 3).collect()
    assert 90 < len(near) <= 100 and all(1 <= r.votes <= 3 for r in near)


def vectors(spark, n=1500, dims=16):
    rng = np.random.default_rng(7)
    whole = rng.normal(size=(n, dims)) + 2 * rng.normal(size=(12, dims))[rng.integers(0, 12, n)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(whole)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [1.0]), (n + 2, [float("nan")] * dims)], "id long, vec array<float>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbour_index_recall_and_exact_form(spark, metric):
    corpus = vectors(spark)
    queries = corpus.filter("id % 3 = 0").withColumnRenamed("id", "qid")
    exact = V.search(queries.filter("qid < 1500"), corpus.filter("id < 1500"), 5, metric=metric).cache()
    index = NeighbourIndex.build(corpus, metric=metric)
    assert 1 <= index.probes < len(index.centres)
    assert recall(exact, index.search(queries, 5)).first().recall >= 0.9
    whole = NeighbourIndex.build(corpus, metric=metric, cells=8, probes=8).search(queries, 5)
    rows = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    assert [x[:3] for x in rows(whole)] == [x[:3] for x in rows(exact)]


def test_neighbour_index_in_blocks_and_of_nothing(spark, monkeypatch):
    corpus = vectors(spark, 200)
    queries = corpus.filter("id % 5 = 0").withColumnRenamed("id", "qid")
    rows = lambda df: sorted((r.qid, r["rank"], r.id) for r in df.collect())
    want = rows(NeighbourIndex.build(corpus, cells=4, probes=2).search(queries, 3, exclude_self=True))
    import ticketloom.operators.neighbours as N

    monkeypatch.setattr(N, "CELL_ROWS", 20)
    index = NeighbourIndex.build(corpus, cells=4, probes=2)
    assert max(index.blocks) > 1 and rows(index.search(queries, 3, exclude_self=True)) == want
    assert NeighbourIndex.build(corpus.limit(0)).search(queries, 3).collect() == []
    assert index.search(queries.limit(0), 3).collect() == []


def test_neighbour_index_meets_groups_in_parts_and_small_steps(spark, monkeypatch):
    import ticketloom.operators.neighbours as N

    corpus = vectors(spark, 400)
    queries = corpus.withColumnRenamed("id", "qid")
    rows = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    whole = NeighbourIndex.build(corpus, cells=12, probes=5)
    want = rows(whole.search(queries, 3, exclude_self=True))
    assert set(whole.groups) == {0} and len(want) == 1200
    for name, value in {"CELL_ROWS": 60, "QUERY_ROWS": 50, "LEAST_QUERY_ROWS": 50, "DISTANCES": 500, "HELD": 10}.items():
        monkeypatch.setattr(N, name, value)
    index = NeighbourIndex.build(corpus, cells=12, probes=5)
    assert len(set(index.groups)) > 3 and rows(index.search(queries, 3, exclude_self=True)) == want


def test_bm25_takes_the_terms_out_of_every_text_once(spark):
    """Also where a key has several rows: its length is that of all of them."""
    rows = [(1, "a1 b1 b1 c1"), (2, "b1 d1"), (2, "b1 e1 f1"), (3, ""), (None, "a1 d1")]
    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lists = R.term_lists(df, "text", keep=["doc_id"]).mapInArrow(seen, "doc_id long, terms array<string>")
    stored, counted = [], R.counted_terms
    R.counted_terms = lambda *args, **more: stored.append(args) or counted(*args, **more)
    try:
        got = sorted((r.doc_id, r.term, round(r.weight, 9)) for r in R.bm25_weights(lists, "doc_id").collect())
    finally:
        R.counted_terms = counted
    mean, length = 11 / 5, {1: 4, 2: 5}
    df_of = Counter(t for _, text in rows for t in set(text.split()))
    want = []
    for key, text in rows:
        for t, tf in Counter(text.split()).items():
            if key is not None:
                idf = np.log(1 + (5 - df_of[t] + 0.5) / (df_of[t] + 0.5))
                want.append((key, t, round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length[key] / mean)), 9)))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], abs=1e-8)
    # The terms once; that rows are counted and keys compared takes no text in a table.
    assert len(stored) == 1 and read.value <= 3 * len(rows)


def test_named_candidates_are_counted_in_the_tasks(spark, docs, texts):
    names = ["w1", "w2", "w399", "absent"]
    got = {r.term: (r.df, r.cf) for r in R.candidate_counts(R.term_lists(docs, "text"), names).collect()}
    plain = {t: (sum(t in (x or "").split() for _, x, _ in texts), sum((x or "").split().count(t) for _, x, _ in texts)) for t in names}
    assert got == {t: n for t, n in plain.items() if n[1]}
    assert R.candidate_counts(R.term_lists(docs.limit(0), "text"), names).count() == 0


def test_search_of_all_rows_by_blocks_is_brute_force(spark, monkeypatch):
    """Frequent and rare terms, ties, keys in several rows, a null key, rows without a shared term; in one block and in many."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        for t in {int(x) for x in rng.zipf(1.4, 12) if x < 60} | ({900 + i} if i % 50 == 0 else set()):
            rows.append((None if i == 7 else i if i < 230 else i - 40, f"t{t}", float(rng.integers(1, 4)) / 4))
    corpus = spark.createDataFrame(rows, "id long, term string, weight double").repartition(5)
    queries = corpus.filter("id % 3 = 0").withColumnRenamed("id", "qid").unionByName(
        spark.createDataFrame([(5000, "nowhere", 1.0), (5001, "t1", 0.0)], "qid long, term string, weight double")
    )
    sums, want = {}, set()
    for i, t, w in rows:
        sums.setdefault(i, {}).setdefault(t, []).append(w)
    for q in {i for i in sums if i is not None and i % 3 == 0}:
        scores = []
        for i, own in sums.items():
            shared = own.keys() & sums[q].keys()
            if shared:
                scores.append((-round(sum(sum(own[t]) * sum(sums[q][t]) for t in shared), 6), -1 if i is None else i, i))
        want |= {(q, i, -s, r) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:4], 1)}
    for block, matrix in ((R.BLOCK_ROWS, R.MATRIX_TERMS), (70, 3), (70, 0)):
        monkeypatch.setattr(R, "BLOCK_ROWS", block)
        monkeypatch.setattr(R, "MATRIX_TERMS", matrix)
        got = R.top_k_of_all(corpus, queries, "id", "qid", 4).collect()
        assert {(r.qid, r.id, r.score, r["rank"]) for r in got} == want


def test_search_of_all_rows_leaves_the_corpus_where_it_lies(spark, monkeypatch):
    """However many blocks there are: no row travels, unless its key comes twice."""
    rows = [(i, f"t{j}", 1.0 + j) for i in range(120) for j in (i % 7, 10 + i % 11)]
    corpus = spark.createDataFrame(rows, "id long, term string, weight double").coalesce(4)
    queries = corpus.withColumnRenamed("id", "qid")
    plans, materialise = [], R.materialise
    monkeypatch.setattr(R, "BLOCK_ROWS", 10)
    monkeypatch.setattr(R, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or materialise(df, name))
    assert R.top_k_of_all(corpus, queries, "id", "qid", 3).count() == 360
    nearest = [plan for name, plan in plans if name == "nearest"]
    # Only the nearest rows meet, by query.
    assert len(nearest) == 12 and all("hashpartitioning(qid" in p and "hashpartitioning(id" not in p and "Join" not in p for p in nearest)
