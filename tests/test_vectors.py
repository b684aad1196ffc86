import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import evaluate as E
from ticketloom.operators import sampling as S
from ticketloom.operators import vectors as V


def _data(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).astype(np.float32)
    m[10:20] = m[0]  # copies tie
    return m


def _frames(spark, m):
    rows = [(i, m[i].tolist(), i % 4) for i in range(len(m))]
    corpus = spark.createDataFrame(rows, "id long, vec array<float>, g int").repartition(5)
    return corpus.withColumnRenamed("id", "qid").filter("qid < 40"), corpus


def _brute(m, k, group=False, exclude=False, metric="cosine"):
    x = m.astype(np.float64)
    out = set()
    for q in range(40):
        if metric == "cosine":
            s = np.round((x @ x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])), 6)
        else:
            s = np.round(-np.linalg.norm(x - x[q], axis=1), 6)
        ids = [i for i in range(len(m)) if (not group or i % 4 == q % 4) and not (exclude and i == q)]
        best = sorted(ids, key=lambda i: (-s[i], i))[:k]
        out |= {(q, i, r + 1) for r, i in enumerate(best)}
    return out


@pytest.mark.parametrize("shipped", [4096, 0])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_rows_without_a_usable_vector_take_no_part(spark, shipped, metric):
    good = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]
    odd = [(4, None), (5, [1.0]), (6, []), (7, [1.0, None]), (8, [1.0, 0.0, 0.0][:1])]
    corpus = spark.createDataFrame(good + odd, "id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [None, 1.0])], "qid long, vec array<double>")
    got = {(r["qid"], r["id"], r["rank"]) for r in V.search(queries, corpus, 3, metric=metric, max_shipped=shipped).collect()}
    assert got == {(10, 1, 1), (10, 2, 2), (10, 3, 3)}


@pytest.mark.parametrize("shipped", [4096, 0])
@pytest.mark.parametrize("group, exclude", [(False, False), (True, True)])
def test_search_equals_brute_force(spark, monkeypatch, shipped, group, exclude):
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    m = _data()
    queries, corpus = _frames(spark, m)
    got = V.search(queries, corpus, 5, group="g" if group else None, exclude_self=exclude, max_shipped=shipped).collect()
    assert {(r["qid"], r["id"], r["rank"]) for r in got} == _brute(m, 5, group, exclude)


def test_search_over_empty_sides(spark):
    queries, corpus = _frames(spark, _data(50))
    assert V.search(queries.limit(0), corpus, 3).count() == 0
    assert V.search(queries, corpus.limit(0), 3).count() == 0


def test_knn_majority_vote(spark):
    m = _data(200)
    _, corpus = _frames(spark, m)
    train, test = corpus.filter("id >= 40"), corpus.filter("id < 40").withColumnRenamed("id", "qid")
    got = {r["qid"]: r["prediction"] for r in V.knn_classify(train, test, "g", "id", "qid", k=7).collect()}
    x = m.astype(np.float64)
    for q in range(40):
        near = sorted(range(40, 200), key=lambda i: (np.round(np.linalg.norm(x[i] - x[q]), 6), i))[:7]
        votes = {}
        for i in near:
            votes[i % 4] = votes.get(i % 4, 0) + 1
        assert got[q] == min(votes, key=lambda c: (-votes[c], c))


def test_fusion_case(spark):
    first = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8)], "qid int, doc string, score double")
    second = spark.createDataFrame([(1, "b", 1.0), (1, "c", 0.5)], "qid int, doc string, score double")
    got = [(r["doc"], r["score"]) for r in V.fuse(first, second).orderBy("rank").collect()]
    assert got == [("b", 0.9), ("a", 0.45), ("c", 0.25)]


def test_embedding_is_unit_length_and_pluggable(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: np.array(r["vec"]) for r in V.embed_texts(df, "t", dim=32).collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1) and not got[2].any() and not got[3].any()

    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    own = {r["id"]: np.array(r["vec"]) for r in V.embed_texts(df, "t", encoder=encoder).collect()}
    assert np.allclose(own[1], np.array([15, 1]) / np.linalg.norm([15, 1])) and np.allclose(own[3], [0, 1])


def test_rag_batch_with_own_responder(spark):
    docs = spark.createDataFrame([(1, "red apple", "fruit"), (2, "blue car", "car"), (3, "green apple pie", "fruit")],
                                 "id long, text string, category string")
    tickets = spark.createDataFrame([(9, "apple pie")], "qid long, text string")
    corpus, queries = V.embed_texts(docs, "text"), V.embed_texts(tickets, "text")
    row = V.rag_batch(queries, corpus, ["fruit", "car"], k=2).first()
    assert row["context"] == "green apple pie\nred apple" and row["response"] == "fruit"
    loud = V.rag_batch(queries, corpus, ["fruit"], k=1, responder=lambda p: p.str.len().astype(str)).first()
    assert loud["response"] == str(len(loud["prompt"]))


def test_centroids(spark):
    m = _data(80)
    _, corpus = _frames(spark, m)
    got = {r["g"]: np.array(r["centroid"]) for r in V.category_centroids(corpus, "g", "vec").collect()}
    for g in range(4):
        assert np.allclose(got[g], m[g::4].mean(axis=0), atol=1e-6)


def test_rank_of_expected(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "qid int, rank int, category string")
    queries = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "qid int, expected string")
    got = {r["qid"]: (r["hit"], r["rank"], r["top_categories"], r["top_category"]) for r in E.rank_of_expected(results, queries).collect()}
    assert got == {1: (True, 2, "a,b", "a"), 2: (False, None, "a", "a"), 3: (False, None, "", "Unknown")}
    assert E.search_miss_analysis(results, E.rank_of_expected(results, queries), 20).filter(F.col("qid") == 2).first()["n"] == 1


def test_grid_search_within_one_split_table(spark):
    """Both sides from one table, as in a split: the larger query set is joined block by block."""
    m = _data(120)
    rows = [(i, m[i].tolist(), "ab"[i % 2]) for i in range(len(m))]
    table = spark.createDataFrame(rows, "id long, vec array<float>, g string")
    split = S.stratified_split(table.select("id", "vec", F.col("g").alias("category")), "category", "id")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test").withColumnRenamed("id", "qid")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    want = rows_of(V.search(test, train, 5, metric="euclidean"))
    assert rows_of(V.search(test, train, 5, metric="euclidean", max_shipped=0)) == want and len(want) == 24 * 5


@pytest.mark.parametrize("corpus_slice", [16, 4096])
def test_rows_that_tie_are_not_held(monkeypatch, corpus_slice):
    monkeypatch.setattr(V, "CORPUS_SLICE", corpus_slice)
    m = np.repeat(_data(40), 50, axis=0).astype(float)
    ids, held, best = np.random.default_rng(2).permutation(len(m)), [], V._best
    monkeypatch.setattr(V, "_best", lambda q, i, s, k: held.append(len(q)) or best(q, i, s, k))
    q, found, s = V._top_candidates(V._prepare(m, "cosine"), ids, None, V._prepare(m, "cosine"), ids, None, 3, "cosine", True)
    assert max(held) <= V.QUERY_SLICE * 3 * 5 and np.bincount(q).tolist() == [3] * len(m)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for at in range(0, len(m), 97):
        scores = np.round(unit @ unit[at], 6)
        want = sorted((i for i in range(len(m)) if i != at), key=lambda i: (-scores[i], ids[i]))[:3]
        assert found[q == at].tolist() == ids[want].tolist()
