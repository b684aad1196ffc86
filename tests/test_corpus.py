import hashlib
from collections import Counter

from pyspark.sql import functions as F

from ticketloom.operators import columns as C
from ticketloom.operators import corpus as U
from ticketloom.operators import monitor as M
from ticketloom.operators import sampling as S


def test_ticket_beats_tweet_and_first_row_wins(spark):
    tickets = spark.createDataFrame([(5, "same", "Billing"), (6, "odd", "Misc")], "k int, clean_text string, Issue_Category string")
    tweets = spark.createDataFrame([(1, "same", "Delivery"), (3, "two", "Fraud"), (2, "two", "Delivery")],
                                   "k int, clean_text string, category string")
    got = {r["clean_text"]: (r["k"], r["category"], r["source"], r["confidence"]) for r in U.merge_corpora(tickets, tweets, "k").collect()}
    assert got == {"same": (5, "Billing", "ticket", 1.0), "two": (2, "Delivery", "twitter", 0.7)}


def test_dedupe_with_a_hot_text(spark):
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("t"),
        (F.col("id") * 2).alias("v"),
    )
    got = U.dedupe_keep_first(rows.repartition(5), ["t"], "id")
    assert got.count() == 2001
    assert tuple(got.filter("t = 'hot'").first()) == (0, "hot", 0)


def test_vocab_overlap_brute_force(spark):
    docs = [("x", "aa bb cc dd"), ("y", "bb cc zz"), ("z", "cc aa aa"), ("w", "only here")]
    df = spark.createDataFrame(docs, "c string, t string")
    words = {}
    for c, t in docs:
        words.setdefault(c, set()).update(t.split())
    got = {(r["class_a"], r["class_b"]): (r["overlap"], r["examples"]) for r in U.vocab_overlap(df, "c", "t", examples=1).collect()}
    names = sorted(words)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            shared = sorted(words[a] & words[b])
            assert got[(a, b)] == (len(shared), shared[0] if shared else "")


def _hash(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def _classes(spark):
    """One class holds most rows, one class is null, one has a single row."""
    return spark.range(1000).select(
        "id", F.when(F.col("id") == 7, "one").when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 5 == 0, "b").otherwise("a").alias("c")
    )


def test_split_is_exact_and_layout_free(spark):
    df = _classes(spark)
    rows = S.stratified_split(df, "c", "id").collect()
    again = S.stratified_split(df.repartition(9), "c", "id").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == 1000
    by_class = {}
    for r in df.collect():
        by_class.setdefault(r["c"], []).append(r["id"])
    want = {i for ids in by_class.values() for i in sorted(ids, key=_hash)[: int(len(ids) * 0.2 + 0.5)]}
    assert {r["id"] for r in rows if r["is_test"]} == want


def test_sample_cap_and_folds(spark):
    df = _classes(spark)
    ids = [r["id"] for r in df.collect()]
    assert {r["id"] for r in S.sample_n(df, 37, "id").collect()} == set(sorted(ids, key=_hash)[:37])
    assert S.sample_n(df, 5000, "id").count() == 1000
    sizes = Counter(r["c"] for r in df.collect())
    capped = Counter(r["c"] for r in S.cap_per_class(df, "c", "id", 100).collect())
    assert capped == {c: min(n, 100) for c, n in sizes.items()}
    folds = Counter((r["c"], r["fold"]) for r in S.kfold_assign(df, "c", "id", 5).collect())
    for c, n in sizes.items():
        per_fold = [folds.get((c, f), 0) for f in range(5)]
        assert sum(per_fold) == n and max(per_fold) - min(per_fold) <= 1
    assert S.stratified_sample(df, "c", "id", 100).count() in range(97, 104)


def test_balance_reaches_the_target(spark):
    df = _classes(spark).na.fill("none")
    got = S.balance_classes(df, "c", "id", 150)
    assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {"a": 150, "b": 150, "one": 150, "none": 150}
    methods = {(r["c"], r["method"]) for r in got.select("c", "method").distinct().collect()}
    assert methods == {("a", "undersampled"), ("b", "undersampled" if df.filter("c='b'").count() > 150 else "kept"),
                       ("one", "oversampled"), ("none", "oversampled")}
    assert got.filter("method <> 'oversampled'").groupBy("id").count().filter("count > 1").count() == 0


def test_index_is_dense(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 13).alias("k"))
    got = [r["embedding_index"] for r in C.assign_index(df.repartition(6), "k").orderBy("k").collect()]
    assert got == list(range(len(got)))


def test_index_of_sparse_and_missing_keys(spark):
    df = spark.createDataFrame([(9 * 10**18, "d"), (None, "x"), (1, "a"), (None, "y"), (-5, "z"), (5 * 10**12, "c")], "k long, v string")
    got = {r["v"]: r["embedding_index"] for r in C.assign_index(df, "k").collect()}
    assert got == {"z": 0, "a": 1, "c": 2, "d": 3, "x": None, "y": None}
    assert C.assign_index(df.limit(0), "k").count() == 0


def test_a_null_class_is_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else None) for i in range(13)], "id int, c string")
    got = S.balance_classes(df, "c", "id", 5)
    assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {"a": 5, None: 5}
    assert {r["id"] for r in got.filter("c IS NULL").collect()} <= {10, 11, 12}


def test_a_null_class_drifts_like_any_other(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "c string")
    assert tuple(M.detect_drift(df, df, "c").first()) == (0.0, False)
    assert tuple(M.detect_drift(df, df.filter("c IS NULL"), "c").first()) == (0.5, True)


def test_duplicate_reports(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    assert tuple(U.duplicate_texts(df, "t").first()) == (3, 2, 1, False)
    assert U.duplicate_rate(df, "t").first()["high"] is True
    empty = U.duplicate_rate(df.limit(0), "t").first()
    assert empty["rows"] == 0 and empty["high"] is False


def test_inbound_and_column_choice(spark):
    df = spark.createDataFrame([(1, None)], "id int, Issue_Category string")
    assert C.filter_inbound(df).count() == 1
    assert C.pick_category_column(df).first()["category"] == "unknown"
    try:
        C.pick_text_column(df)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_vocab_overlap_of_many_classes(spark):
    from ticketloom.operators import corpus

    letters = "abcdefghij"
    name = lambda i: letters[i // 10] + letters[i % 10]
    rows = [(f"c{i:02d}", f"shared{name(i // 2)} own{name(i)}") for i in range(80)]
    df = spark.createDataFrame([*rows, (None, "sharedaa sharedab")], "label string, text string")
    table = {(r["class_a"], r["class_b"]): (r["overlap"], r["examples"]) for r in corpus.vocab_overlap(df, "label", "text").collect()}
    assert len(table) == 80 * 79 // 2
    assert {k: v for k, v in table.items() if v[0]} == {(f"c{i:02d}", f"c{i + 1:02d}"): (1, f"shared{name(i // 2)}") for i in range(0, 80, 2)}
    some = corpus.vocab_overlap(df, "label", "text", labels=["c01", "c00", "zz"]).collect()
    assert [(r["class_a"], r["class_b"], r["overlap"]) for r in sorted(some)] == [("c00", "c01", 1), ("c00", "zz", 0), ("c01", "zz", 0)]


def test_leakage_of_null_and_equal_texts(spark):
    from ticketloom.operators import corpus

    train = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "id long, text string")
    assert sorted(r["id"] for r in corpus.split_leakage(train, test, "text").collect()) == [1]
    assert sorted(r["id"] for r in corpus.unleaked(train, test, "text").collect()) == [2, 3, 4]
    row = corpus.duplicate_texts(train, "text").first()
    assert (row["rows"], row["distinct_texts"], row["duplicated"], row["all_unique"]) == (3, 2, 1, False)
