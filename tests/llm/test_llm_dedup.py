"""Exact dedup, line dedup and the Jaccard join against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from ticketloom.llm import exact_dedup, jaccard_join, line_dedup
from ticketloom.session import work_path

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def linked(rows, width=5, percent=80):
    """(row, shingles, smallest id of the component) of (id, text) pairs, by all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return Counter(
        (doc, len(sets[i]), (min(least[find(i)], default=None)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)
    )


def test_jaccard_join_equals_all_pairs(documents, texts):
    want = linked(list(texts.items()))
    assert Counter(map(tuple, jaccard_join.jaccard_components(documents).collect())) == want


def test_jaccard_join_of_split_regions_and_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for k in range(i % 9):
            w[(7 * i + 23 * k) % 200] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:20] + [f"y{i}_{k}" for k in range(30)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked(rows)
    for leaf in (1 << 20, 1000):
        assert Counter(map(tuple, jaccard_join.jaccard_components(docs, leaf=leaf).collect())) == want


def test_no_arrangement_of_words_shares_a_hash():
    whole = [" ".join(w) for n in range(1, 6) for w in itertools.product("xyz", repeat=n)]
    found = [list(s) for s in jaccard_join.shingle_lists(whole)]
    assert all(len(s) == 1 for s in found) and len({s[0] for s in found}) == len(whole)


@pytest.mark.parametrize("vocabulary", [2, 3, 4, 6])
def test_jaccard_join_of_few_words(spark, vocabulary):
    rng = random.Random(vocabulary)
    rows = [(k, " ".join(rng.choices("abcdef"[:vocabulary], k=rng.randint(1, 14)))) for k in range(120)]
    rows += [(200, "yes no no yes"), (201, "no yes yes no"), (202, "x y y x z y x x y z")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == linked(rows)


def test_jaccard_join_edges(edge_docs, no_docs, edge_rows):
    got = Counter(map(tuple, jaccard_join.jaccard_components(edge_docs).collect()))
    assert got == linked([r[:2] for r in edge_rows])
    assert jaccard_join.jaccard_components(no_docs).collect() == []
    assert jaccard_join.without_near_copies(no_docs).collect() == []
    stay = jaccard_join.without_near_copies(edge_docs)
    assert stay.columns == edge_docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter([1, 3, 4, 5, 6, 7, 9, None])


def test_exact_dedup_edges(edge_docs, no_docs):
    rows = exact_dedup.exact_dedup(edge_docs).collect()
    assert len(rows) == 12
    # doc 1, twice doc 2 and a null id hold the same text: the smallest id stays, a null one never does.
    same = [r for r in rows if r.group_size == 4 and r.keep_id == 1]
    assert sorted((r.doc_id or 0, r.kept) for r in same) == [(0, False), (1, True), (2, False), (2, False)]
    # Null, empty and blank texts are equal; the most code points win.
    blank = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in blank} == {5} and len(blank) == 4 and sum(r.kept for r in blank) == 1
    assert exact_dedup.exact_dedup(no_docs).collect() == []


def test_digest_index_keeps_what_earlier_batches_brought(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", work_path(spark, "digest_index_test"), 4)
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "a  b"), (4, "d"), (5, "d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(first).collect()) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(second).collect()) == [(0, 1, False), (4, 4, True), (5, 4, False)]
    assert index.read().count() == 3


def test_line_dedup_deletes_later_runs(spark):
    run = "\n".join(f"line {k} of the passage that many documents share with each other" for k in range(6))
    one = "word " * 60
    rows = [
        (1, f"start one\n{run}\nend one"),
        (2, f"start two\n\n{run}\nend two"),
        (3, "line 0 of the passage that many documents share with each other\nbut short"),
        (4, f"{one}\nmiddle\n{one}"),
        (None, run),
    ]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "start two\n\nend two" and got[2].n_removed == 6
    assert got[4].text == f"{one}\nmiddle" and got[None].text == "" and got[None].n_worded_left == 0
    kept = line_dedup.deduped_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]


def test_line_dedup_edges(edge_docs, no_docs):
    rows = line_dedup.dedup_lines(edge_docs).collect()
    assert len(rows) == 12 and {r.text for r in rows if r.doc_id == 3} == {None}
    assert line_dedup.dedup_lines(no_docs).collect() == []
    kept = line_dedup.deduped_documents(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 12


def test_a_batch_that_is_added_again_keeps_its_labels(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_again", work_path(spark, "digest_index_again"), 4)
    old = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(7, "ab"), (8, "d"), (9, "d "), (9, "d "), (10, None), (11, "e")], "doc_id long, text string")
    index.add(old, batch="first").collect()
    labels = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect())
    want = [(7, 1, 1, False), (8, 9, 3, False), (9, 9, 3, False), (9, 9, 3, True), (10, 10, 1, True), (11, 11, 1, True)]
    # As after a run that failed in the middle of its append: a part of the batch is there.
    index.add(new.where("doc_id < 10"), batch="second").collect()
    assert labels(index.add(new, batch="second")) == want
    assert labels(index.add(new.orderBy("text").repartition(3), batch="second")) == want
    assert index.read().count() == 5
    assert labels(index.add(new, batch="third")) == [(i, k, n, False) for i, k, n, _ in want]
    spark.sql("DROP TABLE digest_index_again")
