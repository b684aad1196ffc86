"""Vector codes, the source audit and vector dedup against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from ticketloom.llm import source_audit, vector_codes, vector_dedup

NAN, INF = float("nan"), float("inf")
CLASH = "cell int, h1 string, n int, position int, part string, salt string, links string, own string"


def vector_rows(spark, rows, kind="float"):
    width = len(CLASH.split(", "))
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], f"vec_id long, embedding array<{kind}>, label int, {CLASH}")


def edge_vectors(dims=8):
    rng = np.random.default_rng(3)
    some = [(k, [float(np.float32(x)) for x in rng.normal(size=dims)], k % 3) for k in range(20)]
    some += [(30 + k, [float(np.float32(x + 0.01 * k)) for x in some[4][1]], None) for k in range(5)]
    some += [some[0], some[0], (None, some[1][1], 1), (40, some[2][1], None), (41, [2 * x for x in some[2][1]], 2)]
    some += [(50, None, 1), (51, [NAN] * dims, 1), (52, [INF] + [0.0] * (dims - 1), 1), (53, [None] + [1.0] * (dims - 1), 2), (54, [0.0] * dims, 2)]
    return [*some, (None, None, None), (55, [], 1)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = sorted(((r[0], [math.floor(4096 * x) for x in r[1]], r[2]) for r in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[best(c[p], books[p])].append(c[p])
            books[p] = [tuple(sum(x) // len(own[e]) for x in zip(*own[e], strict=True)) if e in own else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][f[p]]) for p in range(parts)) for c, f in zip(cut, found, strict=True)]
    sums = Counter()
    for r, e in zip(whole, errors, strict=True):
        sums[r[2]] += e
    return Counter((r[0], "".join(f"{x:02x}" for x in f), e, sums[r[2]], digest) for r, f, e in zip(whole, found, errors, strict=True))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes_equal_plain_python(spark, kind):
    rows = edge_vectors(16)
    got = vector_codes.vector_codes(vector_rows(spark, rows, kind)).collect()
    assert Counter(map(tuple, got)) == plain_codes(rows) and len(got) == 31


def test_vector_codes_of_nothing_few_and_odd_lengths(spark):
    assert vector_codes.vector_codes(vector_rows(spark, [])).collect() == []
    assert vector_codes.vector_codes(vector_rows(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    few = [(2, [0.5] * 8, 1), (1, [-0.3] * 8, 1)]
    assert Counter(map(tuple, vector_codes.vector_codes(vector_rows(spark, few)).collect())) == plain_codes(few)
    # A vector of another length than that of the smallest vec_id is dropped, as are all of a length that 8 does not divide.
    assert [r.vec_id for r in vector_codes.vector_codes(vector_rows(spark, [*few, (3, [1.0] * 16, 1)])).orderBy("vec_id").collect()] == [1, 2]
    assert vector_codes.vector_codes(vector_rows(spark, [(1, [1.0] * 9, 1)])).collect() == []
    assert vector_codes.vector_codes(vector_rows(spark, [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)])).count() == 2


def test_the_walk_finds_the_nearest_entries():
    rng = np.random.default_rng(1)
    for n, high in ((1, 5), (6000, 2), (9000, 60), (9000, 0)):
        parts, entries = rng.integers(-high, high + 1, (n, 4)), rng.integers(-high, high + 1, (7, 4))
        far = ((parts[:, None] - entries) ** 2).sum(2)
        for rows in (np.arange(n), np.lexsort(parts.T[::-1])):
            index, distance = vector_codes.nearest(parts[rows], entries)
            assert (index == far[rows].argmin(1)).all() and (distance == far[rows].min(1)).all()


def plain_links(rows, cosine=0.95):
    good = {}
    for k, (_, v, _) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v)
            good[k] = x / np.sqrt(x @ x)
    near = {k: [j for j in good if j != k and k in good and good[j] @ good[k] >= cosine] for k in range(len(rows))}
    out = []
    for k, (vec, _, _) in enumerate(rows):
        met, stack = {k}, [k]
        while stack:
            for j in near[stack.pop()]:
                if j not in met:
                    met.add(j)
                    stack.append(j)
        root = min((rows[j][0] for j in met if rows[j][0] is not None), default=None)
        out.append((vec, len(near[k]), root, vec == root))
    return Counter(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_of_edges(spark, kind):
    rows = edge_vectors()
    assert Counter(map(tuple, vector_dedup.near_vectors(vector_rows(spark, rows, kind)).collect())) == plain_links(rows)
    assert vector_dedup.near_vectors(vector_rows(spark, [])).collect() == []
    none = [(1, None, 1), (2, [0.0, 0.0], 1)]
    assert Counter(map(tuple, vector_dedup.near_vectors(vector_rows(spark, none)).collect())) == plain_links(none)
    left = vector_dedup.without_near_vectors(vector_rows(spark, rows, kind))
    assert "h1" in left.columns and {r.vec_id for r in left.collect()} == {r[0] for r in plain_links(rows) if r[3]}


@pytest.mark.parametrize("dims,spread,block", [(2, 1.0, 1 << 15), (3, 0.3, 16), (8, 0.2, 40), (64, 0.03, 25)])
def test_no_link_is_lost_between_cells_and_blocks(spark, dims, spread, block):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(40, dims))
    whole = np.concatenate([base, base[rng.integers(0, 40, 160)] + spread * rng.normal(size=(160, dims)), np.repeat(base[:1], 60, 0)])
    rows = [(int(k), [float(np.float32(x)) for x in v], None) for k, v in zip(rng.permutation(len(whole)), whole, strict=True)]
    got = vector_dedup.near_vectors(vector_rows(spark, rows), visits=50.0, block=block)
    assert Counter(map(tuple, got.collect())) == plain_links(rows)


def test_every_linked_pair_meets_in_one_cell():
    rng = np.random.default_rng(5)
    for dims in (2, 3, 5):
        v = vector_dedup.unit(rng.normal(size=(300, dims)))
        centres = vector_dedup.fitted(v, 12)
        home, visits = vector_dedup.reach(v, centres, 0.95)
        a, b = np.nonzero(np.triu(v @ v.T >= 0.95, 1))
        meets = (home[a] == home[b]) * 1 + visits[a, home[b]] + visits[b, home[a]]
        assert len(a) and (meets == 1).all()


def plain_audit(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    import re

    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    count, holders, out = defaultdict(Counter), defaultdict(Counter), []
    for t, la, s in rows:
        count[la, s].update(words(t))
        holders[la].update(set(words(t)))
    for la in {r[1] for r in rows}:
        kept = [t for t, n in holders[la].items() if n >= least]
        groups = sorted({r[2] for r in rows if r[1] == la})
        whole = Counter()
        for s in groups:
            whole.update(count[la, s])

        def price(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q = price(whole)
        for s in groups:
            p = price(count[la, s])
            f = lambda x, y: (x - y) ** 2 // (x + y)
            pairs = []
            for o in groups:
                if o != s:
                    r = price(count[la, o])
                    pairs.append((o, sum(f(p[t], r[t]) for t in kept)))
            terms = [(t, f(p[t], q[t])) for t in kept if count[la, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(la, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return Counter(out)


def test_source_audit_equals_plain_python(spark, documents, edge_docs, edge_rows, no_docs):
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    assert Counter(map(tuple, source_audit.source_divergence(documents).collect())) == plain_audit(rows)
    edges = [(r[1], r[2], r[3]) for r in edge_rows]
    for least in (1, 2, 10):
        got = Counter(map(tuple, source_audit.source_divergence(edge_docs, least=least, block=3).collect()))
        assert got == plain_audit(edges, least)
    assert source_audit.source_divergence(no_docs).collect() == []
    # Ties of value go by UTF-8 bytes, more terms than ranks.
    ties = [(" ".join(f"W{k} é{k} x" for k in range(9)) + " Aa Bb ÄÖ ü", "de", s) for s in ("a", "b", None) for _ in range(2)]
    ties += [(" ".join(chr(97 + k) * 3 for k in range(20)), "de", "a")] * 3
    docs = spark.createDataFrame(ties, "text string, lang string, source string")
    assert Counter(map(tuple, source_audit.source_divergence(docs, least=2).collect())) == plain_audit(ties, 2)


def test_joint_tables_price_as_single_terms_do():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (3000, 5)) * rng.integers(0, 300, (3000, 5)) ** (rng.random((3000, 1)) < 0.2)
    totals = [int(n) for n in counts.sum(0)]
    p = np.stack([source_audit.share(counts[:, g], totals[g], 3000) for g in range(5)])
    assert all(p[g, t] == 1 + 10**9 * (int(counts[t, g]) + 2) // (totals[g] + 6000) for g in range(5) for t in range(0, 3000, 7))
    want = np.array([[source_audit.price(p[g], p[h]).sum() if g != h else 0 for h in range(5)] for g in range(5)])
    for columns in (5, 40, 1 << 10):
        assert (source_audit.joint_price(counts, totals, 3000, columns) == want).all()
    big = np.array([10**15], np.int64)
    assert source_audit.share(big, 2 * 10**15, 50)[0] == 1 + 10**9 * (10**15 + 2) // (2 * 10**15 + 100)
