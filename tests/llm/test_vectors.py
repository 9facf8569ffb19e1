"""Operators on vectors, against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import exact_top_k as K
from corpuscle.llm import vector_codes as VC
from corpuscle.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, score double, q string"


def table(spark, rows, schema=SCHEMA):
    """Rows of (id, vector, label) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "c", 1, 0.5, "q") for r in rows], schema)


def random_rows(n, width=16, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    x = (centres[rng.integers(0, 4, n)] + rng.normal(size=(n, width)) / 3).astype(np.float32)
    return [(i, [float(c) for c in v], int(i % labels)) for i, v in enumerate(x)]


BAD = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [math.nan] * 16, None), (903, [math.inf] + [0.0] * 15, 0)]


def kept(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = kept(rows)
    width = -(-max(len(r[1]) for r in rows) // parts) * parts
    x = [[math.floor(scale * float(np.float32(c))) for c in r[1]] + [0] * (width - len(r[1])) for r in rows]
    w = width // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [math.floor(scale * float(np.float32(c))) for c in rows[i][1]]))[:entries]
    books = [[x[i][p * w : (p + 1) * w] for i in order] for p in range(parts)]

    def assigned(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e, strict=True)), k) for k, e in enumerate(books[p])) for v in x]

    for _ in range(rounds):
        for p in range(parts):
            found = assigned(p)
            for k in range(len(order)):
                mine = [x[i][p * w : (p + 1) * w] for i, (_, at) in enumerate(found) if at == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [assigned(p) for p in range(parts)]
    error = [sum(last[p][i][0] for p in range(parts)) for i in range(len(rows))]
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    out = [(r[0], [last[p][i][1] for p in range(parts)], error[i], by_label[r[2]]) for i, r in enumerate(rows)]
    text = ",".join(str(c) for p in books for e in p for c in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def by_null_last(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("extra", [[], BAD, [(None, [0.5] * 16, None), (None, [0.25] * 16, None), (3, [0.1] * 16, 2), (3, [0.1] * 16, 2)], [(950, [], 1), (951, [1.0] * 5, 1), (952, [2.0] * 19, 1)]])
def test_codes_equal_plain_rounds(spark, extra):
    rows = random_rows(60) + extra
    out, books = VC.compressed(table(spark, rows))
    expected, digest = codes_by_hand(rows)
    assert by_null_last((r.vec_id, list(r.code), r.error, r.label_error) for r in out.collect()) == by_null_last(expected)
    assert VC.books_digest(books) == digest


def test_codes_of_few_and_no_rows(spark):
    rows = random_rows(5)
    out, books = VC.compressed(table(spark, rows))
    assert books.shape == (8, 5, 2) and sorted(out.select("vec_id", "code", "error", "label_error").collect()) == sorted(codes_by_hand(rows)[0])
    out, books = VC.compressed(table(spark, BAD))
    assert out.count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="fits a long"):
        VC.compressed(table(spark, [(1, [1e30] * 16, 0)]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 17), st.integers(1, 20), st.sampled_from([2, 60, 10**6, 1 << 26]), st.integers(0, 10**6))
def test_nearest_is_exact(n, width, k, size, seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-size, size + 1, (k, width))
    x = np.where(rng.random((n, 1)) < 0.3, entries[rng.integers(0, k, n)] + rng.integers(-1, 2, (n, width)), rng.integers(-size, size + 1, (n, width)))
    at, least = VC.nearest(x, entries)
    all_of = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (at == all_of.argmin(1)).all() and (least == all_of.min(1)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.sampled_from([3, 1000, 1 << 27]), st.integers(0, 10**6))
def test_bounds_never_exceed_distances(width, size, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(-size, size + 1, (2, 6, width))
    a, b = VC.Means(x), VC.Means(y)
    i, j = np.nonzero(np.ones((6, 6)))
    exact = ((x[i] - y[j]) ** 2).sum(1)
    for level in range(len(a.levels)):
        assert (VC.lower_bounds(a, b, level, i, j) <= exact).all()


def top_by_hand(rows, k=10, scale=1024, step=100):
    rows = kept(rows)
    width = max(len(r[1]) for r in rows)
    x = [[math.floor(scale * float(np.float32(c))) for c in r[1]] + [0] * (width - len(r[1])) for r in rows]
    out = []
    for i, q in enumerate(rows):
        if q[0] is not None and q[0] % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(x[i], x[j], strict=True)), r[0] is None, r[0] or 0) for j, r in enumerate(rows) if j != i)
            out += [(q[0], n, None if null else at, -s) for n, (s, null, at) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [[], BAD, [(None, [0.5] * 16, 1), (200, [0.5] * 16, 1), (200, [0.5] * 16, 1)], [(1000, [], 1), (1001, [3.0] * 20, 0)], [(2000 + i, [1.0] * 16, 0) for i in range(50)]])
def test_top_k_equals_sorting_all(spark, monkeypatch, extra):
    rows = random_rows(330) + extra
    docs = table(spark, rows).repartition(7)
    found = K.top_k(docs, (docs.vec_id % 100) == 0)
    assert sorted([tuple(r) for r in found.collect()], key=str) == top_by_hand(rows)


def test_top_k_in_blocks_and_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(K, "FAN", 2)
    rows = random_rows(400, seed=3)
    docs = table(spark, rows).repartition(11)
    found = K.top_k(docs, (docs.vec_id % 10) == 0, k=4, block_bytes=4096)
    assert sorted([tuple(r) for r in found.collect()], key=str) == top_by_hand(rows, k=4, step=10)


def test_top_k_of_few_rows(spark):
    few = table(spark, random_rows(3))
    assert sorted(tuple(r) for r in K.top_k(few, few.vec_id % 100 == 0).collect()) == top_by_hand(random_rows(3))
    none = table(spark, BAD)
    assert K.top_k(none, none.vec_id % 100 == 0).count() == 0
    large = table(spark, [(0, [1e30] * 16, 0)])
    with pytest.raises(ValueError, match="fit a long"):
        K.top_k(large, large.vec_id == 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 30), st.integers(1, 12), st.sampled_from([2, 1000, 1 << 60]), st.integers(0, 10**6))
def test_tile_selection_breaks_ties_by_column(n, m, k, size, seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(-size, size, (n, m))
    own = rng.integers(-1, m, n)
    columns, counts = K.tile_best(scores, own, k)
    for i in range(n):
        expected = sorted((j for j in range(m) if j != own[i]), key=lambda j: (-int(scores[i, j]), j))[:k]
        assert sorted(columns[i][counts[i]].tolist()) == sorted(expected)


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[1 << 30, 1]]), np.array([[1 << 30, 1], [(1 << 30) + 1, -1]])
    assert K.products(a, b).tolist() == [[(1 << 60) + 1, (1 << 60) + (1 << 30) - 1]]


def whitened_by_hand(rows, most=8):
    rows = kept(rows)
    width = max(len(r[1]) for r in rows)
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] + [0] * (width - len(r[1])) for r in rows])
    n = len(x)
    d = n * x - x.sum(0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True).reshape(width, width))
    order = np.argsort(-e)[:most]
    return [r[0] for r in rows], (d.astype(object) ** 2).sum(1), (x - x.mean(0)) @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("extra", [[], BAD, [(7, [0.5] * 16, 1)] * 2 + [(None, [1.0] * 16, 1)], [(500, [], 1), (501, [3.0] * 18, 0), (502, [-3.0] * 17 + [1.0], 0)]])
def test_whitening_equals_the_covariances_eigenvectors(spark, monkeypatch, extra):
    monkeypatch.setattr(W, "FAN", 2)
    rows = random_rows(300, seed=5) + extra
    out = W.whitened(table(spark, rows).repartition(9)).collect()
    ids, deviation, expected, explained = whitened_by_hand(rows)
    assert len(out) == 8 * len(ids) and {r.n for r in out} == {len(ids)}
    assert out[0].identity_error < 1e-9 and len({r.identity_error for r in out}) == 1
    at = {}
    for r in out:
        at.setdefault(r.vec_id, []).append(r)
    for i, key in enumerate(ids):
        assert int(deviation[i]) in {int(r.deviation) for r in at[key]}
    for c in range(8):
        mine = {(r.vec_id, int(r.deviation)): r.whitened for r in out if r.component == c + 1}
        hand = {(key, int(deviation[i])): expected[i, c] for i, key in enumerate(ids)}
        sign = np.sign(sum(mine[k] * hand[k] for k in hand))
        assert all(abs(mine[k] - sign * hand[k]) < 1e-6 * max(1, abs(hand[k])) for k in hand)
        assert {r.explained for r in out if r.component == c + 1}.pop() == pytest.approx(explained[c], rel=1e-9)


def test_whitening_without_variance_and_without_rows(spark):
    out = W.whitened(table(spark, [(i, [1.0, 2.0, float(i % 2)], 0) for i in range(6)])).collect()
    assert len(out) == 18 and all((r.whitened is None) == (r.component > 1) for r in out)
    assert all(r.explained == (1 if r.component == 1 else 0) for r in out)
    one = W.whitened(table(spark, [(1, [1.0, 2.0], 0)])).collect()
    assert [(r.component, r.whitened, int(r.deviation)) for r in one] == [(1, None, 0), (2, None, 0)]
    assert W.whitened(table(spark, BAD)).count() == 0 and W.whitened(table(spark, [(1, [], 0)])).count() == 0


def test_whitening_of_large_integers(spark):
    rows = [(i, [float(i) * 1e11, 1.0], 0) for i in range(40)]
    out = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    x = [math.floor(1024 * r[1][0]) for r in rows]
    assert {r.vec_id: int(r.deviation) for r in out} == {i: (40 * x[i] - sum(x)) ** 2 for i in range(40)}
    assert out[0].identity_error < 1e-9
