"""Whitening and vector codes against plain numpy, on awkward tables, and the qd solver by itself."""

import math
import random

import numpy as np
import pytest

from gridmill.llm import qd, vector_codes, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, n long, low double, whole string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, label, 1, 2.0, "x") for i, v, label in rows], VECTORS).repartition(parts)


def clustered(n, d, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, d))
    m = (centres[rnd.integers(0, 5, n)] * 0.2 + rnd.normal(size=(n, d)) * 0.1).astype(np.float32)
    m[: n // 3] = m[0]  # a third of all rows are copies
    return m


def awkward_rows(d):
    good = [0.25] * d
    return [
        (None, good, None), (901, None, 1), (902, [], 1), (903, [math.nan] + good[1:], 1), (904, [math.inf] + good[1:], 1),
        (905, [None] + good[1:], 1), (906, good[:-1], 1), (907, [-math.inf] + good[1:], None), (908, [3e38] + good[1:], 1),
    ]


def bidiagonal_cases():
    rnd = np.random.default_rng(0)
    u, w = (np.linalg.qr(rnd.normal(size=(40, 40)))[0] for _ in range(2))
    tail = np.linspace(1, 0.1, 32)
    yield rnd.normal(size=(40, 40))
    yield np.linalg.qr(rnd.normal(size=(3000, 40)), mode="r")
    yield np.eye(9)
    yield np.ones((6, 6))
    yield np.diag(np.arange(12.0))
    yield np.array([[3.0]])
    yield np.vstack([rnd.normal(size=(3, 20)), np.zeros((17, 20))])
    yield u @ np.diag([5, 5, 5, 3, 3, 2, 2, 2, *tail]) @ w.T
    yield u @ np.diag([5, 5 - 1e-9, 5 - 2e-9, 3, 3 - 1e-5, 2, 2, 2, *tail]) @ w.T
    yield u @ np.diag(10.0 ** -np.arange(0, 20, 0.5)) @ w.T
    yield np.diag(np.abs(np.arange(41) - 20.0)) + np.diag(np.ones(40), 1)


@pytest.mark.parametrize("matrix", list(bidiagonal_cases()), ids=lambda m: f"{len(m)}-{m[0, 0]:.2f}")
def test_singular_values_and_vectors(matrix):
    values, vectors = qd.right_vectors(matrix, 8)
    want = np.linalg.svd(matrix, compute_uv=False) ** 2
    rank = int((want > 1e-24 * want[0]).sum())
    assert len(values) == min(8, rank)
    assert values == pytest.approx(want[: len(values)], rel=1e-10)
    assert np.abs(matrix.T @ (matrix @ vectors) - vectors * values).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10


def test_every_squared_value_is_relatively_accurate():
    diagonal, upper = 10.0 ** -np.arange(12.0), np.full(11, 1e-9)
    exact = np.linalg.svd(np.diag(diagonal[:4]), compute_uv=False) ** 2
    got = qd.squared_values(diagonal, upper)
    assert got[:4] == pytest.approx(exact, rel=1e-9) and (got > 0).all()
    assert qd.squared_values(np.zeros(3), np.zeros(2)).tolist() == [0, 0, 0]


@pytest.mark.parametrize("n, d, parts", [(700, 16, 70), (300, 64, 3), (5, 16, 5)])
def test_whitening_equals_the_dense_solution(spark, n, d, parts):
    m = clustered(n, d, n)
    rows = [(i % (n - 1), m[i].tolist(), 0) for i in range(n)] + awkward_rows(d)[1:]
    got = whitening.whiten(frame(spark, rows, parts)).collect()
    x = np.floor(m.astype(float) * 1024) + 100000
    c = x - x.mean(0)
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    k = min(8, int((values > 1e-9 * values[-1]).sum()))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1
    white = c @ vectors / np.sqrt(values)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(0))) for row in x]
    for j in range(k):
        mine = [r for r in got if r.component == j + 1]
        assert all(r.explained == pytest.approx(values[j] / np.trace(cov), rel=1e-9) for r in mine)
        want = sorted((i % (n - 1), exact[i], abs(white[i, j])) for i in range(n))
        mine.sort(key=lambda r: (r.vec_id, r.deviation, abs(r.whitened)))
        assert [(r.vec_id, r.deviation) for r in mine] == [w[:2] for w in want]
        assert [abs(r.whitened) for r in mine] == pytest.approx([w[2] for w in want], rel=1e-7, abs=1e-9)
        signs = {np.sign(r.whitened * white[r.vec_id, j]) for r in mine if 0 < r.vec_id and abs(r.whitened) > 1e-6}
        assert len(signs) <= 1


def test_whitening_of_tables_without_variance(spark):
    same = [(i, [0.5, -0.5], 0) for i in range(4)]
    for rows in ([], awkward_rows(2)[1:6], same, same[:1]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    # One dimension varies: one component; a null id stays.
    got = whitening.whiten(frame(spark, [(None, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])).collect()
    assert {(r.vec_id, r.component, r.n, abs(r.whitened), r.explained) for r in got} == {(None, 1, 2, 1, 1), (2, 1, 2, 1, 1)}


def test_deviations_beyond_64_bits_are_null():
    model = whitening.Whitener(1 << 31, np.array([0]), np.empty(0), np.empty((1, 0)), 0.0)
    assert whitening.deviations(np.array([[1], [2]]), model) == [1 << 62, None]


def brute_codes(rows, parts, entries, rounds):
    """The rounds spelled out, one part and one entry at a time."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[[math.floor(float(v) * 4096) for v in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in rows]
    books = [[cut[j][p] for j in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), j) for j, entry in enumerate(book))

    for _ in range(rounds):
        found = [[nearest(row[p], books[p])[1] for p in range(parts)] for row in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [row[p] for row, f in zip(cut, found) if f[p] == j]
                if mine:
                    books[p][j] = [sum(column) // len(mine) for column in zip(*mine)]
    out = []
    for row, (i, _, label) in zip(cut, rows):
        final = [nearest(row[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in final), sum(e for e, _ in final)))
    return out, books


@pytest.mark.parametrize("n, d, entries", [(240, 16, 16), (90, 32, 40), (7, 16, 16), (60, 8, 3)])
def test_codes_equal_brute_force(spark, n, d, entries):
    m = clustered(n, d, n)
    rnd = random.Random(n)
    rows = [(rnd.randrange(2 * n), m[i].tolist(), rnd.choice([None, 0, 1, 2, 2, 2])) for i in range(n)]
    rows.append(awkward_rows(d)[0])
    fitted = vector_codes.fit_codes(frame(spark, rows + awkward_rows(d)[1:]), parts=8, entries=entries, rounds=5)
    want, books = brute_codes(rows, 8, entries, 5)
    assert fitted.books.tolist() == books
    got = vector_codes.with_label_errors(fitted).collect()
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    order = lambda r: (r[0] is None, *map(str, r))
    wanted = sorted(((i, code, error, by_label[label]) for i, label, code, error in want), key=order)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=order) == wanted
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_ties_go_to_the_lower_entry(spark):
    # Values in steps of a half: many distances are equal, and equal starts leave entries unused.
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(16)], 1) for i in range(200)]
    rows[:4] = [(i, rows[0][1], 1) for i in range(4)]
    fitted = vector_codes.fit_codes(frame(spark, rows), parts=8, entries=16, rounds=6)
    want, books = brute_codes(rows, 8, 16, 6)
    assert fitted.books.tolist() == books
    assert sorted((r.vec_id, r.code, r.error) for r in fitted.codes.collect()) == sorted((i, c, e) for i, _, c, e in want)


def test_bounds_save_distances_and_always_hold():
    rnd = np.random.default_rng(3)
    values = rnd.integers(-300, 300, (2000, 4)) + 2000 * rnd.integers(0, 4, (2000, 1))
    part = np.zeros(2000, int)
    books = values[:16][None].copy()
    bounds = vector_codes.closest(values, part, books, 4)
    looked = []
    for b in (4, 2, 6, 5, 3):
        old, books = books, books + rnd.integers(-6, 7, books.shape)
        bounds = vector_codes.moved(vector_codes.resize(bounds, b), values, part, books, old)
        squares = vector_codes.distances(values, books[0])
        assert (bounds.near[:, 0] == squares.argmin(1)).all()
        far = np.sqrt(squares)
        assert (bounds.low[:, 0] >= far.min(1)).all()
        listed = np.zeros((2000, 17), bool)
        for j in range(b):  # every entry after place j is at least as far as bound j says
            if j:
                rest = np.where(listed[:, :16], np.inf, far).min(1)
                assert (bounds.low[:, j] <= rest + 1e-9).all()
            listed[np.arange(2000), np.where(bounds.near[:, j] < 0, 16, bounds.near[:, j])] = True
        assert (bounds.outer <= np.where(listed[:, :16], np.inf, far).min(1) + 1e-9).all()
        looked.append((bounds.used == 0).mean())
    assert min(looked) > 0.3


def test_no_vectors(spark):
    for rows in ([], awkward_rows(8)[1:6]):
        fitted = vector_codes.fit_codes(frame(spark, rows))
        assert vector_codes.with_label_errors(fitted).count() == 0 and fitted.books.shape == (8, 0, 0)


def test_lengths_that_do_not_divide(spark):
    rows = [(i, [i / 10, 1.0, -i / 7], None) for i in range(20)]
    fitted = vector_codes.fit_codes(frame(spark, rows), parts=2, entries=4, rounds=3)
    want, books = brute_codes([(i, v + [0.0], label) for i, v, label in rows], 2, 4, 3)
    assert fitted.books.tolist() == books
    assert sorted((r.vec_id, r.code, r.error) for r in fitted.codes.collect()) == sorted((i, c, e) for i, _, c, e in want)
