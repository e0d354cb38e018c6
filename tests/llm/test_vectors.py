"""Whitening against dense eigenvectors, codes against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from parcelmint.llm import codes, registry, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int, x string, v int, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "c") for i, v, label in rows], KIND)


def dense(vectors, k):
    """(n, whitened by row, shares of the trace, deviations) from a full eigendecomposition."""
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = (n * fit - sums) / n
    value, u = np.linalg.eigh(y.T @ y / n)
    value, u = value[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - sums) / n) @ u / np.sqrt(value), value / np.trace(y.T @ y / n), ((n * x - sums) ** 2).sum(1)


def check_whitening(found, ids, vectors, k):
    n, white, shares, deviation = dense(vectors, k)
    assert len(found) == len(ids) * k and {r.n for r in found} == {n}
    got = {(r.vec_id, r.component): r for r in found}
    for j in range(k):
        column = np.array([got[i, j + 1].whitened for i in ids])
        sign = np.sign(column @ white[:, j])
        assert np.abs(column - sign * white[:, j]).max() < 1e-8
        assert got[ids[0], j + 1].explained == pytest.approx(shares[j], rel=1e-9)
    assert [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 24)) * np.linspace(2, 0.3, 24)).tolist()
    vectors += vectors[:40]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [None] * 24, 1), (902, [math.nan] * 24, 1), (903, [math.inf] * 24, 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    found = whitening.whiten(table(spark, rows).repartition(5), "vec_id", "embedding").collect()
    check_whitening(found, list(range(340)), vectors, 16)


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    found = registry.QUERIES["op11_whitening"](spark, SF).collect()
    check_whitening(found, [r.vec_id for r in rows], [list(map(float, r.embedding)) for r in rows], 16)


def test_whitening_of_few_and_odd_rows(spark):
    few = [(i, [float(i), float(i * i % 5), 1.0, 0.0], 1) for i in range(4)]
    found = whitening.whiten(table(spark, few + [(None, [9.0, 1.0, 1.0, 0.0], 1), (2, few[2][1], 7)]), "vec_id", "embedding").collect()
    # two dimensions vary, so there are two components, for the repeated row and that without an id too
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == sorted([(False, i, c) for i in (0, 1, 2, 2, 3) for c in (1, 2)] + [(True, 0, 1), (True, 0, 2)])
    assert found[0].n == 5 and found[0].identity_error < 1e-9 and sum({r.component: r.explained for r in found}.values()) == pytest.approx(1)
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]):
        assert whitening.whiten(table(spark, rows), "vec_id", "embedding").collect() == []
    # entries beyond what doubles count stay at their limit, a deviation beyond a long is null
    wide = whitening.whiten(table(spark, [(i, [1e300 * (i % 2), float(i)], 1) for i in range(6)]), "vec_id", "embedding").collect()
    assert {r.deviation for r in wide} == {None} and {r.component for r in wide} == {1}


@pytest.mark.parametrize("dims, k", [(200, 16), (90, 5), (6, 16)])
def test_lobpcg_is_certified(dims, k):
    rng, calls = np.random.default_rng(dims), []
    q = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    a = q @ np.diag(np.linspace(9, 1, dims) ** 2) @ q.T

    def times(block):
        calls.append(block.shape[1])
        return a @ block

    value, u = whitening.lobpcg(times, dims, min(k, dims))
    assert np.allclose(value, np.linspace(9, 1, dims)[:k] ** 2, rtol=1e-12)
    assert np.linalg.norm(a @ u - u * value, axis=0).max() <= 1e-10 * value[0]
    assert max(calls) <= 3 * (k + whitening.GUARD) and len(calls) < 200


def plain_codes(rows, parts, entries, rounds):
    """By full scans: (code, error) by row, and the codebooks."""
    x = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    width = len(x[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(x[i], p) for i in order[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in x:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in x]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("entries, scale", [(64, 0.05), (8, 0.02), (200, 3.0)])
def test_codes_equal_plain_scans(spark, entries, scale):
    rng = np.random.default_rng(entries)
    # few different values, so that ties are common, and negative ones
    rows = [(int(i), (np.round(rng.normal(size=12) * scale, 2)).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(150)]
    rows += [rows[3], (None, rows[5][1], 2), rows[3]]
    odd = [(500, None, 1), (501, [None] * 12, 1), (502, [math.nan] * 12, None), (503, [1.0] * 8, 1), (504, [], 1)]
    found, books = codes.compress(table(spark, rows + odd).repartition(4), "vec_id", "embedding", "label", parts=3, entries=entries)
    want, plain = plain_codes(rows, 3, entries, 2)
    assert books.tolist() == plain
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((i, label, code, error) for (i, _, label), (code, error) in zip(rows, want)), key=key)


def test_codes_query(spark):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, books = plain_codes(rows, 16, 64, 2)
    said = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    sums = {}
    for (_, _, label), (_, error) in zip(rows, want):
        sums[label] = sums.get(label, 0) + error
    found = registry.QUERIES["op13_vector_codes"](spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted((i, code, error, sums[label], said) for (i, _, label), (code, error) in zip(rows, want))


def test_codes_of_odd_tables(spark):
    found, books = codes.compress(table(spark, []), "vec_id", "embedding", "label")
    assert found.collect() == [] and books.size == 0 and len(codes.books_sha256(books)) == 64
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(table(spark, [(1, [1.0] * 5, 1)]), "vec_id", "embedding", "label")
    # numbers whose squares need more than 64 bits
    wide = [(i, [3e6 * i, -2e6 * i, 0.5, 1.0], 1) for i in range(6)]
    found, books = codes.compress(table(spark, wide), "vec_id", "embedding", "label", parts=2, entries=3)
    want, plain = plain_codes(wide, 2, 3, 2)
    assert books.tolist() == plain and [tuple(r)[2:] for r in sorted(found.collect())] == want
    far, _ = codes.compress(table(spark, [(0, [0.0, 0.0], 1), (1, [1e300, 0.0], 1)]), "vec_id", "embedding", "label", parts=1, entries=1, rounds=0)
    assert [(r.code, r.error) for r in sorted(far.collect())] == [("00", 0), ("00", None)]


@pytest.mark.parametrize("seed", range(6))
def test_tree_keeps_ties(seed):
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-3, 4, (64, 3)), rng.integers(-5, 6, (500, 3))
    index, d = codes.KdTree(entries, leaf=1 + seed).nearest(points)
    full = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (d == full.min(1)).all()
