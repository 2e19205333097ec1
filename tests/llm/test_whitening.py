"""Whitening against a dense eigendecomposition and exact integers."""

import math

import numpy as np
import pytest

from bazaarlens.llm import whitening
from bazaarlens.llm.queries import op11_whitening
from conftest import DATA

SCHEMA = "vec_id long, vector array<float>"


def _plainly(vectors, components=16):
    """vec_id -> rows by numpy; vectors: (id, list)."""
    used = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in used], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums).astype(float)) / n
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    kept = e > 1e-12 * e[0]
    e, axes = e[kept], axes[:, kept]
    own = (x * n - sums).astype(float) / n
    return (
        [i for i, _ in used], n, [int(sum(d * d for d in row)) for row in (x * n - sums).tolist()],
        own @ axes / np.sqrt(e), e / np.trace(cov), e,
    )


def _agrees(rows, vectors, tolerance=1e-7):
    ids, n, deviations, white, explained, e = _plainly(vectors)
    k = len(e)
    assert len(rows) == len(ids) * k
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    table = np.array([[by_id[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < tolerance * max(1, np.abs(white).max())
    for i, d in zip(ids, deviations):
        assert set(by_id[i]) == set(range(1, k + 1))
        for c in range(k):
            r = by_id[i][c + 1]
            assert (r["n"], r["deviation"]) == (n, d)
            assert abs(r["explained"] / explained[c] - 1) < 1e-9
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_table(spark):
    folder = f"{DATA}/sf0.001"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    _agrees(op11_whitening(spark, folder).collect(), vectors)


@pytest.mark.parametrize("dims", [1, 3, 40])
def test_odd_rows(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = [(i, rng.normal(0, 1 + np.arange(dims)).astype(np.float32).tolist()) for i in range(200)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(50)]  # repeated vectors count once in the fit
    odd = [(2000, None), (2001, []), (2002, [math.nan] * dims), (2003, [math.inf] + [0.0] * (dims - 1)), (2004, [None] * dims)]
    odd += [(2005, [0.5] * (dims + 1))]
    df = spark.createDataFrame(vectors + odd, SCHEMA).withColumnRenamed("vec_id", "n")
    rows = whitening.whiten(df.withColumnRenamed("n", "vec_id"), "vec_id").collect()
    _agrees(rows, vectors)


def test_repeated_eigenvalues_and_constant_dimensions(spark):
    """A cross polytope: all eigenvalues are equal, and one dimension never varies."""
    dims = 12
    vectors = []
    for d in range(dims):
        for s in (-1, 1):
            v = [0.0] * (dims + 1)
            v[d] = 2.0 * s
            vectors.append((len(vectors), v))
    rows = whitening.whiten(spark.createDataFrame(vectors, SCHEMA), "vec_id").collect()
    assert len(rows) == len(vectors) * dims
    table = np.zeros((len(vectors), dims))
    for r in rows:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - 1 / dims) < 1e-12
    assert np.abs(table.T @ table / len(vectors) - np.eye(dims)).max() < 1e-12


def test_ill_conditioned(spark):
    rng = np.random.default_rng(9)
    spread = 10.0 ** np.linspace(3, -1, 20)
    turn = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    made = (rng.normal(size=(400, 20)) * spread @ turn).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(made)]
    _agrees(whitening.whiten(spark.createDataFrame(vectors, SCHEMA), "vec_id").collect(), vectors, 1e-6)


def test_nothing_varies(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA), "vec_id").count() == 0
    same = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None)], SCHEMA)
    assert whitening.whiten(same, "vec_id").count() == 0


def test_deviation_past_a_long():
    block = np.array([[0, 0], [3 * 10**9, 1]])
    got = whitening._deviation(block, 1, np.array([0, 0])).to_pylist()
    assert got == [0, 9 * 10**18 + 1]
    assert whitening._deviation(block, 2, np.array([0, 0])).to_pylist() == [0, None]
