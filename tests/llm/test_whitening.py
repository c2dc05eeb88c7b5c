import numpy as np
import pytest

from attestra.llm import whitening
from attestra.llm.whitening import integer_rows, lobpcg, tree_sum, whiten

ROW = "vec_id long, embedding array<float>, n string"


def by_hand(vectors, components):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    return np.square(n * x - sums).sum(axis=1), centred @ found / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(rows, vectors, components):
    k = min(components, len(vectors[0]))
    deviation, white, explained = by_hand(vectors, components)
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"], r["n"]) for r in rows] == [(i, c, len(vectors)) for i in range(len(vectors)) for c in range(1, k + 1)]
    assert [r["deviation"] for r in rows[::k]] == deviation.tolist()
    got = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8
    assert np.abs(np.array([r["explained"] for r in rows[:k]]) - explained).max() < 1e-12
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8 and rows[0]["residual"] <= 1e-10


@pytest.mark.parametrize("n, d, components, parts", [(300, 7, 32, 3), (400, 60, 32, 4), (500, 90, 4, 40)])
def test_equal_to_the_eigenvectors_of_the_covariance(spark, n, d, components, parts):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * rng.uniform(0.5, 4, d)).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], ROW).repartition(parts)
    check(whiten(df, components).collect(), vectors, components)


def test_odd_rows_play_no_part(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((50, 3)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)] + [(100 + i, v, "x") for i, v in enumerate(bad)], ROW)
    check(whiten(df).collect(), vectors, 32)


def test_repeated_rows_and_null_ids_stay_apart(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((20, 2)).astype(np.float32).tolist()
    rows = whiten(spark.createDataFrame([(None, v, "x") for v in vectors * 2], ROW)).collect()
    assert len(rows) == 80 and {r["n"] for r in rows} == {40} and {r["vec_id"] for r in rows} == {None}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], "x")], [(k, [1.0, 2.0], "x") for k in range(9)], [(1, None, "x")]])
def test_no_variance_no_result(spark, rows):
    out = whiten(spark.createDataFrame(rows, ROW))
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_a_dimension_without_variance_has_no_component(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x), 5.0, float(y)], "x") for k, (x, y) in enumerate(rng.standard_normal((60, 2)))]
    got = whiten(spark.createDataFrame(rows, ROW)).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-8


def test_what_cannot_be_summed_is_an_error(spark):
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [1.0], "x"), (2, [1.0, 2.0], "x")], ROW)).collect()
    with pytest.raises(Exception, match="exactly"):
        whiten(spark.createDataFrame([(1, [1e30], "x"), (2, [1.0], "x")], ROW)).collect()


def test_exact_beyond_longs():
    x = np.array([[2**40, 5]], dtype=np.int64)
    n = 2**40
    assert whitening.times_n_less_sums(x, n, (7, 2**70)).tolist() == [[2**80 - 7, 5 * n - 2**70]]


def test_a_deviation_that_a_long_cannot_hold_is_null(spark):
    far = float(2**33)
    rows = whiten(spark.createDataFrame([(1, [far], "x"), (2, [-far], "x"), (3, [0.0], "x")], ROW)).collect()
    assert {r["vec_id"]: r["deviation"] for r in rows} == {1: None, 2: None, 3: 0}


@pytest.mark.parametrize("d, k", [(1, 1), (5, 5), (120, 10), (300, 32)])
def test_rounds_of_a_wide_operator(d, k):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(rng.gamma(1, 1, d))[::-1]
    matrix, uses = turn * values @ turn.T, []
    found, vectors, residual, rounds = lobpcg(lambda b: uses.append(b.shape[1]) or matrix @ b, d, k)
    assert np.abs(found - values[:k]).max() < 1e-12 * values[0] and residual <= 1e-10
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-9 and len(uses) <= rounds + 3 and max(uses) <= k + whitening.GUARD


def test_equal_eigenvalues_and_a_zero_operator():
    values, vectors, _, _ = lobpcg(lambda b: 2.0 * b, 30, 4)
    assert np.allclose(values, 2) and np.allclose(vectors.T @ vectors, np.eye(4))
    assert np.allclose(lobpcg(lambda b: 0.0 * b, 6, 2)[0], 0)


def test_sums_in_a_tree(spark):
    parts = spark.range(100, numPartitions=3).selectExpr("cast(id as int) task", "cast(null as binary) total").drop("total")
    rows = [(k, np.array([k, 1.0]).tobytes()) for k in range(100)]
    assert tree_sum(spark.createDataFrame(rows, "task int, total binary"), 100, (2,)).tolist() == [4950.0, 100.0] and parts.count() == 100
    assert tree_sum(spark.createDataFrame([], "task int, total binary"), 40, (2,)) is None


def test_integer_rows_floor():
    import pyarrow as pa

    places, x = integer_rows(pa.array([[-0.01, 0.5], None, [1.0, 2.0]], pa.list_(pa.float64())), 64, 10)
    assert places.tolist() == [0, 2] and x.tolist() == [[9, 42], [74, 138]]
