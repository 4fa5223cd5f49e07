"""Property tests (hypothesis) for the index and the least-squares solve."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trendlens.functions.linalg import pack, solve_moments
from trendlens.operators.index import kfold, stable_index
from trendlens.sources import load


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60))
def test_stable_index_is_a_permutation_in_key_order(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, v int")
    idx, n = stable_index(df, ["k"], num_partitions=4)
    rows = sorted((r.row_idx, r.k) for r in idx.collect())
    assert n == len(keys)
    assert [r for r, _ in rows] == list(range(len(keys)))
    assert [k for _, k in rows] == sorted(keys)  # heavy duplicates still index contiguously


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=5, max_value=40), st.integers(min_value=2, max_value=7))
def test_kfold_sizes(spark, n, k):
    df = spark.createDataFrame([(i,) for i in range(n)], "id int")
    sizes = [0] * k
    for r in kfold(df, ["id"], k=k).collect():
        sizes[r.fold] += 1
    q, rem = divmod(n, k)
    assert sizes == [q + 1] * rem + [q] * (k - rem)


@settings(max_examples=40, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.integers(min_value=1, max_value=6))
def test_solve_matches_lstsq(seed, p):
    rng = np.random.default_rng(seed)
    n = p + 5 + int(rng.integers(0, 50))
    x = rng.normal(size=(n, p)) * rng.uniform(0.1, 100, size=p)
    y = rng.normal(size=n) * 10 + x @ rng.normal(size=p)
    z = np.column_stack([np.ones(n), x, y])
    s = solve_moments(pack(z.T @ z), p + 2, n)
    beta = np.linalg.lstsq(z[:, :-1], y, rcond=None)[0]
    assert np.allclose(s["coef"], beta, rtol=1e-6, atol=1e-6 * np.abs(beta).max())


def test_jdbc_reader_is_configured_not_run(spark):
    r = load.jdbc_reader(spark, "jdbc:postgresql://db.invalid/x", "SELECT 1 AS a", user="u", password="p",
                         partition_column="a", lower=0, upper=10, num_partitions=4)
    assert type(r).__name__ == "DataFrameReader"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=2, max_value=4), min_size=1, max_size=3),
       st.integers(min_value=0, max_value=2), st.integers(min_value=0, max_value=999))
def test_contrast_coding_is_full_rank_on_factorial_data(spark, level_counts, n_num, seed):
    import itertools

    from trendlens.operators import interact

    cats = [f"c{i}" for i in range(len(level_counts))]
    nums = [f"x{i}" for i in range(n_num)]
    levels = {c: [f"{c}_{j}" for j in range(k)] for c, k in zip(cats, level_counts)}
    rng = np.random.default_rng(seed)
    cells = list(itertools.product(*[levels[c] for c in cats]))
    reps = 3 * (2 ** n_num) + 2
    rows = [dict(zip(cats, cell)) | {x: float(rng.normal()) for x in nums} for cell in cells for _ in range(reps)]
    for d in range(1, len(cats) + n_num + 1):
        cols = interact.design(cats, nums, levels, d)
        mat = np.array([[np.prod([(r[f] == lv) if lv is not None else r[f] for f, lv in c.spec]) for c in cols[1:]]
                        for r in rows], dtype=float).reshape(len(rows), -1)
        mat = np.column_stack([np.ones(len(rows)), mat])
        assert np.linalg.matrix_rank(mat) == mat.shape[1], (level_counts, n_num, d)
        # same span as the over-parameterised design (all level combinations of every d-way term)
        over = [np.ones(len(rows))]
        for term in itertools.combinations(cats + nums, d):
            tc = [f for f in term if f in levels]
            tn = [f for f in term if f not in levels]
            for combo in itertools.product(*[levels[f] for f in tc]):
                over.append(np.array([np.prod([r[f] == v for f, v in zip(tc, combo)] + [r[x] for x in tn])
                                      for r in rows], dtype=float))
        over = np.column_stack(over)
        r_over = np.linalg.matrix_rank(over)
        assert np.linalg.matrix_rank(mat) == r_over
        assert np.linalg.matrix_rank(np.column_stack([mat, over])) == r_over
