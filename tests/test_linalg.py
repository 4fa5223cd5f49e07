import math

import numpy as np

from trendlens.functions.linalg import pack, solve_moments
from trendlens.functions.tdist import t_ppf, t_sf2


def _moments(x, y, w=None):
    n = len(y)
    w = np.ones(n) if w is None else w
    z = np.column_stack([np.ones(n), x, y])
    return pack((z * w[:, None]).T @ z), z.shape[1]


def test_t_distribution_known_values():
    assert abs(t_sf2(2.228, 10) - 0.05) < 1e-3
    assert abs(t_sf2(1.959964, 1e7) - 0.05) < 1e-6
    assert abs(t_ppf(0.975, 10) - 2.228138851986) < 1e-9
    assert abs(t_sf2(0.0, 5) - 1.0) < 1e-12
    assert t_sf2(float("inf"), 3) == 0.0


def test_solve_matches_lstsq_and_textbook_se():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = 1.5 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(size=200)
    g, k = _moments(x, y)
    s = solve_moments(g, k, 200)
    xd = np.column_stack([np.ones(200), x])
    beta, *_ = np.linalg.lstsq(xd, y, rcond=None)
    assert np.allclose(s["coef"], beta, atol=1e-10)
    resid = y - xd @ beta
    sigma2 = resid @ resid / (200 - 4)
    se = np.sqrt(np.diag(np.linalg.inv(xd.T @ xd)) * sigma2)
    assert np.allclose(s["std_err"], se, rtol=1e-9)
    assert s["rank"] == 4 and s["df_resid"] == 196
    r2 = 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))
    assert math.isclose(s["r2"], r2, rel_tol=1e-10)


def test_rank_deficient_min_norm():
    rng = np.random.default_rng(1)
    a = rng.normal(size=50)
    x = np.column_stack([a, a])  # duplicate column
    y = 3 * a + rng.normal(size=50)
    g, k = _moments(x, y)
    s = solve_moments(g, k, 50)
    xd = np.column_stack([np.ones(50), x])
    beta = np.linalg.pinv(xd) @ y
    assert s["rank"] == 2 and s["df_resid"] == 48
    assert np.allclose(s["coef"], beta, atol=1e-8)


def test_weighted_r2_is_weighted_centred():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 1))
    y = 2 * x[:, 0] + rng.normal(size=100)
    w = rng.uniform(0.5, 2.0, size=100)
    g, k = _moments(x, y, w)
    s = solve_moments(g, k, 100)
    xd = np.column_stack([np.ones(100), x])
    sw = np.sqrt(w)
    beta, *_ = np.linalg.lstsq(xd * sw[:, None], y * sw, rcond=None)
    assert np.allclose(s["coef"], beta, atol=1e-10)
    ybar = np.average(y, weights=w)
    r2 = 1 - (w * (y - xd @ beta) ** 2).sum() / (w * (y - ybar) ** 2).sum()
    assert math.isclose(s["r2"], r2, rel_tol=1e-10)


def test_large_mean_column_keeps_its_slope():
    x = 1.7e9 + np.arange(10007.0)
    y = 3.0 + 2e-4 * (x - 1.7e9)
    shift = np.array([x.mean(), y.mean()])
    z = np.column_stack([np.ones(len(x)), x - shift[0], y - shift[1]])
    s = solve_moments(pack(z.T @ z), 3, len(x), shift=shift)
    assert s["rank"] == 2 and math.isclose(s["coef"][1], 2e-4, rel_tol=1e-9) and s["r2"] > 1 - 1e-9


def test_t_tail_at_huge_df():
    assert abs(t_sf2(1.0, 1e13) - 0.31731050786) < 1e-9
    assert abs(t_sf2(1.0, 2e7) - t_sf2(1.0, 9e6)) < 1e-7
