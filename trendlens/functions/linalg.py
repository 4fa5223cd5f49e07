"""Small dense linear algebra on moment matrices (runs inside tasks).

A moment vector ``g`` holds the upper triangle, row-major, of
``sum(w * z z^T)`` with ``z = (1, x_1..x_p, y)``; its last extra element is
the unweighted row count.  Everything here is O(p^3) on a p x p matrix and
never sees rows.
"""

from __future__ import annotations

import math

import numpy as np

from trendlens.functions.tdist import t_ppf, t_sf2

RANK_TOL = 1e-10


def tri_len(k: int) -> int:
    return k * (k + 1) // 2


def tri_pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def unpack(g, k: int) -> np.ndarray:
    g = np.asarray(g, dtype=float)
    m = np.zeros((k, k))
    iu = np.triu_indices(k)
    m[iu] = g[: tri_len(k)]
    m = m + np.triu(m, 1).T
    return m


def pack(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(m.shape[0])]


def solve_centred(a: np.ndarray, raw_diag: np.ndarray, rank_tol: float = RANK_TOL):
    """Generalised inverse of a centred moment matrix, and a basis of its null
    space.  Rank is decided on the equilibrated matrix (scale-free); a column
    whose spread is lost in its own round-off counts as constant."""
    k = a.shape[0]
    if k == 0:
        return a.copy(), np.zeros((0, 0))
    var = np.diag(a)
    flat = var <= 1e-13 * np.maximum(raw_diag, 0.0)
    d = np.sqrt(np.where(flat, 1.0, var))
    s = np.where(flat[:, None] | flat[None, :], 0.0, a / np.outer(d, d))
    w, v = np.linalg.eigh(s)
    keep = w > max(w.max(), 0.0) * rank_tol
    u = v / d[:, None]
    return (u[:, keep] / w[keep]) @ u[:, keep].T, u[:, ~keep]


def solve_moments(g, k: int, n: float, *, alpha: float = 0.05, shift=None):
    """Least squares from a moment matrix over (1, x_1..x_p, y).

    Columns may have been shifted by ``shift`` (p + 1 numbers, near their
    means) before the moments were summed; the moments are centred here, so
    large means cost no precision.  A deficient system gets the minimum-norm
    solution in the unshifted columns.  Returns a dict with coefficient arrays
    (coef, std_err, t, p, ci_lo, ci_hi) aligned to (Intercept, x_1..x_p) and
    fit statistics.
    """
    n = float(round(n))  # merged partial counts carry float round-off
    m = unpack(g, k)
    shift = np.zeros(k - 1) if shift is None else np.asarray(shift, dtype=float)
    sw = m[0, 0]
    mean = m[0, 1:] / sw if sw > 0 else np.zeros(k - 1)
    c = m[1:, 1:] - np.outer(m[0, 1:], mean)
    a, b, tss = c[:-1, :-1], c[:-1, -1], max(c[-1, -1], 0.0)
    inv, null = solve_centred(a, np.diag(m)[1:-1])
    slopes = inv @ b
    return _about_origin(slopes, inv, null, mean + shift, sw, n, max(tss - slopes @ b, 0.0), tss, alpha)


def solve_triangle(r: np.ndarray, n: float, *, alpha: float = 0.05):
    """Least squares from the triangular factor of rows ``sqrt(w) (1, x_1..x_p, y)``.

    Below its first row the factor is that of the centred columns, and its
    singular values are theirs, not their squares, so columns that agree in
    their first ten digits are still told apart.  Result as ``solve_moments``.
    """
    n = float(round(n))
    k = r.shape[0]
    sw = r[0, 0] ** 2
    centre = r[0, 1:] / r[0, 0] if sw > 0 else np.zeros(k - 1)
    x, y = r[1:, 1:-1], r[1:, -1]
    size = np.sqrt((x * x).sum(axis=0))
    flat = size <= 1e-13 * np.sqrt((r[:, 1:-1] ** 2).sum(axis=0))
    d = np.where(flat, 1.0, size)
    u, sv, vt = np.linalg.svd(np.where(flat, 0.0, x / d), full_matrices=False)
    keep = sv > max(sv.max(initial=0.0) * 1e-12, 0.0)
    v = vt.T / d[:, None]
    fitted = u[:, keep].T @ y
    slopes = v[:, keep] @ (fitted / sv[keep])
    inv = (v[:, keep] / sv[keep] ** 2) @ v[:, keep].T
    rest = y - u[:, keep] @ fitted
    return _about_origin(slopes, inv, v[:, ~keep], centre, sw, n, float(rest @ rest), float(y @ y), alpha)


def _about_origin(slopes, inv, null, centre, sw, n, rss, tss, alpha) -> dict:
    """Coefficients and inference in the raw columns from a centred solution."""
    k = len(centre)
    x, y = centre[:-1], centre[-1]
    beta = np.concatenate([[y - slopes @ x], slopes])
    full = np.empty((k, k))
    full[0, 0] = (1.0 / sw if sw > 0 else 0.0) + x @ inv @ x
    full[0, 1:] = full[1:, 0] = -inv @ x
    full[1:, 1:] = inv
    if null.size:
        basis = np.linalg.qr(np.vstack([-x @ null, null]))[0]
        project = np.eye(k) - basis @ basis.T
        beta, full = project @ beta, project @ full @ project
    rank = k - null.shape[1] if sw > 0 else 0
    return inference(beta, np.diag(full), n, rank, rss, tss, alpha)


def inference(beta, unscaled, n: float, rank: int, rss: float, tss: float, alpha: float = 0.05) -> dict:
    """Standard errors, t, p and limits from coefficients and the diagonal of
    the unscaled covariance, with fit statistics."""
    df_resid = n - rank
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    se = np.sqrt(np.clip(unscaled * sigma2, 0.0, None)) if df_resid > 0 else np.full(len(beta), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        tval = np.where(se > 0, beta / se, np.nan)
    pval = np.array([t_sf2(float(t), df_resid) if np.isfinite(t) else float("nan") for t in tval])
    crit = t_ppf(1.0 - alpha / 2.0, df_resid) if df_resid > 0 else float("nan")
    r2 = 1.0 - rss / tss if tss > 0 else float("nan")
    return {
        "coef": beta, "std_err": se, "t": tval, "p": pval,
        "ci_lo": beta - crit * se, "ci_hi": beta + crit * se,
        "n": n, "rank": rank, "df_resid": df_resid, "rss": rss, "tss": tss,
        "r2": r2, "sigma2": sigma2,
    }


def fold_score(beta: np.ndarray, g_fold, k: int, shift=None) -> tuple[float, float, float]:
    """SSE, SST, n-weight of a held-out fold from its own moment matrix."""
    m = unpack(g_fold, k)
    if shift is not None:  # the same line over shifted columns
        beta = np.concatenate([[beta[0] + beta[1:] @ shift[:-1] - shift[-1]], beta[1:]])
    a, b, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    sw, sy = m[0, 0], m[0, -1]
    sse = yy - 2.0 * beta @ b + beta @ a @ beta
    sst = yy - sy * sy / sw if sw > 0 else float("nan")
    return float(sse), float(sst), float(sw)


def gauss_legendre_01(q: int):
    """Nodes and weights of q-point Gauss-Legendre on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(max(q, 1))
    return (x + 1.0) / 2.0, w / 2.0


def isfinite(x) -> bool:
    return x is not None and not (isinstance(x, float) and math.isnan(x))
