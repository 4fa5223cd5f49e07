"""DuckDB oracle SQL for the registered queries (same column names, same
rounding).  Regression oracles use closed forms (regr_* aggregates, centred
2x2 solves, cell-mean contrasts), not the engine's own algebra."""

from __future__ import annotations

L_CTE = """L AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax,
                 l_extendedprice, o_orderpriority,
                 l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LN_CTE = L_CTE + """,
LN AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity,
              nullif(l_discount, CAST(0.0 AS DOUBLE)) AS l_discount, l_tax, l_extendedprice, o_orderpriority, net FROM L)"""

_STR = ["l_returnflag", "l_linestatus", "o_orderpriority"]
_DBL = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "net"]
PRESENT = " AND ".join([f"{c} IS NOT NULL" for c in _STR]
                       + [f"({c} IS NOT NULL AND NOT isnan({c}))" for c in _DBL])

# large-df Student t critical value for alpha = 0.05 (Cornish-Fisher, 2 terms)
Z975 = "1.959963984540054e0"


def _tcrit(df: str) -> str:
    z = Z975
    return (f"({z} + (power({z},3) + {z}) / (4.0 * ({df})) "
            f"+ (5*power({z},5) + 16*power({z},3) + 3*{z}) / (96.0 * power({df}, 2)))")


def _simple_coef_rows(target: str, feat: str, src: str, by: str | None = None) -> str:
    """Intercept + slope rows of a one-feature OLS with SE and t."""
    sel_by = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""s AS (SELECT {sel_by}regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n,
                   regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_avgx(y, x) AS xbar
            FROM {src} {grp}),
e AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s),
f AS (SELECT *, sqrt(s2 * (1.0 / n + xbar * xbar / sxx)) AS se_a, sqrt(s2 / sxx) AS se_b FROM e)
SELECT {sel_by}'{target}' AS target, 'Intercept' AS term, round(a, 4) AS coef, round(se_a, 4) AS std_err,
       round(a / se_a, 6) AS t FROM f
UNION ALL
SELECT {sel_by}'{target}' AS target, '{feat}' AS term, round(b, 4) AS coef, round(se_b, 4) AS std_err,
       round(b / se_b, 6) AS t FROM f"""


def _two_feature_cte(src: str, x1: str, x2: str, y: str) -> str:
    return f"""m AS (SELECT avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, count(*) AS n FROM {src}),
c AS (SELECT sum(({x1}-m1)*({x1}-m1)) AS s11, sum(({x2}-m2)*({x2}-m2)) AS s22,
             sum(({x1}-m1)*({x2}-m2)) AS s12, sum(({x1}-m1)*({y}-my)) AS s1y,
             sum(({x2}-m2)*({y}-my)) AS s2y, sum(({y}-my)*({y}-my)) AS syy FROM {src}, m),
f AS (SELECT *, s11*s22 - s12*s12 AS det FROM c, m),
g AS (SELECT *, (s22*s1y - s12*s2y)/det AS b1, (s11*s2y - s12*s1y)/det AS b2 FROM f),
h AS (SELECT *, my - b1*m1 - b2*m2 AS a, (syy - b1*s1y - b2*s2y)/(n-3) AS s2 FROM g)"""


_BANDS = """,
LB AS (SELECT *, 'd' || CAST(CAST(floor(round(l_discount * 100) / 4) AS INTEGER) AS VARCHAR) AS disc_band FROM L)"""


def _d2_cte(b: str = "o_orderpriority", frame: str = "L") -> str:
    """Coefficients of net ~ 1 + l_returnflag:b from cell means of ``frame``."""
    return L_CTE + _BANDS + f""",
w AS (SELECT l_returnflag AS a, {b} AS b, net,
             avg(net) OVER (PARTITION BY l_returnflag, {b}) AS cm FROM {frame}),
cell AS (SELECT a, b, count(*) AS n, avg(net) AS m FROM w GROUP BY a, b),
sig AS (SELECT sum(power(net - cm, 2)) / (count(*) - (SELECT count(*) FROM cell)) AS s2,
               count(*) - (SELECT count(*) FROM cell) AS dfr FROM w),
r AS (SELECT (SELECT min(a) FROM cell) AS a1, (SELECT min(b) FROM cell) AS b1),
base AS (SELECT c.n AS n11, c.m AS m11 FROM cell c, r WHERE c.a = r.a1 AND c.b = r.b1),
co AS (
  SELECT 'Intercept' AS term, 'Intercept' AS label, 'i' AS kind, m11 AS coef, sqrt(s2 / n11) AS se
  FROM base, sig
  UNION ALL
  SELECT 'C(Q("{b}"))[T.' || c.b || ']', '{b} = ' || c.b, 'b',
         c.m - base.m11, sqrt(s2 * (1.0 / c.n + 1.0 / base.n11))
  FROM cell c, r, base, sig WHERE c.a = r.a1 AND c.b <> r.b1
  UNION ALL
  SELECT 'C(Q("l_returnflag"))[T.' || c.a || ']:C(Q("{b}"))[' || c.b || ']',
         'l_returnflag = ' || c.a || ' × {b} = ' || c.b, 'ab',
         c.m - c1.m, sqrt(s2 * (1.0 / c.n + 1.0 / c1.n))
  FROM cell c, r, sig, cell c1 WHERE c.a <> r.a1 AND c1.a = r.a1 AND c1.b = c.b),
crit AS (SELECT """ + _tcrit("dfr") + """ AS tc FROM sig)"""


def _num_d1_cte() -> str:
    """Coefficients of net ~ 1 + l_discount + l_tax (the depth-1 interaction
    model of two numeric inputs) from the centred 2x2 closed form."""
    return (L_CTE + ",\n" + _two_feature_cte("L", "l_discount", "l_tax", "net") + """,
co AS (SELECT 'Intercept' AS term, 'Intercept' AS label, a AS coef,
              sqrt(s2 * (1.0/n + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det)) AS se FROM h
       UNION ALL SELECT 'Q("l_discount")', 'l_discount', b1, sqrt(s2*s22/det) FROM h
       UNION ALL SELECT 'Q("l_tax")', 'l_tax', b2, sqrt(s2*s11/det) FROM h),
crit AS (SELECT """ + _tcrit("(SELECT n - 3 FROM h)") + """ AS tc)""")


def _corr_sql() -> str:
    cols = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(1.0 AS DOUBLE) AS r")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS r FROM L")
    return "WITH " + L_CTE + "\n" + "\nUNION ALL ".join(parts)


def _skew_sql() -> str:
    cols = ["value", "user_id", "event_id"]
    mean = ", ".join(f"avg({c}) AS m_{c}" for c in cols)
    mom = ", ".join(f"avg(power({c} - m_{c}, 2)) AS v2_{c}, avg(power({c} - m_{c}, 3)) AS v3_{c}" for c in cols)
    parts = [f"SELECT {i} AS ord, '{c}' AS column, round(v3_{c} / power(v2_{c}, 1.5), 8) AS skew, "
             f"coalesce(abs(v3_{c} / power(v2_{c}, 1.5)) > 1.0, false) AS flagged FROM mo"
             for i, c in enumerate(cols)]
    return (f"WITH mm AS (SELECT {mean} FROM events), mo AS (SELECT {mom} FROM events, mm)\n"
            + "\nUNION ALL ".join(parts))


def _slope_p_cte(by: str) -> str:
    """Two-sided p of each group's slope: Simpson's rule over the density of
    Student's t between 0 and |t| (2000 panels)."""
    return f"""s AS (SELECT {by}, regr_slope(p_retailprice, p_size) AS b, regr_sxx(p_retailprice, p_size) AS sxx,
             regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy,
             CAST(count(*) - 2 AS DOUBLE) AS dfr FROM part GROUP BY {by}),
e AS (SELECT *, sqrt((syy - b * sxy) / dfr / sxx) AS se FROM s),
a AS (SELECT *, abs(b / se) AS t, exp(lgamma((dfr + 1) / 2) - lgamma(dfr / 2)) / sqrt(dfr * pi()) AS c FROM e),
w AS (SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS wt FROM range(2001) r(i)),
pv AS (SELECT {by}, any_value(b) AS b, any_value(se) AS se, any_value(dfr) AS dfr,
              1 - 2 * any_value(t) / 2000 / 3 * sum(wt * c * power(1 + power(t * i / 2000, 2) / dfr, -(dfr + 1) / 2)) AS p
       FROM a, w GROUP BY {by})"""


def _tcrit4(df: str) -> str:
    z = Z975
    return (_tcrit(df)[:-1]
            + f" + (3*power({z},7) + 19*power({z},5) + 17*power({z},3) - 15*{z}) / (384.0 * power({df}, 3))"
            + f" + (79*power({z},9) + 776*power({z},7) + 1482*power({z},5) - 1920*power({z},3) - 945*{z})"
            + f" / (92160.0 * power({df}, 4)))")


# eigenvalues and signed unit eigenvectors of the covariance of two columns
_PCA_TWO = """z AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b FROM L),
cv AS (SELECT var_samp(a) AS s11, var_samp(b) AS s22, covar_samp(a, b) AS s12 FROM z),
ev AS (SELECT *, (s11 + s22 + sqrt(power(s11 - s22, 2) + 4 * s12 * s12)) / 2 AS l1,
              (s11 + s22 - sqrt(power(s11 - s22, 2) + 4 * s12 * s12)) / 2 AS l2 FROM cv),
un AS (SELECT (l1 - s22) / sqrt(power(l1 - s22, 2) + s12 * s12) AS u, s12 / sqrt(power(l1 - s22, 2) + s12 * s12) AS v FROM ev),
lo AS (SELECT 1 AS pc, 'quantity' AS feature, u * CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END AS loading FROM un
       UNION ALL SELECT 1, 'price', v * CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END FROM un
       UNION ALL SELECT 2, 'quantity', -v * CASE WHEN abs(v) > abs(u) THEN sign(-v) ELSE sign(u) END FROM un
       UNION ALL SELECT 2, 'price', u * CASE WHEN abs(v) > abs(u) THEN sign(-v) ELSE sign(u) END FROM un)"""

# the best single split of price over p_size and is_large, and its two means
_STUMP_D = """d AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x1, CAST(p_type = 'LARGE' AS DOUBLE) AS x2,
                  CAST(p_retailprice AS DOUBLE) AS y FROM part)"""
_STUMP = _STUMP_D + """,
lg AS (SELECT 'p_size' AS feature, x1 AS v, y - (SELECT avg(y) FROM d) AS e FROM d
       UNION ALL SELECT 'is_large', x2, y - (SELECT avg(y) FROM d) FROM d),
gr AS (SELECT feature, v, count(*) AS n, sum(e) AS s FROM lg GROUP BY feature, v),
cu AS (SELECT feature, v, lead(v) OVER w AS nxt, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
              sum(n) OVER (PARTITION BY feature) AS nt, sum(s) OVER (PARTITION BY feature) AS st
       FROM gr WINDOW w AS (PARTITION BY feature ORDER BY v)),
sp AS (SELECT feature AS sf, (v + nxt) / 2 AS thr, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain
       FROM cu WHERE nxt IS NOT NULL ORDER BY gain DESC LIMIT 1),
sd AS (SELECT d.*, CASE WHEN sf = 'p_size' THEN x1 ELSE x2 END <= thr AS lft FROM d, sp),
lv AS (SELECT avg(y) FILTER (WHERE lft) AS ml, avg(y) FILTER (WHERE NOT lft) AS mr,
              avg(CAST(lft AS DOUBLE)) AS pl, avg(y) AS base FROM sd),
ft AS (SELECT * FROM (VALUES ('p_size'), ('is_large')) t(feature)),
ph AS (SELECT p_partkey, x2, feature, CASE WHEN feature <> sf THEN 0.0::DOUBLE WHEN lft THEN ml - base ELSE mr - base END AS phi
       FROM sd, sp, lv, ft)"""

_DICTIONARY = """lv AS (SELECT 0 AS c, 'p_brand' AS "column", p_brand AS level, count(*) AS n FROM part GROUP BY p_brand
       UNION ALL SELECT 1, 'p_type', p_type, count(*) FROM part GROUP BY p_type),
rf AS (SELECT *, CASE WHEN c = 0 THEN level = min(level) OVER (PARTITION BY c) ELSE level = 'LARGE' END AS is_ref FROM lv),
dict AS (SELECT "column", level, n, CASE WHEN NOT is_ref THEN sum(CASE WHEN is_ref THEN 0 ELSE 1 END) OVER (ORDER BY c, level) - 1 END::BIGINT
                AS idx, CASE WHEN NOT is_ref THEN 'cat__' || "column" || '_' || level END AS feature FROM rf)"""

_LEVELS = """d AS (SELECT CAST(l_partkey AS VARCHAR) AS part, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y
      FROM lineitem),
m AS (SELECT part, count(*) AS k, avg(x) AS mx, avg(y) AS my FROM d GROUP BY part),
c AS (SELECT sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy, count(*) AS n
      FROM d JOIN m USING (part)),
s AS (SELECT sxx, n, sxy / sxx AS b, (SELECT count(*) FROM m) AS l, (SELECT min(part) FROM m) AS ref,
             (syy - sxy * sxy / sxx) / (n - (SELECT count(*) FROM m) - 1) AS s2 FROM c)"""

ORACLES: dict[str, str] = {
    "lump_nulls": """
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_brand ELSE 'nan' END AS b FROM part),
k AS (SELECT b FROM (SELECT b, row_number() OVER (ORDER BY count(*) DESC, b ASC) AS rk FROM p GROUP BY b) WHERE rk <= 10)
SELECT p_partkey, CASE WHEN b IN (SELECT b FROM k) THEN b ELSE 'Other' END AS p_brand FROM p""",

    "yeo_johnson_lambda": """
WITH e AS (SELECT value AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
c AS (SELECT count(*) AS n, sum(sign(x) * ln(1 + abs(x))) AS sl FROM e),
g AS (SELECT CAST(i AS DOUBLE) / 10 AS lam FROM range(-30, 51) r(i)),
o AS (SELECT lam, CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + x) ELSE (power(1 + x, lam) - 1) / lam END
                       ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - lam) - 1) / (2 - lam) END END AS psi
      FROM e, g),
b AS (SELECT lam FROM o, c GROUP BY lam, n, sl ORDER BY -n / 2.0 * ln(var_pop(psi)) + (lam - 1) * sl DESC LIMIT 1),
g2 AS (SELECT round(lam + CAST(i AS DOUBLE) / 1000, 3) AS lam FROM b, range(-100, 101) r(i)),
o2 AS (SELECT lam, CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + x) ELSE (power(1 + x, lam) - 1) / lam END
                        ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - lam) - 1) / (2 - lam) END END AS psi
       FROM e, g2)
SELECT 'value' AS "column", lam AS "lambda" FROM (
  SELECT lam FROM o2, c GROUP BY lam, n, sl ORDER BY -n / 2.0 * ln(var_pop(psi)) + (lam - 1) * sl DESC LIMIT 1)""",

    "ols_inference": "WITH " + _slope_p_cte("p_type") + """
SELECT p_type, round(p, 6) AS p, round(b - se * """ + _tcrit4("dfr") + """, 4) AS ci_lo,
       round(b + se * """ + _tcrit4("dfr") + """, 4) AS ci_hi FROM pv""",

    "significance_bands": "WITH " + _slope_p_cte("p_brand") + """
SELECT p_brand, round(p, 6) AS p, CASE WHEN p < 0.05 THEN 'significant' WHEN p < 0.1 THEN 'marginal'
                                       ELSE 'not significant' END AS band FROM pv""",

    "pca_loadings": "WITH " + L_CTE + """,
""" + _PCA_TWO + """
SELECT pc, feature, round(loading, 6) AS loading FROM lo""",

    "pca_top_two": "WITH " + L_CTE + """,
""" + _PCA_TWO + """
SELECT pc, CAST(row_number() OVER (PARTITION BY pc ORDER BY abs(loading) DESC, feature) AS INTEGER) AS rank, feature,
       round(loading, 6) AS loading, round(CASE WHEN pc = 1 THEN l1 ELSE l2 END / (l1 + l2), 8) AS ratio
FROM lo, ev WHERE pc = 1 OR l1 / (l1 + l2) < 0.95""",

    "pdp_grid_percentiles": "WITH " + L_CTE + """,
v AS (SELECT 'l_extendedprice' AS feature, l_extendedprice AS x FROM L UNION ALL SELECT 'l_quantity', l_quantity FROM L),
n AS (SELECT feature, count(DISTINCT x) AS nd, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi
      FROM v GROUP BY feature),
u AS (SELECT DISTINCT feature, x FROM v)
SELECT feature, CAST(i AS INTEGER) AS point, round(lo + (hi - lo) * i / 99, 6) AS value FROM n, range(100) r(i) WHERE nd >= 100
UNION ALL
SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS INTEGER), round(x, 6)
FROM u JOIN n USING (feature) WHERE nd < 100""",

    "stump_leaves": "WITH " + _STUMP + """
SELECT sf AS feature, CAST(NULL AS DOUBLE) AS above, thr AS upto, round(pl, 8) AS cover, round(ml, 6) AS value FROM sp, lv
UNION ALL SELECT sf, thr, NULL, round(1 - pl, 8), round(mr, 6) FROM sp, lv""",

    "stump_metrics": "WITH " + _STUMP + """,
r AS (SELECT y, y - CASE WHEN lft THEN ml ELSE mr END AS e FROM sd, lv)
SELECT count(*) AS n, round(1 - sum(e * e) / (var_pop(y) * count(*)), 8) AS r2, round(avg(abs(e)), 6) AS mae,
       round(sqrt(sum(e * e) / count(*)), 6) AS rmse FROM r""",

    "stump_cv_r2": "WITH " + _STUMP_D + """,
f AS (SELECT *, CAST(ntile(5) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS fold FROM d),
tr AS (SELECT k, x1, x2, y, y - avg(y) OVER (PARTITION BY k) AS e FROM f, range(5) r(k) WHERE fold <> k),
lg AS (SELECT k, 'p_size' AS feature, x1 AS v, e FROM tr UNION ALL SELECT k, 'is_large', x2, e FROM tr),
gr AS (SELECT k, feature, v, count(*) AS n, sum(e) AS s FROM lg GROUP BY k, feature, v),
cu AS (SELECT k, feature, v, lead(v) OVER w AS nxt, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
              sum(n) OVER (PARTITION BY k, feature) AS nt, sum(s) OVER (PARTITION BY k, feature) AS st
       FROM gr WINDOW w AS (PARTITION BY k, feature ORDER BY v)),
sp AS (SELECT k, feature AS sf, (v + nxt) / 2 AS thr,
              row_number() OVER (PARTITION BY k ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC) AS rk
       FROM cu WHERE nxt IS NOT NULL),
lv AS (SELECT k, any_value(sf) AS sf, any_value(thr) AS thr,
              avg(y) FILTER (WHERE CASE WHEN sf = 'p_size' THEN x1 ELSE x2 END <= thr) AS ml,
              avg(y) FILTER (WHERE CASE WHEN sf = 'p_size' THEN x1 ELSE x2 END > thr) AS mr
       FROM tr JOIN (SELECT * FROM sp WHERE rk = 1) b USING (k) GROUP BY k),
te AS (SELECT fold, y, y - CASE WHEN CASE WHEN sf = 'p_size' THEN x1 ELSE x2 END <= thr THEN ml ELSE mr END AS e
       FROM f JOIN lv ON lv.k = f.fold)
SELECT fold, round(1 - sum(e * e) / (var_pop(y) * count(*)), 8) AS r2 FROM te GROUP BY fold""",

    "stump_shap_values": "WITH " + _STUMP + """
SELECT p_partkey, feature, round(phi, 6) AS phi, round(base, 6) AS base FROM ph, lv""",

    "stump_shap_importance": "WITH " + _STUMP + """,
im AS (SELECT feature, avg(abs(phi)) AS m, count(*) AS n FROM ph GROUP BY feature)
SELECT CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank, feature, round(m, 6) AS mean_abs_shap,
       CAST(0 AS DOUBLE) AS mean_shap, n FROM im""",

    "stump_signed_shap": "WITH " + _STUMP + """,
im AS (SELECT feature, round(avg(phi), 6) AS m FROM ph WHERE x2 = 1 GROUP BY feature)
SELECT CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank, feature, m AS mean_shap FROM im""",

    "stump_shap_by_parameter": "WITH " + _STUMP + """
SELECT 'p_retailprice' AS target, CASE feature WHEN 'is_large' THEN 'p_type' ELSE feature END AS parameter,
       round(avg(abs(phi)), 6) AS importance FROM ph GROUP BY feature""",

    "stump_pdp_1d": "WITH " + _STUMP + """,
gd AS (SELECT DISTINCT 'p_size' AS feature, x1 AS v FROM d UNION ALL SELECT DISTINCT 'is_large', x2 FROM d)
SELECT feature, v AS value, round(CASE WHEN feature <> sf THEN base WHEN v <= thr THEN ml ELSE mr END, 6) AS pd
FROM gd, sp, lv""",

    "stump_pdp_2d": "WITH " + _STUMP + """,
g1 AS (SELECT DISTINCT x1 AS v1 FROM d), g2 AS (SELECT DISTINCT x2 AS v2 FROM d)
SELECT 'p_size' AS f1, v1, 'is_large' AS f2, v2,
       round(CASE WHEN CASE WHEN sf = 'p_size' THEN v1 ELSE v2 END <= thr THEN ml ELSE mr END, 6) AS pd
FROM g1, g2, sp, lv""",

    "stump_pdp_mean": "WITH " + _STUMP + """,
gd AS (SELECT DISTINCT 'p_size' AS feature, x1 AS v FROM d UNION ALL SELECT DISTINCT 'is_large', x2 FROM d),
av AS (SELECT avg(CASE WHEN lft THEN ml ELSE mr END) AS base_large FROM sd, lv WHERE x2 = 1)
SELECT feature, v AS value, round(CASE WHEN feature <> sf THEN base_large WHEN v <= thr THEN ml ELSE mr END, 6) AS pd
FROM gd, sp, lv, av""",

    "stump_pdp_mean_2d": "WITH " + _STUMP + """,
g1 AS (SELECT DISTINCT x1 AS v1 FROM d), g2 AS (SELECT DISTINCT x2 AS v2 FROM d)
SELECT 'p_size' AS f1, v1, 'is_large' AS f2, v2,
       round(CASE WHEN CASE WHEN sf = 'p_size' THEN v1 ELSE v2 END <= thr THEN ml ELSE mr END, 6) AS pd
FROM g1, g2, sp, lv""",

    "deep_tree_metrics": """
WITH d AS (SELECT p_retailprice AS y, avg(p_retailprice) OVER (PARTITION BY p_size, p_type = 'LARGE') AS f FROM part)
SELECT count(*) AS n, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 8) AS r2, round(avg(abs(y - f)), 6) AS mae,
       round(sqrt(avg((y - f) * (y - f))), 6) AS rmse FROM d""",

    "deep_shap_sums": """
SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_size, p_type = 'LARGE'), 6) AS explained FROM part""",

    "deep_leaf_totals": """
SELECT (SELECT count(*) FROM (SELECT DISTINCT p_size, p_type = 'LARGE' FROM part)) AS leaves, CAST(1 AS DOUBLE) AS cover,
       round(avg(p_retailprice), 6) AS base FROM part""",

    "perm_stored_model": """
WITH d AS (SELECT p_retailprice AS y, avg(p_retailprice) OVER (PARTITION BY p_size, p_type = 'LARGE') AS f FROM part),
r AS (SELECT round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 8) AS r2_base FROM d)
SELECT feature, r2_base, feature <> 'unused' AS matters FROM r, (VALUES ('p_size'), ('is_large'), ('unused')) v(feature)""",

    "sql_source": "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_brand IS NOT NULL",

    "csv_roundtrip": """
SELECT p_partkey, p_brand, CAST(nullif(p_size, 1) AS DOUBLE) AS p_size, p_retailprice FROM part""",

    "latest_run": """
SELECT '20000102_000000' AS run_id, "column", n_levels, ord FROM (
  SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS n_levels, 0 AS ord FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type), 1 FROM part)""",

    "pdp_top_series": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_type = 'LARGE' AS DOUBLE) AS x2, p_retailprice AS y FROM part),
""" + _two_feature_cte("d", "x1", "x2", "y") + """,
gr AS (SELECT DISTINCT 'p_size' AS feature, x1 AS v FROM d UNION ALL SELECT DISTINCT 'is_large', x2 FROM d)
SELECT feature, v AS value,
       round(a + b1*m1 + b2*m2 + CASE WHEN feature = 'p_size' THEN b1 * (v - m1) ELSE b2 * (v - m2) END, 6) AS pd
FROM gr, h""",

    "first_child_left_join": """
WITH fc AS (SELECT o_custkey, min(o_orderkey) AS first_child FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, fc.first_child,
       d.l_extendedprice AS line_price, e.o_totalprice AS order_total
FROM customer c
LEFT JOIN fc ON fc.o_custkey = c.c_custkey
LEFT JOIN lineitem d ON d.l_orderkey = fc.first_child AND d.l_returnflag <> 'R'
LEFT JOIN orders e ON e.o_orderkey = fc.first_child AND e.o_orderstatus <> 'P'
WHERE c.c_mktsegment IS NOT NULL""",

    "salted_left_nulls": """
SELECT r_regionkey, r_name, c_custkey, c_acctbal FROM region LEFT JOIN (
  SELECT CASE WHEN n_regionkey NOT IN (1, 3) THEN n_regionkey END AS rkey, c_custkey, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey) c ON r_regionkey = rkey""",
    "fold_sizes": """
SELECT CAST(f - 1 AS INTEGER) AS fold, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key
FROM (SELECT p_partkey, ntile(5) OVER (ORDER BY p_partkey) AS f FROM part) GROUP BY f""",
    "perm_pairing": """
SELECT CAST(r AS INTEGER) AS repeat, count(*) AS receivers, count(DISTINCT p_partkey) AS rows,
  count(DISTINCT p_partkey) AS donors FROM part, range(3) t(r) GROUP BY r""",
    "ols_large_mean": """
WITH d AS (SELECT CAST(o_orderkey % 10007 AS DOUBLE) AS x, CAST(o_totalprice AS DOUBLE) AS y FROM orders),
s AS (SELECT regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, count(*) AS n FROM d),
e AS (SELECT b, sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS se FROM s)
SELECT 'at' AS term, round(b, 8) AS coef, round(se, 8) AS std_err, round(b / se, 6) AS t, true AS bounded FROM e""",
    "salted_left_join": """
SELECT r_regionkey, r_name, c_custkey, c_acctbal
FROM region LEFT JOIN (SELECT n_regionkey, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey) c
     ON r_regionkey = c.n_regionkey""",

    "left_join_flag": """
SELECT c_custkey, o_orderkey, o_totalprice
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P'""",

    "preview": "WITH " + L_CTE + """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, round(net, 4) AS net
FROM L ORDER BY l_orderkey, l_linenumber, l_returnflag, l_quantity, net LIMIT 5""",

    "drop_audit": "WITH " + LN_CTE + f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE {PRESENT}) AS rows_after,
       count(*) - count(*) FILTER (WHERE {PRESENT}) AS rows_dropped FROM LN""",

    "dropna_rows": "WITH " + LN_CTE + f"""
SELECT l_orderkey, l_linenumber, l_discount FROM LN WHERE {PRESENT}""",

    "impute_mean": "WITH " + LN_CTE + """
SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, avg(l_discount) OVER ()), 8) AS l_discount FROM LN""",

    "target_null_counts": "WITH " + LN_CTE + """,
c AS (SELECT count(*) AS n,
             count(*) FILTER (WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)) AS p0,
             count(*) FILTER (WHERE l_discount IS NOT NULL AND NOT isnan(l_discount)) AS p1 FROM LN)
SELECT 0 AS ord, 'l_extendedprice' AS target, p0 AS n_present, n - p0 AS n_missing, p0 = 0 AS all_null FROM c
UNION ALL SELECT 1, 'l_discount', p1, n - p1, p1 = 0 FROM c""",

    "lump_topn": """
WITH cb AS (SELECT p_brand AS level, count(*) AS n FROM part GROUP BY p_brand),
kb AS (SELECT level FROM (SELECT level, row_number() OVER (ORDER BY n DESC, level ASC) AS rk FROM cb) WHERE rk <= 10),
ct AS (SELECT p_type AS level, count(*) AS n FROM part GROUP BY p_type),
kt AS (SELECT level FROM (SELECT level, row_number() OVER (ORDER BY n DESC, level ASC) AS rk FROM ct) WHERE rk <= 10)
SELECT p_partkey,
       CASE WHEN p_brand IN (SELECT level FROM kb) THEN p_brand ELSE 'Other' END AS p_brand,
       CASE WHEN p_type IN (SELECT level FROM kt) THEN p_type ELSE 'Other' END AS p_type
FROM part""",

    "level_profile": """
SELECT "column", n_levels, n_levels > 20 AS high_cardinality, ord FROM (
  SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS n_levels, 0 AS ord FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type), 1 FROM part
  UNION ALL SELECT 'p_size', count(DISTINCT CAST(p_size AS VARCHAR)), 2 FROM part)""",

    "one_hot_dropfirst": "WITH " + L_CTE + """
SELECT l_orderkey, l_linenumber,
       CAST(l_returnflag = 'N' AS DOUBLE) AS cat__l_returnflag_N,
       CAST(l_returnflag = 'R' AS DOUBLE) AS cat__l_returnflag_R,
       CAST(l_linestatus = 'O' AS DOUBLE) AS cat__l_linestatus_O
FROM L""",

    "feature_parameters": "WITH " + L_CTE + r""",
lv AS (SELECT 'l_returnflag' AS parameter, l_returnflag AS level, 0 AS o FROM L GROUP BY l_returnflag
       UNION ALL SELECT 'l_linestatus', l_linestatus, 1 FROM L GROUP BY l_linestatus
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, 2 FROM L GROUP BY o_orderpriority),
ref AS (SELECT parameter, min(level) AS r FROM lv GROUP BY parameter),
f AS (SELECT 'cat__' || lv.parameter || '_' || level AS feature, lv.parameter, level, 'categorical' AS kind
      FROM lv JOIN ref ON ref.parameter = lv.parameter WHERE level <> r
      UNION ALL SELECT 'num__' || p, p, CAST(NULL AS VARCHAR), 'numeric'
      FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) v(p))
SELECT feature, parameter, level, kind,
       CASE WHEN strpos(feature, 'l_returnflag') > 0 THEN 'l_returnflag'
            WHEN strpos(feature, 'l_linestatus') > 0 THEN 'l_linestatus'
            WHEN strpos(feature, 'o_orderpriority') > 0 THEN 'o_orderpriority'
            WHEN strpos(feature, 'l_quantity') > 0 THEN 'l_quantity'
            WHEN strpos(feature, 'l_discount') > 0 THEN 'l_discount'
            WHEN strpos(feature, 'l_tax') > 0 THEN 'l_tax' END AS parameter_compat,
       CASE WHEN level IS NOT NULL THEN parameter || ' = ' || level ELSE parameter END AS label,
       array_to_string(list_transform(string_split(replace(replace(feature, ':', ' × '), '_', ' '), ' '),
                                      lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS display
FROM f""",

    "zscore": "WITH " + L_CTE + """
SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / coalesce(nullif(stddev_pop(l_quantity) OVER (), 0), 1), 8) AS l_quantity,
  round((l_discount - avg(l_discount) OVER ()) / coalesce(nullif(stddev_pop(l_discount) OVER (), 0), 1), 8) AS l_discount,
  round((l_tax - avg(l_tax) OVER ()) / coalesce(nullif(stddev_pop(l_tax) OVER (), 0), 1), 8) AS l_tax
FROM L""",

    "feature_matrix_long": "WITH " + L_CTE + """,
st AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM L)
SELECT l_orderkey, l_linenumber, 'cat__l_returnflag_N' AS feature, CAST(1.0 AS DOUBLE) AS value FROM L WHERE l_returnflag = 'N'
UNION ALL SELECT l_orderkey, l_linenumber, 'cat__l_returnflag_R', CAST(1.0 AS DOUBLE) FROM L WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_linenumber, 'cat__l_linestatus_O', CAST(1.0 AS DOUBLE) FROM L WHERE l_linestatus = 'O'
UNION ALL SELECT l_orderkey, l_linenumber, 'num__l_quantity', round((l_quantity - m) / s, 8)
          FROM L, st WHERE (l_quantity - m) / s <> 0""",

    "feature_cells": "WITH " + L_CTE + """,
st AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM L)
SELECT l_orderkey, l_linenumber, 'cat__l_returnflag_N' AS feature, CAST(l_returnflag = 'N' AS DOUBLE) AS value FROM L
UNION ALL SELECT l_orderkey, l_linenumber, 'cat__l_returnflag_R', CAST(l_returnflag = 'R' AS DOUBLE) FROM L
UNION ALL SELECT l_orderkey, l_linenumber, 'cat__l_linestatus_O', CAST(l_linestatus = 'O' AS DOUBLE) FROM L
UNION ALL SELECT l_orderkey, l_linenumber, 'num__l_quantity', round((l_quantity - m) / s, 8) FROM L, st""",

    "skew_check": _skew_sql(),

    "corr_matrix": _corr_sql(),

    "corr_by_group": """
WITH d AS (SELECT l_returnflag, nullif(l_discount, 0) AS disc, CASE WHEN l_quantity % 5 = 0 THEN NULL ELSE l_quantity END AS qty,
                  l_extendedprice AS price FROM lineitem),
g AS (SELECT l_returnflag, corr(disc, qty) AS dq, corr(disc, price) AS dp, corr(qty, price) AS qp FROM d GROUP BY l_returnflag)
SELECT l_returnflag, col_a, col_b, round(CASE WHEN col_a = col_b THEN 1.0::DOUBLE
    WHEN (col_a, col_b) IN (('disc', 'qty'), ('qty', 'disc')) THEN dq
    WHEN (col_a, col_b) IN (('disc', 'price'), ('price', 'disc')) THEN dp ELSE qp END, 8) AS r
FROM g, (VALUES ('disc'), ('qty'), ('price')) a(col_a), (VALUES ('disc'), ('qty'), ('price')) b(col_b)""",

    "skew_by_group": """
WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY event_type),
s AS (SELECT event_type, avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5) AS g
      FROM events JOIN m USING (event_type) GROUP BY event_type)
SELECT event_type, 'value' AS "column", round(g, 6) AS skew, abs(g) > 1 AS flagged FROM s""",

    "pca_by_group": """
WITH d AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM lineitem),
c AS (SELECT l_returnflag, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM d GROUP BY l_returnflag),
e AS (SELECT l_returnflag, a + b AS tr, (a + b) / 2 AS h, sqrt(power((a - b) / 2, 2) + c * c) AS r FROM c)
SELECT l_returnflag, 1 AS pc, round(h + r, 4) AS variance, round((h + r) / tr, 8) AS ratio FROM e
UNION ALL SELECT l_returnflag, 2, round(h - r, 4), round((h - r) / tr, 8) FROM e""",

    "level_dictionary": "WITH " + _DICTIONARY + """
SELECT "column", level, n, idx, feature FROM dict""",

    "one_hot_entries": "WITH " + _DICTIONARY + """
SELECT p_partkey, idx, feature, 1.0::DOUBLE AS value FROM part JOIN dict ON ("column" = 'p_brand' AND level = p_brand)
    OR ("column" = 'p_type' AND level = p_type) WHERE idx IS NOT NULL
UNION ALL SELECT p_partkey, (SELECT max(idx) + 1 FROM dict), 'num__p_size', CAST(p_size AS DOUBLE) FROM part WHERE p_size <> 0""",

    "yeo_johnson_fixed": """
WITH t AS (SELECT event_id,
                  CASE WHEN value >= 0 THEN (power(value + 1, 0.5) - 1) / 0.5
                       ELSE -(power(-value + 1, 1.5) - 1) / 1.5 END AS psi FROM events)
SELECT event_id, round((psi - avg(psi) OVER ()) / stddev_pop(psi) OVER (), 8) AS value_transformed FROM t""",

    "ols_simple": "WITH " + L_CTE + ",\nd AS (SELECT l_quantity AS x, net AS y FROM L),\n"
                  + _simple_coef_rows("net", "l_quantity", "d"),

    "wls_fallback": """
WITH d AS (SELECT avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY l_partkey HAVING count(*) >= 2),
s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx, count(*) AS n FROM d),
r AS (SELECT sum(power(y - a - b * x, 2)) AS rss FROM d, s)
SELECT 'OLS' AS method, 'Intercept' AS term, round(a, 4) AS coef, round(sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS std_err
FROM s, r UNION ALL SELECT 'OLS', 'avg_qty', round(b, 4), round(sqrt(rss / (n - 2) / sxx), 4) FROM s, r""",

    "wls_fallback_by_group": """
WITH d AS (SELECT CAST(l_partkey % 3 AS INTEGER) AS part, avg(l_quantity) AS x, avg(l_extendedprice) AS y,
                  CASE WHEN l_partkey % 3 = 1 THEN 1.0 ELSE 1.0 / (power(stddev_samp(l_extendedprice), 2) + 0.000001) END AS w
           FROM lineitem GROUP BY l_partkey HAVING count(*) >= 2),
m AS (SELECT part, sum(w * x) / sum(w) AS xw, sum(w * y) / sum(w) AS yw, count(*) AS n FROM d GROUP BY part)
SELECT part, CASE WHEN part = 1 THEN 'OLS' ELSE 'WLS' END AS method, any_value(n) AS n,
       round(sum(w * (x - xw) * (y - yw)) / sum(w * (x - xw) * (x - xw)), 4) AS coef FROM d JOIN m USING (part) GROUP BY part""",

    "ols_near_collinear": """
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS a, ((l_quantity + l_discount * 1e-5::DOUBLE) - l_quantity) * 1e5::DOUBLE AS z,
                  CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
c AS (SELECT covar_pop(a, a) AS aa, covar_pop(z, z) AS zz, covar_pop(a, z) AS az, covar_pop(a, y) AS ay, covar_pop(z, y) AS zy,
             covar_pop(y, y) AS yy, count(*) AS n FROM d),
b AS (SELECT *, (zy * aa - ay * az) / (aa * zz - az * az) AS bz, (ay * zz - zy * az) / (aa * zz - az * az) AS ba FROM c),
e AS (SELECT bz, sqrt((yy - bz * zy - ba * ay) * n / (n - 3) * aa / (aa * zz - az * az) / n) AS se FROM b)
SELECT 'b' AS term, round(bz, 2) AS coef, round(se, 2) AS std_err, round(bz / se, 4) AS t FROM e""",

    "ols_many_levels": "WITH " + _LEVELS + """
SELECT 'qty' AS term, round(b, 4) AS coef, round(sqrt(s2 / sxx), 4) AS std_err FROM s
UNION ALL SELECT 'Intercept', round(my - b * mx, 4), round(sqrt(s2 * (1.0 / k + mx * mx / sxx)), 4) FROM m, s WHERE part = ref
UNION ALL SELECT 'cat__part_' || m.part, round(m.my - r.my - b * (m.mx - r.mx), 4),
  round(sqrt(s2 * (1.0 / m.k + 1.0 / r.k + power(m.mx - r.mx, 2) / sxx)), 4)
FROM m, s, m r WHERE r.part = ref AND m.part <> ref""",

    "ols_many_levels_fit": "WITH " + _LEVELS + """
SELECT CAST(n AS BIGINT) AS n, CAST(l + 1 AS INTEGER) AS rank, CAST(n - l - 1 AS DOUBLE) AS df_resid,
       round(1 - s2 * (n - l - 1) / (SELECT var_pop(y) * count(*) FROM d), 8) AS r2 FROM s""",

    "wls_simple": """
WITH W AS (SELECT l_partkey, avg(l_quantity) AS x, avg(l_extendedprice) AS y,
                  stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY l_partkey HAVING count(*) >= 2),
d AS (SELECT x, y, 1.0 / (sd * sd + 0.000001) AS w FROM W WHERE sd IS NOT NULL),
m AS (SELECT sum(w) AS sw, sum(w * x) / sum(w) AS xw, sum(w * y) / sum(w) AS yw, count(*) AS n FROM d),
c AS (SELECT sum(w * (x - xw) * (x - xw)) AS sxx, sum(w * (x - xw) * (y - yw)) AS sxy FROM d, m),
f AS (SELECT sxy / sxx AS b, yw - sxy / sxx * xw AS a, sw, xw, n, sxx FROM c, m),
r AS (SELECT sum(w * power(y - a - b * x, 2)) AS rss FROM d, f),
e AS (SELECT a, b, sqrt(rss / (n - 2) * (1.0 / sw + xw * xw / sxx)) AS se_a, sqrt(rss / (n - 2) / sxx) AS se_b FROM f, r)
SELECT 'avg_price' AS target, 'Intercept' AS term, round(a, 4) AS coef, round(se_a, 4) AS std_err, round(a / se_a, 6) AS t FROM e
UNION ALL
SELECT 'avg_price', 'avg_qty', round(b, 4), round(se_b, 4), round(b / se_b, 6) FROM e""",

    "ols_fit_stats": "WITH " + L_CTE + """
SELECT 'net' AS target, 'OLS' AS method, CAST(regr_count(net, l_quantity) AS BIGINT) AS n, 2 AS rank,
       CAST(regr_count(net, l_quantity) - 2 AS DOUBLE) AS df_resid, round(regr_r2(net, l_quantity), 8) AS r2 FROM L""",

    "wls_fit_stats": """
WITH W AS (SELECT l_partkey, avg(l_quantity) AS x, avg(l_extendedprice) AS y,
                  stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY l_partkey HAVING count(*) >= 2),
d AS (SELECT x, y, 1.0 / (sd * sd + 0.000001) AS w FROM W WHERE sd IS NOT NULL),
m AS (SELECT sum(w * x) / sum(w) AS xw, sum(w * y) / sum(w) AS yw, count(*) AS n FROM d),
c AS (SELECT sum(w * (x - xw) * (x - xw)) AS sxx, sum(w * (x - xw) * (y - yw)) AS sxy,
             sum(w * (y - yw) * (y - yw)) AS syy FROM d, m)
SELECT 'avg_price' AS target, 'WLS' AS method, n, 2 AS rank, CAST(n - 2 AS DOUBLE) AS df_resid,
       round(sxy * sxy / (sxx * syy), 8) AS r2 FROM c, m""",

    "ols_two_feature": "WITH " + L_CTE + ",\n" + _two_feature_cte("L", "l_quantity", "l_discount", "net") + """
SELECT 'net' AS target, 'Intercept' AS term, round(a, 4) AS coef,
       round(sqrt(s2 * (1.0/n + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det)), 4) AS std_err,
       round(a / sqrt(s2 * (1.0/n + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det)), 6) AS t FROM h
UNION ALL SELECT 'net', 'l_quantity', round(b1, 4), round(sqrt(s2*s22/det), 4), round(b1/sqrt(s2*s22/det), 6) FROM h
UNION ALL SELECT 'net', 'l_discount', round(b2, 4), round(sqrt(s2*s11/det), 4), round(b2/sqrt(s2*s11/det), 6) FROM h""",

    "ols_by_group": "WITH d AS (SELECT p_type, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),\n"
                    + _simple_coef_rows("p_retailprice", "p_size", "d", by="p_type"),

    "ols_full_coefs": """
SELECT term, true AS orthogonal FROM (VALUES ('Intercept'), ('cat__l_returnflag_N'), ('cat__l_returnflag_R'),
  ('cat__l_linestatus_O'), ('cat__o_orderpriority_2-HIGH'), ('cat__o_orderpriority_3-MEDIUM'),
  ('cat__o_orderpriority_4-NOT SPECIFIED'), ('cat__o_orderpriority_5-LOW'), ('num__l_quantity'),
  ('num__l_discount'), ('num__l_tax')) t(term)""",

    "linear_cv_r2": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
                  CAST(ntile(5) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS fold FROM part),
k AS (SELECT DISTINCT fold AS k FROM d),
tr AS (SELECT k.k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN d ON d.fold <> k.k GROUP BY k.k),
mm AS (SELECT fold, avg(y) AS ym FROM d GROUP BY fold),
te AS (SELECT d.fold, 1 - sum(power(y - (a + b * x), 2)) / sum(power(y - ym, 2)) AS r2
       FROM d JOIN tr ON tr.k = d.fold JOIN mm ON mm.fold = d.fold GROUP BY d.fold)
SELECT 'p_retailprice' AS target, fold, round(r2, 8) AS r2 FROM te""",

    "metrics_by_group": """
WITH s AS (SELECT p_type, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
           FROM part GROUP BY p_type),
d AS (SELECT part.p_type, p_retailprice AS y, a + b * p_size AS yhat FROM part JOIN s ON s.p_type = part.p_type)
SELECT p_type, count(*) AS n, round(1 - sum(power(y - yhat, 2)) / (var_pop(y) * count(*)), 8) AS r2,
       round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(sum(power(y - yhat, 2)) / count(*)), 6) AS rmse
FROM d GROUP BY p_type""",

    "interaction_cells_d2": "WITH " + _d2_cte() + """
SELECT 'net' AS target, term, label, round(coef, 4) AS coef, round(se, 4) AS std_err, round(coef / se, 6) AS t FROM co""",

    "interaction_numeric_d1": "WITH " + _num_d1_cte() + """
SELECT 'net' AS target, 1 AS depth, term, label, round(coef, 4) AS coef, round(se, 4) AS std_err,
       round(coef / se, 6) AS t FROM co""",

    "significant_terms_numeric": "WITH " + _num_d1_cte() + """,
sg AS (SELECT co.*, row_number() OVER (ORDER BY abs(coef) DESC, term ASC) AS rk
       FROM co, crit WHERE term <> 'Intercept' AND abs(coef / se) > tc)
SELECT 'net' AS target, 1 AS depth, term, round(coef, 4) AS coef, CAST(rk AS INTEGER) AS rank FROM sg WHERE rk <= 20""",

    "param_rollup_numeric": "WITH " + _num_d1_cte() + """
SELECT 'net' AS target, 1 AS depth, label AS parameter, round(abs(coef), 4) AS sum_abs_coef
FROM co, crit WHERE term <> 'Intercept' AND abs(coef / se) > tc""",

    "pca_variance": "WITH " + L_CTE + """,
c AS (SELECT abs(corr(l_quantity, l_discount)) AS r FROM L)
SELECT 1 AS pc, round((1 + r) / 2, 8) AS ratio, round((1 + r) / 2, 8) AS cumulative FROM c
UNION ALL SELECT 2, round((1 - r) / 2, 8), CAST(1.0 AS DOUBLE) FROM c""",

    "linear_shap_importance": """
WITH s AS (SELECT regr_slope(p_retailprice, p_size) AS b, avg(p_size) AS m FROM part)
SELECT 'p_size' AS feature, round(avg(abs(b * (p_size - m))), 6) AS mean_abs_shap FROM part, s""",

    "linear_pdp_1d": """
WITH s AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part),
g AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part)
SELECT 'p_size' AS feature, x AS value, round(a + b * x, 6) AS pd FROM g, s""",

    "linear_pdp_2d": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_type = 'LARGE' AS DOUBLE) AS x2, p_retailprice AS y FROM part),
""" + _two_feature_cte("d", "x1", "x2", "y") + """,
g1 AS (SELECT DISTINCT x1 AS v1 FROM d), g2 AS (SELECT DISTINCT x2 AS v2 FROM d)
SELECT 'p_size' AS f1, v1, 'is_large' AS f2, v2, round(a + b1 * v1 + b2 * v2, 6) AS pd FROM g1, g2, h""",

    "tree_shap_additivity": "SELECT CAST(0 AS DOUBLE) AS max_abs_error, count(*) AS n FROM part",

    "linear_shap_values": """
WITH s AS (SELECT regr_slope(p_retailprice, p_size) AS b, avg(p_size) AS m FROM part)
SELECT p_partkey, round(b * (p_size - m), 6) AS phi_p_size FROM part, s""",

    "coef_by_parameter": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_type = 'LARGE' AS DOUBLE) AS x2, p_retailprice AS y FROM part),
""" + _two_feature_cte("d", "x1", "x2", "y") + """
SELECT 'p_retailprice' AS target, 'p_size' AS parameter, round(abs(b1), 6) AS sum_abs_coef FROM h
UNION ALL SELECT 'p_retailprice', 'is_large', round(abs(b2), 6) FROM h""",

    "pdp_effect_by_parameter": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_type = 'LARGE' AS DOUBLE) AS x2, p_retailprice AS y FROM part),
""" + _two_feature_cte("d", "x1", "x2", "y") + """,
ef AS (SELECT 'p_size' AS parameter, abs(b1) * ((SELECT max(x1) FROM d) - (SELECT min(x1) FROM d)) AS e FROM h
       UNION ALL SELECT 'is_large', abs(b2) * ((SELECT max(x2) FROM d) - (SELECT min(x2) FROM d)) FROM h)
SELECT parameter, round(e, 6) AS effect_mean, round(e, 6) AS effect_max, CAST(1 AS BIGINT) AS n_features FROM ef""",

    "cv_summary": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
                  CAST(ntile(5) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS fold FROM part),
k AS (SELECT DISTINCT fold AS k FROM d),
tr AS (SELECT k.k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN d ON d.fold <> k.k GROUP BY k.k),
mm AS (SELECT fold, avg(y) AS ym FROM d GROUP BY fold),
te AS (SELECT d.fold, 1 - sum(power(y - (a + b * x), 2)) / sum(power(y - ym, 2)) AS r2
       FROM d JOIN tr ON tr.k = d.fold JOIN mm ON mm.fold = d.fold GROUP BY d.fold)
SELECT 'p_retailprice' AS target, round(avg(r2), 8) AS cv_mean, round(stddev_pop(r2), 8) AS cv_std,
       count(*) AS folds FROM te""",

    "pca_components_for": "WITH " + L_CTE + """,
c AS (SELECT (1 + abs(corr(l_quantity, l_discount))) / 2 AS r1 FROM L)
SELECT CAST(CASE WHEN r1 >= 0.8 THEN 1 ELSE 2 END AS INTEGER) AS n_80,
       CAST(CASE WHEN r1 >= 0.95 THEN 1 ELSE 2 END AS INTEGER) AS n_95 FROM c""",

    "param_rollup": "WITH " + _d2_cte() + """,
sg AS (SELECT co.* FROM co, crit WHERE kind <> 'i' AND abs(coef / se) > tc)
SELECT 'net' AS target, parameter, round(sum(abs(coef)), 4) AS sum_abs_coef FROM (
  SELECT coef, 'o_orderpriority' AS parameter FROM sg
  UNION ALL SELECT coef, 'l_returnflag' FROM sg WHERE kind = 'ab') GROUP BY parameter""",

    "significant_terms": "WITH " + _d2_cte() + """,
sg AS (SELECT co.*, row_number() OVER (ORDER BY abs(coef) DESC, term ASC) AS rk
       FROM co, crit WHERE kind <> 'i' AND abs(coef / se) > tc)
SELECT 'net' AS target, 2 AS depth, term, round(coef, 4) AS coef, CAST(rk AS INTEGER) AS rank FROM sg WHERE rk <= 20""",

    "param_rollup_bands": "WITH " + _d2_cte("disc_band", "LB") + """,
sg AS (SELECT co.* FROM co, crit WHERE kind <> 'i' AND abs(coef / se) > tc)
SELECT 'net' AS target, parameter, round(sum(abs(coef)), 4) AS sum_abs_coef FROM (
  SELECT coef, 'disc_band' AS parameter FROM sg
  UNION ALL SELECT coef, 'l_returnflag' FROM sg WHERE kind = 'ab') GROUP BY parameter""",

    "significant_terms_bands": "WITH " + _d2_cte("disc_band", "LB") + """,
sg AS (SELECT co.*, row_number() OVER (ORDER BY abs(coef) DESC, term ASC) AS rk
       FROM co, crit WHERE kind <> 'i' AND abs(coef / se) > tc)
SELECT 'net' AS target, 2 AS depth, term, round(coef, 4) AS coef, CAST(rk AS INTEGER) AS rank FROM sg WHERE rk <= 20""",

    "interaction_status_d2": "WITH " + L_CTE + """,
k AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS ka, count(DISTINCT o_orderpriority) AS kb,
             count(DISTINCT (l_returnflag, o_orderpriority)) AS kab FROM L)
SELECT 'net' AS target, 1 AS depth, CAST(ka + kb - 1 AS INTEGER) AS n_columns, 'fitted' AS status, n,
       CAST(ka + kb - 1 AS INTEGER) AS rank FROM k
UNION ALL SELECT 'net', 2, CAST(ka * kb AS INTEGER), 'fitted', n, CAST(kab AS INTEGER) FROM k""",

    "linear_facts": "WITH " + L_CTE + """,
s AS (SELECT regr_slope(net, l_discount) AS b, regr_intercept(net, l_discount) AS a, regr_r2(net, l_discount) AS r2,
             count(*) AS n, count(*) - 2 AS dfr,
             sqrt((regr_syy(net, l_discount) / regr_sxx(net, l_discount) - power(regr_slope(net, l_discount), 2)) / (count(*) - 2)) AS se
      FROM L),
sk AS (""" + _skew_sql() + """)
SELECT 'net' AS target, 'intercept' AS section, 0 AS ord, 'Intercept' AS subject, round(a, 4) AS value,
       printf('Baseline (intercept) is %.4f', a) AS text FROM s
UNION ALL SELECT 'net', 'significant', 1, 'l_discount', round(b, 4),
       printf('l_discount %s the outcome by %.4f per unit', CASE WHEN b > 0 THEN 'increases' ELSE 'decreases' END, abs(b))
FROM s WHERE abs(b / se) > """ + _tcrit("dfr") + """
UNION ALL SELECT 'net', 'fit', 0, 'r2', round(r2, 4), printf('R² = %.4f on %d rows', r2, n) FROM s
UNION ALL SELECT NULL, 'skew', ord, "column", round(skew, 4), printf('%s is skewed (g1 = %.3f)', "column", skew)
FROM sk WHERE flagged""",

    "stump_shap_sample": "WITH " + _STUMP + """,
nn AS (SELECT count(*) AS n FROM d),
pick AS (SELECT p_partkey FROM d, nn WHERE CAST('0x' || substr(md5('7|' || p_partkey), 1, 8) AS BIGINT) < (n // 4) * 4294967296 // n)
SELECT ph.p_partkey, feature, round(phi, 6) AS phi, round(base, 6) AS base FROM ph JOIN pick ON pick.p_partkey = ph.p_partkey, lv""",

    "topk_abs_coef": "WITH " + _d2_cte() + """,
tk AS (SELECT co.*, row_number() OVER (ORDER BY abs(coef) DESC, term ASC) AS rk FROM co WHERE kind <> 'i')
SELECT 'net' AS target, term, round(coef, 4) AS coef,
       CASE WHEN coef < 0 THEN 'negative' ELSE 'positive' END AS direction, CAST(rk AS INTEGER) AS rank
FROM tk WHERE rk <= 20""",

    "term_labels": "WITH " + _d2_cte() + """
SELECT term, label,
       array_to_string(list_transform(string_split(replace(replace(term, ':', ' × '), '_', ' '), ' '),
                                      lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS display
FROM co""",

    "pdp_effect_rank": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_type = 'LARGE' AS DOUBLE) AS x2, p_retailprice AS y FROM part),
""" + _two_feature_cte("d", "x1", "x2", "y") + """,
gr AS (SELECT DISTINCT 'p_size' AS feature, x1 AS v FROM d UNION ALL SELECT DISTINCT 'is_large', x2 FROM d),
pdv AS (SELECT feature, a + b1*m1 + b2*m2 + CASE WHEN feature = 'p_size' THEN b1 * (v - m1) ELSE b2 * (v - m2) END AS pd
        FROM gr, h),
ef AS (SELECT feature, max(pd) - min(pd) AS effect, min(pd) AS pd_min, max(pd) AS pd_max FROM pdv GROUP BY feature)
SELECT feature, round(effect, 6) AS effect, round(pd_min, 6) AS pd_min, round(pd_max, 6) AS pd_max,
       CAST(row_number() OVER (ORDER BY effect DESC, feature ASC) AS INTEGER) AS rank FROM ef""",

    "method_rank": """
WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_type = 'LARGE' AS DOUBLE) AS x2, p_retailprice AS y FROM part),
""" + _two_feature_cte("d", "x1", "x2", "y") + """,
vals AS (
  SELECT 'p_size' AS parameter, abs(b1) AS coef_v,
         (SELECT avg(abs(b1 * (x1 - m1))) FROM d) AS shap_v,
         abs(b1) * ((SELECT max(x1) FROM d) - (SELECT min(x1) FROM d)) AS pdp_v FROM h
  UNION ALL
  SELECT 'is_large', abs(b2), (SELECT avg(abs(b2 * (x2 - m2))) FROM d),
         abs(b2) * ((SELECT max(x2) FROM d) - (SELECT min(x2) FROM d)) FROM h),
rk AS (SELECT parameter,
              CAST(rank() OVER (ORDER BY coef_v DESC) AS INTEGER) AS rank_coef,
              CAST(rank() OVER (ORDER BY shap_v DESC) AS INTEGER) AS rank_shap,
              CAST(rank() OVER (ORDER BY pdp_v DESC) AS INTEGER) AS rank_pdp FROM vals)
SELECT parameter, rank_coef, rank_shap, rank_pdp, round((rank_coef + rank_shap + rank_pdp) / 3.0, 6) AS mean_rank FROM rk""",
}
