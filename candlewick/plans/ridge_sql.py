"""Ridge and lasso on standardised features as DuckDB CTEs, for the oracle statements.

The Gram matrix of every group is built in long form and solved by
Gauss-Jordan elimination in a recursive CTE (one pivot a step; the matrix is
positive definite, so no pivot search is needed).  Nothing here is executed by
Spark.
"""

from __future__ import annotations

from candlewick.schema import FEATURES

P = len(FEATURES)
_INDEX = "list_position([" + ", ".join(f"'{f}'" for f in FEATURES) + "], f) - 1"


def long_form(name: str, src: str, columns: str) -> str:
    """``name``: rid, the columns, f (feature), idx, v -- one row per value of ``src``."""
    feats = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    return f"""{name}_n AS (SELECT row_number() OVER () AS rid, {columns}, {feats} FROM {src}),
{name} AS (SELECT *, CAST({_INDEX} AS INTEGER) AS idx FROM (UNPIVOT {name}_n ON {", ".join(FEATURES)} INTO NAME f VALUE v))"""


def gram_ctes(src: str, keys: str = "symbol") -> str:
    """CTEs ending in ``gram``: keys, i, j, v -- products of the standardised
    features (j = P: with the centred label) of ``src``; also ``cnt`` and ``ms``."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    ak = ", ".join(f"a.{k}" for k in ks)
    return f"""{long_form("tr", src, f"{keys}, label")},
cnt AS (SELECT {keys}, count(*) AS cnt, avg(label) AS ybar FROM {src} GROUP BY {keys}),
ms AS (SELECT {keys}, idx, avg(v) AS mu, stddev_pop(v) AS sd FROM tr GROUP BY {keys}, idx),
z AS (SELECT rid, {keys}, idx, (v - mu) / sd AS z, label - ybar AS y FROM tr JOIN ms USING ({keys}, idx) JOIN cnt USING ({keys})),
gram AS (SELECT {ak}, a.idx AS i, b.idx AS j, sum(a.z * b.z) AS v FROM z a JOIN z b ON a.rid = b.rid AND {on} GROUP BY {ak}, a.idx, b.idx
         UNION ALL SELECT {keys}, idx, {P}, sum(z * y) FROM z GROUP BY {keys}, idx)"""


def _coef(frm: str, keys: str, k: str) -> str:
    ks = [x.strip() for x in keys.split(",")]
    return f"""coef AS (SELECT {", ".join(f"{frm}.{x}" for x in ks)}, alpha, i AS idx, mu, sd, ybar, v AS w FROM {frm}
         JOIN ms ON {frm}.i = ms.idx AND {" AND ".join(f"{frm}.{x} = ms.{x}" for x in ks)}
         JOIN cnt ON {" AND ".join(f"{frm}.{x} = cnt.{x}" for x in ks)} WHERE {k})"""


def lasso_ctes(src: str, keys: str = "symbol", alphas: str = "(VALUES (0.001))", sweeps: int = 1000) -> str:
    """CTEs ending in ``coef`` as those of :func:`ridge_ctes`, fitted by cyclic
    coordinate descent: a step of the recursion is a sweep over the coefficients
    of every (keys, alpha), which are held as a list."""
    zeros = "[" + ", ".join(["0.0"] * P) + "]"
    places = "[" + ", ".join(f"[{j}.0]" for j in range(1, P + 1)) + "]"
    j = "CAST(e[1] AS INTEGER)"
    rho = f"(b[{j}] - list_dot_product(g[{j}], w0) + g[{j}][{j}] * w0[{j}])"
    step = f"w0[:{j} - 1] || [sign({rho}) * greatest(abs({rho}) - alpha, 0.0) / g[{j}][{j}]] || w0[{j} + 1:]"
    return f"""{gram_ctes(src, keys)},
gs AS MATERIALIZED (SELECT {keys}, list(r ORDER BY i) AS g, list(y ORDER BY i) AS b FROM (
  SELECT {keys}, i, list(v / cnt ORDER BY j) FILTER (WHERE j < {P}) AS r, max(CASE WHEN j = {P} THEN v / cnt END) AS y
  FROM gram JOIN cnt USING ({keys}) GROUP BY {keys}, i) x GROUP BY {keys}),
cd AS (SELECT 0 AS k, {keys}, CAST(alpha AS DOUBLE) AS alpha, CAST({zeros} AS DOUBLE[]) AS w FROM gs, {alphas} al(alpha)
  UNION ALL
  SELECT k + 1, {keys}, alpha, list_reduce([w] || CAST({places} AS DOUBLE[][]), lambda w0, e: {step}) FROM cd JOIN gs USING ({keys}) WHERE k < {sweeps}),
cw AS (SELECT {keys}, alpha, unnest(w) AS v, unnest(range({P})) AS i FROM cd WHERE k = {sweeps}),
{_coef("cw", keys, "true")}"""


def ridge_ctes(src: str, keys: str = "symbol", alphas: str = "(VALUES (1.0))") -> str:
    """CTEs ending in ``coef`` (keys, alpha, idx, mu, sd, ybar, w) fitted on
    ``src``; the statement must start with WITH RECURSIVE."""
    return f"""{gram_ctes(src, keys)},
gj AS (
  SELECT 0 AS k, {keys}, CAST(alpha AS DOUBLE) AS alpha, i, CAST(j AS INTEGER) AS j, v + CASE WHEN i = j THEN CAST(alpha AS DOUBLE) ELSE 0.0 END AS v
  FROM gram, {alphas} al(alpha)
  UNION ALL
  SELECT k + 1, {keys}, alpha, i, j, CASE WHEN i = k THEN v / p ELSE v - c * r / p END
  FROM (SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY {keys}, alpha) AS p,
               max(CASE WHEN j = k THEN v END) OVER (PARTITION BY {keys}, alpha, i) AS c,
               max(CASE WHEN i = k THEN v END) OVER (PARTITION BY {keys}, alpha, j) AS r
        FROM gj WHERE k < {P}) q),
{_coef("gj", keys, f"gj.k = {P} AND gj.j = {P}")}"""


def predicted(src: str, columns: str, keys: str = "symbol") -> str:
    """CTEs ending in ``pred``: the columns of ``src``, alpha and pred."""
    return f"""{long_form("te", src, columns)},
sc AS (SELECT rid, alpha, any_value(ybar) + sum(w * (v - mu) / sd) AS pred FROM te JOIN coef USING ({keys}, idx) GROUP BY rid, alpha),
pred AS (SELECT te_n.*, alpha, pred FROM te_n JOIN sc USING (rid))"""


def scores(src: str, keys: str) -> str:
    """A10 over ``src`` (label, pred)."""
    return f"""SELECT {keys}, count(*) AS n, sqrt(sum((label - pred) ^ 2) / count(*)) AS rmse, avg(abs(label - pred)) AS mae,
  CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(label) = 0 THEN CASE WHEN sum((label - pred) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
       ELSE 1.0 - sum((label - pred) ^ 2) / (var_pop(label) * count(*)) END AS r2
FROM {src} GROUP BY {keys}"""
