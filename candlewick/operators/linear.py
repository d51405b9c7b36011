"""Ridge and lasso per group (symbol, fold, alpha, ...) from sufficient statistics.

The reference fits one linear model per symbol on standardised features
(population std, as scikit-learn's scaler).  Here every group is fitted at
once, in one pass over the rows:

1. ``mapInPandas``: per Arrow batch and group, the count, the means and the
   centred Gram matrix of features and label (about 300 numbers);
2. one shuffle of these partial rows by group; parts of a group are merged with
   the centred (pairwise) update, which keeps the digits that plain sums of
   prices would lose;
3. a 22x22 solve (ridge) or coordinate descent on the Gram matrix (lasso) for
   the merged rows, vectorised over groups.

Walk-forward folds reuse the parts: the training set of fold f is the running
merge of the blocks before it, so no row is copied per fold, and the penalty
enters on the merged rows only.

The metrics of a fold come from the same parts: the squared error of its test
block is a quadratic form of that block's products and the coefficients, so RMSE
and R^2 need no second pass (the mean absolute error does).

Imputation inside folds works on the parts too.  A row enters as (values with
missing ones as 0, flags of missing ones, label); a fold's filled features are a
linear map of these, so its products follow from the merged parts and the fold's
fill values.  Those come from quantile sketches (or sums) per block, merged like
the parts.

No group's rows are ever collected: a symbol with a third of all rows ships one
partial row per batch.  Without imputation, rows with a missing feature or label
are left out, so that every sum is over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Part = tuple[float, np.ndarray, np.ndarray]  # rows, means, centred products


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(p) for b in range(a, p)]


def merge_parts(x: Part, y: Part) -> Part:
    """Centred products of two row sets together."""
    n = x[0] + y[0]
    d = y[1] - x[1]
    return n, x[1] + d * (y[0] / n), x[2] + y[2] + np.outer(d, d) * (x[0] * y[0] / n)


def partial_stats(train: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", flags: bool = False) -> DataFrame:
    """keys, n, mean[], products[] (square, features then label) per group and batch.

    With ``flags`` missing features count as 0 and a flag per feature follows
    the features; only rows without a label are left out."""
    keys = list(keys)
    columns = [*features, label]
    t = train.select(*keys, *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[[f"_v{j}" for j in range(len(columns))]].to_numpy(dtype=float)
            if flags:
                gone = np.isnan(x[:, :-1])
                x = np.column_stack([np.where(gone, 0.0, x[:, :-1]), gone, x[:, -1]])
            pdf, x = pdf.loc[good := ~np.isnan(x).any(axis=1), keys].reset_index(drop=True), x[good]
            if not len(pdf):
                continue
            group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(group.max() + 2))
            rows = {"n": [], "mean": [], "products": []}
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = x[order[lo:hi]]
                mean = part.mean(axis=0)
                part = part - mean
                rows["n"].append(hi - lo)
                rows["mean"].append(mean)
                rows["products"].append((part.T @ part).ravel())
            yield pdf.iloc[order[cuts[:-1]]].assign(**rows)

    schema = T.StructType([f for f in t.schema.fields if f.name in keys] + [
        T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("products", T.ArrayType(T.DoubleType()))])
    return t.mapInPandas(run, schema)


def _merged_groups(frames: Iterator[pd.DataFrame], keys: list[str], block: str | None, folds: int) -> Iterator[pd.DataFrame]:
    """Merged statistics of the groups of a partition sorted by key (and
    block); with ``block``, one row per fold: the merge of the blocks before it,
    and the fold's own block as its test part."""
    last, state, rows = None, None, []

    def close() -> None:
        if last is None:
            return
        if block is None:
            rows.append((*last, state, None))
        else:
            for fold in range(1, folds + 1):
                have = [state[b] for b in range(fold) if b in state]
                if have:
                    total = have[0]
                    for part in have[1:]:
                        total = merge_parts(total, part)
                    rows.append((*last, fold, total, state.get(fold)))

    def flush() -> pd.DataFrame:
        names = [*keys, block] if block else keys
        out = pd.DataFrame([r[:-2] for r in rows], columns=names)
        parts = [r[-2] for r in rows]
        p = len(parts[0][1]) - 1
        upper = tuple(np.array(_pairs(p)).T)
        out["n"] = [int(x[0]) for x in parts]
        out["mu"] = [x[1][:p] for x in parts]
        out["ybar"] = [x[1][p] for x in parts]
        out["sxx"] = [x[2][:p, :p][upper] for x in parts]
        out["sxy"] = [x[2][:p, p] for x in parts]
        if block:
            none = (0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1)))
            tests = [r[-1] or none for r in rows]
            out["test_n"] = [int(x[0]) for x in tests]
            out["test_mean"] = [x[1] for x in tests]
            out["test_products"] = [x[2].ravel() for x in tests]
        rows.clear()
        return out

    for frame in frames:
        for values in frame[[*keys, *([block] if block else []), "n", "mean", "products"]].itertuples(index=False, name=None):
            key, (n, mean, products) = values[:len(keys)], values[-3:]
            part = (float(n), np.asarray(mean, float), np.asarray(products, float).reshape(len(mean), len(mean)))
            if key != last:
                close()
                if len(rows) >= 500:
                    yield flush()
                last, state = key, ({} if block else None)
            if block is None:
                state = part if state is None else merge_parts(state, part)
            else:
                b = int(values[len(keys)])
                state[b] = merge_parts(state[b], part) if b in state else part
    close()
    if rows:
        yield flush()


SKETCH = 8192  # values that a sketch holds exactly; beyond, ranks are off by about n / 5000


def fold_fills(blocks: DataFrame, keys: Sequence[str], features: Sequence[str], folds: int, strategy: str = "median") -> DataFrame:
    """keys, fold, fill[]: the median or mean of each feature over the blocks
    before the fold, NULL for a feature that they never have.

    One sketch (or count and sum) per (group, block, feature), merged per fold:
    no value travels twice."""
    if strategy not in ("median", "mean"):
        raise ValueError("strategy must be 'median' or 'mean'")
    keys = list(keys)
    own = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    later = F.explode(F.sequence(F.col("fold") + 1, F.lit(folds))).alias("_f")
    by_block = blocks.groupBy(*keys, "fold")
    if strategy == "mean":
        parts = by_block.agg(*[F.sum(c).alias(f"_s{j}") for j, c in enumerate(own)], *[F.count(c).alias(f"_n{j}") for j, c in enumerate(own)])
        merged = parts.where(F.col("fold") < folds).select(*keys, *[c for c in parts.columns if c[:2] in ("_s", "_n")], later).groupBy(*keys, "_f").agg(
            *[F.try_divide(F.sum(f"_s{j}"), F.sum(f"_n{j}")).alias(f"_q{j}") for j in range(len(features))])
        fill = [F.col(f"_q{j}") for j in range(len(features))]
    else:
        parts = by_block.agg(*[F.kll_sketch_agg_double(c, F.lit(SKETCH)).alias(f"_s{j}") for j, c in enumerate(own)])
        merged = parts.where(F.col("fold") < folds).select(*keys, *[f"_s{j}" for j in range(len(features))], later).groupBy(*keys, "_f").agg(
            *[F.kll_merge_agg_double(f"_s{j}", F.lit(SKETCH)).alias(f"_q{j}") for j in range(len(features))])
        fill = [_sketch_median(F.col(f"_q{j}")) for j in range(len(features))]
    return merged.select(*keys, F.col("_f").alias("fold"), F.array(*fill).alias("fill"))


def _sketch_median(sketch: Column) -> Column:
    """The middle value, or the mean of the two middle ones: the ranks at and
    just above one half."""
    at, above = (F.kll_sketch_get_quantile_double(sketch, F.lit(r)) for r in (0.5, 0.5 + 1e-7))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, (at + above) / 2)


def fill_folds(rows: DataFrame, fills: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The rows with missing features filled by the values of their (keys, fold)."""
    j = rows.join(fills, [*keys, "fold"], "left")
    filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.col("fill")[i], F.lit(0.0)) for i, c in enumerate(features)}
    return j.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in rows.columns])


def _filled(pdf: pd.DataFrame, p: int) -> pd.DataFrame:
    """Statistics of (values, flags, label) and fill values -> of filled features."""
    m = len(pdf)
    fill = np.array([[0.0 if v is None or np.isnan(v) else v for v in row] for row in pdf["fill"]]).reshape(m, p)
    move = np.zeros((m, p + 1, 2 * p + 1))
    j = np.arange(p)
    move[:, j, j], move[:, j, p + j], move[:, p, 2 * p] = 1.0, fill, 1.0
    upper, own = np.array(_pairs(2 * p)).T, np.array(_pairs(p)).T
    C = np.zeros((m, 2 * p + 1, 2 * p + 1))
    sxx, sxy = np.stack(pdf["sxx"].to_numpy()), np.stack(pdf["sxy"].to_numpy())
    C[:, upper[0], upper[1]] = C[:, upper[1], upper[0]] = sxx
    C[:, :-1, -1] = C[:, -1, :-1] = sxy
    C = move @ C @ move.transpose(0, 2, 1)
    T_ = move @ np.stack(pdf["test_products"].to_numpy()).reshape(m, 2 * p + 1, 2 * p + 1) @ move.transpose(0, 2, 1)
    mean = np.column_stack([np.stack(pdf["mu"].to_numpy()), pdf["ybar"].to_numpy(float)])
    out = pdf.drop(columns=["fill"])
    out["mu"] = list((move @ mean[:, :, None])[:, :p, 0])
    out["sxx"], out["sxy"] = list(C[:, own[0], own[1]]), list(C[:, :p, p])
    out["test_mean"] = list((move @ np.stack(pdf["test_mean"].to_numpy())[:, :, None])[:, :, 0])
    out["test_products"] = list(T_.reshape(m, -1))
    return out


def fill_missing(rows: DataFrame, fills: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Missing features take their group's fill value; a feature that its group
    never has becomes 0 everywhere, so its coefficient is 0."""
    names = [c for c in rows.columns]
    j = rows.join(fills, list(keys), "left")
    return j.select(*[F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.col(f"_fill_{c}"), F.lit(0.0)).alias(c)
                      if c in features else F.col(c) for c in names])


def fill_values(rows: DataFrame, keys: Sequence[str], features: Sequence[str], strategy: str = "median") -> DataFrame:
    """keys, _fill_<feature>: the group's median or mean of each feature."""
    if strategy not in ("median", "mean"):
        raise ValueError("strategy must be 'median' or 'mean'")
    fn = F.median if strategy == "median" else F.avg
    return rows.groupBy(*keys).agg(*[fn(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"_fill_{c}") for c in features])


def _standardised(pdf: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, means, scales, Gram matrices and label products of standardised features."""
    m = len(pdf)
    a_idx, b_idx = np.array(_pairs(p)).T
    n = pdf["n"].to_numpy(dtype=float)
    sxx = np.stack(pdf["sxx"].to_numpy()).astype(float)
    sxy = np.stack(pdf["sxy"].to_numpy()).astype(float)
    mu = np.stack(pdf["mu"].to_numpy()).astype(float)
    C = np.zeros((m, p, p))
    C[:, a_idx, b_idx] = sxx
    C[:, b_idx, a_idx] = sxx
    sd = np.sqrt(np.maximum(np.diagonal(C, axis1=1, axis2=2) / n[:, None], 0.0))
    # scikit-learn's scaler: a (near-)constant feature keeps scale 1
    sd = np.where(sd < 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(mu)), 1.0, sd)
    G = C / (sd[:, :, None] * sd[:, None, :])
    b = sxy / sd
    return n, mu, sd, G, b


def _solve_rows(pdf: pd.DataFrame, p: int, model: str, alpha_col: str | None, alpha: float,
                max_iter: int, tol: float) -> pd.DataFrame:
    """Solve every statistics row of the batch at once (numpy, vectorised over rows)."""
    m = len(pdf)
    n, mu, sd, G, b = _standardised(pdf, p)
    a = pdf[alpha_col].to_numpy(dtype=float) if alpha_col else np.full(m, alpha)
    steps = np.zeros(m, dtype=np.int64)
    if model == "ridge":
        w = np.linalg.solve(G + a[:, None, None] * np.eye(p)[None], b[:, :, None])[:, :, 0]
    else:
        # lasso, (1/2n)||y - Xw||^2 + a*||w||_1: cyclic coordinate descent on the
        # Gram matrix, all rows at once; a row stops when its largest update is
        # below tol * max(1, max|w|).
        Gn, bn = G / n[:, None, None], b / n[:, None]
        diag = np.diagonal(Gn, axis1=1, axis2=2).copy()
        safe = np.where(diag > 0, diag, 1.0)
        w = np.zeros((m, p))
        active = np.ones(m, dtype=bool)
        for _ in range(max_iter):
            idx = np.nonzero(active)[0]
            if idx.size == 0:
                break
            Ga, ba, wa, da, sa, aa = Gn[idx], bn[idx], w[idx], diag[idx], safe[idx], a[idx]
            delta = np.zeros(idx.size)
            for j in range(p):
                rho = ba[:, j] - np.einsum("rk,rk->r", Ga[:, j, :], wa) + da[:, j] * wa[:, j]
                new = np.where(da[:, j] > 0, np.sign(rho) * np.maximum(np.abs(rho) - aa, 0.0) / sa[:, j], 0.0)
                delta = np.maximum(delta, np.abs(new - wa[:, j]))
                wa[:, j] = new
            w[idx] = wa
            steps[idx] += 1
            active[idx] = delta > tol * np.maximum(1.0, np.abs(wa).max(axis=1))
    res = pdf.drop(columns=["sxx", "sxy", "test_mean", "test_products"], errors="ignore").copy()
    if "test_products" in pdf:
        beta = w / sd
        mean = np.stack(pdf["test_mean"].to_numpy()).astype(float)
        S = np.stack(pdf["test_products"].to_numpy()).astype(float).reshape(m, p + 1, p + 1)
        form = np.column_stack([-beta, np.ones(m)])  # error = form . (x, y), up to a constant
        off = mean[:, p] - pdf["ybar"].to_numpy(float) - (beta * (mean[:, :p] - mu)).sum(axis=1)
        res["test_sse"] = np.maximum(np.einsum("ri,rij,rj->r", form, S, form), 0.0) + pdf["test_n"].to_numpy(float) * off**2
        res["test_sst"] = S[:, p, p]
    res["sd"] = list(sd)
    res["w"] = list(w)
    res["iterations"] = steps
    res["converged"] = ~active if model == "lasso" else np.ones(m, dtype=bool)
    return res


def fit_linear(train: DataFrame, keys: Sequence[str], features: Sequence[str], model: str = "ridge",
               alpha: float | None = None, alpha_col: str | None = None, label: str = "label",
               max_iter: int = 1000, tol: float = 1e-10) -> DataFrame:
    """Fit ridge (``alpha`` default 1.0) or lasso (default 0.001) per group.

    Returns keys, n, mu[], sd[], ybar, w[] (coefficients on standardised
    features), iterations and ``converged`` (false where lasso stopped at
    ``max_iter``; ridge is solved directly).  ``alpha_col`` names a key column holding alpha per group
    (used by the grid search, where alpha is one of the keys).
    """
    if model not in ("ridge", "lasso"):
        raise ValueError("model must be 'ridge' or 'lasso'")
    a = alpha if alpha is not None else (1.0 if model == "ridge" else 0.001)
    return _solved(partial_stats(train, keys, features, label), list(keys), len(features), model, a, alpha_col, None, 0, None, max_iter, tol)


def fit_walk_forward(blocks: DataFrame, keys: Sequence[str], features: Sequence[str], folds: int, model: str = "ridge",
                     alphas: Sequence[float] | None = None, alpha_col: str | None = None, label: str = "label",
                     max_iter: int = 1000, tol: float = 1e-10, fills: DataFrame | None = None) -> DataFrame:
    """Coefficients of every (keys, fold[, alpha]): fold f is trained on the
    rows of blocks 0 to f - 1 (column ``fold`` of ``blocks`` is the block), with
    the rows, squared error and total sum of squares of its test block
    (test_n, test_sse, test_sst).  ``fills`` (see :func:`fold_fills`) imputes."""
    default = 1.0 if model == "ridge" else 0.001
    return _solved(partial_stats(blocks, [*keys, "fold"], features, label, fills is not None), list(keys), len(features), model, default, alpha_col, "fold",
                   folds, list(alphas) if alphas else None, max_iter, tol, fills)


def _solved(parts: DataFrame, keys: list[str], p: int, model: str, alpha: float, alpha_col: str | None, block: str | None, folds: int,
            alphas: list[float] | None, max_iter: int, tol: float, fills: DataFrame | None = None) -> DataFrame:
    """Merge the parts of each group and solve; ``alphas`` fans out after the merge."""
    def doubles(*names: str) -> list[T.StructField]:
        return [T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]

    own = [f for f in parts.schema.fields if f.name in keys or f.name == block]
    tests = [T.StructField("test_n", T.LongType())] if block else []
    scores = [T.StructField("test_sse", T.DoubleType()), T.StructField("test_sst", T.DoubleType())] if block else []
    schema = T.StructType([*own, *([T.StructField("alpha", T.DoubleType())] if alphas else []), T.StructField("n", T.LongType()), *doubles("mu"),
                           T.StructField("ybar", T.DoubleType()), *doubles("sd", "w"), T.StructField("iterations", T.LongType()),
                           T.StructField("converged", T.BooleanType()), *tests, *scores])
    names = schema.fieldNames()

    def solve_merged(stats: pd.DataFrame) -> pd.DataFrame:
        if alphas:
            stats = stats.loc[np.repeat(np.arange(len(stats)), len(alphas))].reset_index(drop=True)
            stats["alpha"] = np.tile(alphas, len(stats) // len(alphas))
        return _solve_rows(stats, p, model, "alpha" if alphas else alpha_col, alpha, max_iter, tol)[names]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stats in _merged_groups(frames, keys, block, folds):
            yield solve_merged(stats)

    order = [*keys, block] if block else keys
    dealt = parts.repartition(*keys).sortWithinPartitions(*order)
    if fills is None:
        return dealt.mapInPandas(solve, schema)
    merged = T.StructType([*own, T.StructField("n", T.LongType()), *doubles("mu"), T.StructField("ybar", T.DoubleType()), *doubles("sxx", "sxy"),
                           *tests, *doubles("test_mean", "test_products")])
    columns = merged.fieldNames()

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stats in _merged_groups(frames, keys, block, folds):
            yield stats[columns]

    def solve_filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stats in frames:
            for lo in range(0, len(stats), 500):
                yield solve_merged(_filled(stats.iloc[lo:lo + 500].reset_index(drop=True), p))

    return dealt.mapInPandas(merge, merged).join(fills, [c for c in order if c in fills.columns]).mapInPandas(solve_filled, schema)


def _knots(G: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Penalties (falling) and coefficients at the corners of one lasso path,
    from where the first coefficient leaves zero down to ``least``.

    Between corners the active coefficients are linear in the penalty.  A corner
    is where a feature's correlation with the residual reaches the penalty (it
    joins) or an active coefficient reaches zero (it leaves)."""
    w, at = np.zeros(len(b)), float(np.abs(b).max(initial=0.0))
    alphas, coefs = [at], [w.copy()]
    if at <= least:
        return np.array(alphas), np.array(coefs)
    first = int(np.abs(b).argmax())
    active, sign, left = [first], {first: float(np.sign(b[first]))}, -1
    tiny = 1e-12 * at
    for _ in range(50 * len(b) + 50):
        A = np.array(active, dtype=int)
        s = np.array([sign[j] for j in active])
        move = np.linalg.lstsq(G[np.ix_(A, A)], s, rcond=1e-14)[0]  # d w / d (-penalty)
        c, slope = b - G @ w, G[:, A] @ move
        step, event = at - least, None
        for k, j in enumerate(active):
            if w[j] * move[k] < 0 and (t := -w[j] / move[k]) < step:
                step, event = t, (j, 0.0)
        for j in np.setdiff1d(np.arange(len(b)), A):
            for side in (1.0, -1.0):
                pace = 1.0 - side * slope[j]
                if pace <= 1e-12 or (j == left and side == sign[j]):
                    continue  # it never catches up, or has just left on this side
                t = max((at - side * c[j]) / pace, 0.0)
                if t < step:
                    step, event = t, (int(j), side)
        w[A] += step * move
        at -= step
        if step > tiny or event is None:
            alphas.append(at)
            coefs.append(w.copy())
        if event is None:
            break
        j, side = event
        if side:
            active.append(j)
            sign[j], left = side, -1
        else:
            active.remove(j)
            w[j], left = 0.0, j
            if not active:
                break
    return np.array(alphas), np.array(coefs)


def lasso_path(train: DataFrame, keys: Sequence[str], features: Sequence[str], alphas: Sequence[float] | None = None, label: str = "label",
               least: float = 1e-4) -> DataFrame:
    """The lasso of every group at all ``alphas``, from one homotopy path over
    its merged statistics; without ``alphas`` a row per corner of the path down
    to ``least``.

    keys, alpha, n, mu[], ybar, sd[], w[] as :func:`fit_linear` returns them,
    ``alpha_max`` (from there on all coefficients are zero), ``objective``
    (half the mean squared error plus the penalty, less half the label's
    variance), ``gap`` (duality gap where no correlation exceeds the penalty) and
    ``excess`` (by how much the largest correlation does).  Constant features
    and empty correlations keep zero coefficients."""
    keys, p = list(keys), len(features)
    wanted = None if alphas is None else sorted({float(a) for a in alphas}, reverse=True)
    parts = partial_stats(train, keys, features, label)
    arrays = T.ArrayType(T.DoubleType())
    fields = [("alpha", T.DoubleType()), ("n", T.LongType()), ("mu", arrays), ("ybar", T.DoubleType()), ("sd", arrays), ("w", arrays),
              *((c, T.DoubleType()) for c in ("alpha_max", "objective", "gap", "excess"))]
    schema = T.StructType([*(parts.schema[k] for k in keys), *(T.StructField(c, kind) for c, kind in fields)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stats in _merged_groups(frames, keys, None, 0):
            n, mu, sd, G, b = _standardised(stats, p)
            out = []
            for i, (key, ybar) in enumerate(zip(stats[keys].itertuples(index=False, name=None), stats["ybar"])):
                Gi, bi = G[i] / n[i], b[i] / n[i]
                corners, held = _knots(Gi, bi, wanted[-1] if wanted else least)
                rows = zip(corners, held) if wanted is None else [
                    (a, np.array([np.interp(-a, -corners, held[:, j]) for j in range(p)])) for a in wanted]
                for a, w in rows:
                    c = bi - Gi @ w
                    size = float(np.abs(w).sum())
                    out.append((*key, float(a), int(n[i]), mu[i].tolist(), float(ybar), sd[i].tolist(), w.tolist(), float(corners[0]),
                                float(0.5 * w @ Gi @ w - bi @ w + a * size), float(a * size - w @ c), float(max(np.abs(c).max(initial=0.0) - a, 0.0))))
            yield pd.DataFrame(out, columns=schema.names)

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


HELD_NUMBERS = 8_000_000  # coefficients that may go to every task (64 MB)


def absolute_errors(rows: DataFrame, coefs: DataFrame, keys: Sequence[str], features: Sequence[str], extra: Sequence[str] = (),
                    label: str = "label") -> DataFrame:
    """keys, extra, mae of the rows under their group's coefficients.

    Coefficients go to every task if they are few (counted first): a batch is
    scored by one product per group and sends on one sum.  Else rows and
    coefficients are joined."""
    keys, extra, p = list(keys), list(extra), len(features)
    count = coefs.count()
    if count * (p + 1) > HELD_NUMBERS:
        e = predict_linear(rows.select(*keys, *features, label), coefs, keys, features, extra=extra)
        return e.where(F.col("prediction").isNotNull() & F.col(label).isNotNull()).groupBy(*keys, *extra).agg(F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("mae"))
    held: dict[tuple, list] = {}
    for r in coefs.select(*keys, *extra, "mu", "sd", "ybar", "w").collect():
        beta = np.array(r["w"]) / np.array(r["sd"])
        held.setdefault(tuple(r[k] for k in keys), []).append((tuple(r[k] for k in extra), r["ybar"] - beta @ np.array(r["mu"]), beta))
    shared = rows.sparkSession.sparkContext.broadcast(held)
    few = rows.select(*keys, *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate([*features, label])])
    schema = T.StructType([*[few.schema[k] for k in keys], *[coefs.schema[c] for c in extra], T.StructField("s", T.DoubleType()), T.StructField("c", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[[f"_v{j}" for j in range(p + 1)]].to_numpy(dtype=float)
            x, frame = x[good := ~np.isnan(x).any(axis=1)], frame.loc[good, keys].reset_index(drop=True)
            out = []
            for key, at in frame.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                for more, constant, beta in shared.value.get(key, []):
                    out.append((*key, *more, float(np.abs(x[at, p] - constant - x[at, :p] @ beta).sum()), len(at)))
            yield pd.DataFrame(out, columns=schema.names)

    return few.mapInPandas(run, schema).groupBy(*keys, *extra).agg((F.sum("s") / F.sum("c")).alias("mae"))


def linear_prediction(features: Sequence[str]) -> Column:
    """``ybar + sum_j w_j (x_j - mu_j) / sd_j`` from the joined coefficient columns."""
    terms = [F.element_at("w", j + 1) * (F.col(c) - F.element_at("mu", j + 1)) / F.element_at("sd", j + 1)
             for j, c in enumerate(features)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.col("ybar") + total


def predict_linear(rows: DataFrame, coefs: DataFrame, keys: Sequence[str], features: Sequence[str],
                   out: str = "prediction", extra: Sequence[str] = ()) -> DataFrame:
    """Score ``rows`` with the coefficients of their group (equi-join on
    ``keys``); ``extra`` columns of the coefficients (an alpha) come along."""
    c = coefs.select(*keys, *extra, "mu", "sd", "ybar", "w")
    j = rows.join(c, list(keys), "left")  # a group without coefficients keeps its rows, prediction NULL
    return j.withColumn(out, linear_prediction(features)).drop("mu", "sd", "ybar", "w")
