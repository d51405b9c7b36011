"""Model registry, pipelines, walk-forward CV, hold-out back-test, training
and random search (M1-M7, V4-V7).

Two scopes (see README):

* ``scope="symbol"`` (ridge, lasso): one model per symbol, as in the
  reference, fitted for every symbol, fold and alpha in one Spark plan by
  :mod:`candlewick.operators.linear`.
  Forests and boosting have it too, grown by :mod:`candlewick.operators.trees`
  with the reference's full presets and grids (penalties, column share).
* ``scope="panel"`` (every model, the default for trees): one Spark ML
  pipeline over all symbols; folds are still positions *within* each
  symbol, so fold ``f`` trains on every symbol's first rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import linear
from candlewick.operators import metrics as met
from candlewick.operators import supervised as sv
from candlewick.operators import trees as tr
from candlewick.schema import FEATURES
from candlewick.session import ensure_checkpoint_dir

SEED = 42
PANEL_PARTITIONS = 8  # of the rows of a pooled boosting fit, or
PANEL_ROWS = 50_000  # rows each (22 features: 9 MB), if those are more


# --- registry (M7) ---------------------------------------------------------------

def _forest(**kw):
    p = dict(numTrees=100, maxDepth=6, minInstancesPerNode=5, featureSubsetStrategy="all",
             subsamplingRate=1.0, bootstrap=True, maxBins=128, seed=SEED)
    p.update(kw)
    return RandomForestRegressor(**p)


def _gbt(**kw):
    p = dict(maxIter=200, stepSize=0.05, maxDepth=3, minInstancesPerNode=10, subsamplingRate=0.8,
             maxBins=128, seed=SEED)
    p.update(kw)
    return GBTRegressor(**p)


def _gbt_large(**kw):
    p = dict(maxIter=300, stepSize=0.05, maxDepth=3, minInstancesPerNode=5, subsamplingRate=0.8,
             featureSubsetStrategy="0.8", maxBins=128, seed=SEED)
    p.update(kw)
    return GBTRegressor(**p)


def _ridge(**kw):
    return LinearRegression(elasticNetParam=0.0, regParam=kw.get("regParam", 1.0), standardization=False,
                            solver="normal", fitIntercept=True)


def _lasso(**kw):
    return LinearRegression(elasticNetParam=1.0, regParam=kw.get("regParam", 0.001), standardization=False,
                            fitIntercept=True, maxIter=kw.get("maxIter", 1000), tol=1e-9)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    factory: Callable[..., object]
    grid: dict[str, list] = field(default_factory=dict)
    linear: bool = False
    default_alpha: float | None = None


# The reference's model presets and search grids, in Spark ML
# parameter names.  min_samples_split has no Spark counterpart and is left out.
MODELS: dict[str, ModelSpec] = {
    "random_forest": ModelSpec("random_forest", _forest, {
        "numTrees": [100, 200, 300], "maxDepth": [3, 5, 6], "minInstancesPerNode": [1, 5, 10],
        "featureSubsetStrategy": ["sqrt", "0.8"], "bootstrap": [True, False]}),
    "gbt": ModelSpec("gbt", _gbt, {
        "maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [2, 3, 4],
        "minInstancesPerNode": [5, 10, 20], "subsamplingRate": [0.7, 0.8, 0.9]}),
    "ridge": ModelSpec("ridge", _ridge, {"alpha": [0.1, 1.0, 10.0]}, linear=True, default_alpha=1.0),
    "lasso": ModelSpec("lasso", _lasso, {"alpha": [0.0001, 0.001, 0.01]}, linear=True, default_alpha=0.001),
    "gbt_large": ModelSpec("gbt_large", _gbt_large, {
        "maxIter": [200, 300, 400], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [2, 3, 4],
        "subsamplingRate": [0.7, 0.8, 0.9], "minInstancesPerNode": [1, 3, 5]}),
}


# The reference's tree presets and search grids per symbol.
TREE_PRESETS: dict[str, tr.TreeParams] = {
    "random_forest": tr.TreeParams(boost=False, trees=100, depth=6, min_weight=5, bootstrap=True, seed=SEED),
    "gbt": tr.TreeParams(boost=True, trees=200, rate=0.05, depth=3, min_weight=10, rows=0.8, seed=SEED),
    "gbt_large": tr.TreeParams(boost=True, trees=300, rate=0.05, depth=3, rows=0.8, tree_features=0.8, l2=1.0, l1=0.1, min_weight=5, seed=SEED),
}
TREE_GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {"trees": [100, 200, 300], "depth": [3, 5, 6], "split_weight": [2, 5, 10], "min_weight": [1, 5, 10],
                      "node_features": ["sqrt", 0.8], "bootstrap": [True, False]},
    "gbt": {"trees": [100, 200, 300], "rate": [0.01, 0.05, 0.1], "depth": [2, 3, 4], "split_weight": [2, 5, 10], "min_weight": [5, 10, 20],
            "rows": [0.7, 0.8, 0.9]},
    "gbt_large": {"trees": [200, 300, 400], "rate": [0.01, 0.05, 0.1], "depth": [2, 3, 4], "rows": [0.7, 0.8, 0.9], "tree_features": [0.7, 0.8, 0.9],
                  "l2": [0.5, 1.0, 2.0], "l1": [0.0, 0.1, 0.5], "min_weight": [1, 3, 5]},
}


def tree_params(name: str, params: dict | None = None) -> tr.TreeParams:
    """The preset of a tree model with some parameters replaced."""
    return replace(TREE_PRESETS[name], **(params or {}))


def select_model(name: str) -> ModelSpec:
    """M7: the model spec by name; an unknown name lists the choices."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; choose one of: {', '.join(MODELS)}")
    return MODELS[name]


# --- pipelines (M1) -------------------------------------------------------------

def make_pipeline(estimator, features: Sequence[str] = FEATURES, impute: str | None = None,
                  label: str = "label") -> Pipeline:
    """M1: [impute] -> assemble -> standardise -> estimator.

    After N4 no feature is missing, so imputation (``"median"``/``"mean"``)
    is off by default: it would be one more full pass for an identity.
    """
    stages = []
    cols = list(features)
    if impute:
        out = [f"_imp_{c}" for c in cols]
        stages.append(Imputer(strategy=impute, inputCols=cols, outputCols=out))
        cols = out
    stages += [
        VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]
    estimator.setFeaturesCol("features").setLabelCol(label).setPredictionCol("prediction")
    stages.append(estimator)
    return Pipeline(stages=stages)


def panel_linear_params(name: str, alpha: float, train: DataFrame, label: str = "label") -> dict:
    """Spark ML penalty that equals the scikit-learn alpha on one series.

    Spark scales the squared loss by 1/(2n) and (normal solver) divides the
    penalty by the label's standard deviation; scikit-learn's ridge uses
    the plain sum.  Spark's scaler also divides by the sample standard
    deviation where scikit-learn uses the population one, which rescales
    the coefficients by sqrt(n/(n-1)) (D28).  Hence
    regParam = alpha * std_pop(y) / n * (n-1)/n for ridge (equal to the
    closed form to 1e-11 in the tests) and regParam = alpha * sqrt((n-1)/n)
    for lasso.
    """
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    n = max(r["n"], 2)
    if name == "lasso":
        return {"regParam": alpha * ((n - 1) / n) ** 0.5}
    return {"regParam": alpha * (r["s"] or 1.0) / n * (n - 1) / n}


# --- fitted models ------------------------------------------------------------

@dataclass
class Fitted:
    """A fitted model that scores any frame with the feature columns."""

    name: str
    scope: str
    features: list[str]
    coefs: DataFrame | None = None       # symbol scope: keys, mu, sd, ybar, w
    keys: list[str] = field(default_factory=lambda: ["symbol"])
    model: PipelineModel | None = None   # panel scope
    fills: DataFrame | None = None       # symbol scope with imputation: keys, _fill_<feature>
    trees: DataFrame | None = None       # symbol scope, tree models: keys, flat node arrays

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.trees is not None:
            if self.fills is not None:
                df = linear.fill_missing(df, self.fills, self.keys, self.features)
            return tr.predict_trees(df, self.trees, self.keys, self.features, out)
        if self.coefs is not None:
            if self.fills is not None:
                df = linear.fill_missing(df, self.fills, self.keys, self.features)
            return linear.predict_linear(df, self.coefs, self.keys, self.features, out)
        scored = self.model.transform(df)
        drop = [c for c in ("_raw", "features") + tuple(f"_imp_{c}" for c in self.features) if c in scored.columns]
        scored = scored.drop(*drop)
        return scored if out == "prediction" else scored.withColumnRenamed("prediction", out)


def _filled(train: DataFrame, keys: Sequence[str], features: Sequence[str], impute: str | None) -> tuple[DataFrame | None, DataFrame]:
    if not impute:
        return None, train
    fills = linear.fill_values(train, list(keys), list(features), impute)
    return fills, linear.fill_missing(train, fills, list(keys), list(features))


def fit(name: str, train: DataFrame, features: Sequence[str] = FEATURES, scope: str | None = None,
        keys: Sequence[str] = ("symbol",), params: dict | None = None, impute: str | None = None) -> Fitted:
    """Fit one model per ``keys`` group (symbol scope) or one over all rows (panel)."""
    spec = select_model(name)
    scope = scope or ("symbol" if spec.linear else "panel")
    params = dict(params or {})
    if scope == "symbol":
        if not spec.linear:
            fills, train = _filled(train, keys, features, impute)
            data = tr.packed(train, keys, features)
            return Fitted(name, scope, list(features), keys=list(keys), fills=fills, trees=tr.fit_trees(data, keys, [tr.Job(0, 0, tree_params(name, params))]))
        if "alpha_by_symbol" in params:  # (symbol, alpha): the penalty is one more group column
            fills, train = _filled(train, keys, features, impute)
            tuned = train.join(params["alpha_by_symbol"].select("symbol", "alpha"), "symbol")
            coefs = linear.fit_linear(tuned, [*keys, "alpha"], list(features), name, alpha_col="alpha")
            return Fitted(name, scope, list(features), coefs=coefs, keys=list(keys), fills=fills)
        alpha = params.get("alpha", spec.default_alpha)
        fills, train = _filled(train, keys, features, impute)
        coefs = linear.fit_linear(train, list(keys), list(features), name, alpha=alpha)
        return Fitted(name, scope, list(features), coefs=coefs, keys=list(keys), fills=fills)
    if spec.linear:
        params = panel_linear_params(name, params.get("alpha", spec.default_alpha), train)
    # Boosting re-reads its input every round: cache only the columns the fit
    # uses for the duration of the fit (lost blocks are recomputed from lineage).
    of = [c for c in (*keys, "dt") if c in train.columns]
    cached = train.select(*dict.fromkeys([*of, *features, "label"])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pipeline = make_pipeline(spec.factory(**params), features, impute)
        model = _boosted(pipeline, cached, keys) if isinstance(pipeline.getStages()[-1], GBTRegressor) else pipeline.fit(cached)
    finally:
        cached.unpersist()
    return Fitted(name, "panel", list(features), model=model)


def _boosted(pipeline: Pipeline, rows: DataFrame, keys: Sequence[str]) -> PipelineModel:
    """The pipeline with its boosting fitted on stored vectors.

    Boosting runs ``depth`` jobs a round, one after the other, so a round costs
    what its tasks cost to start: their number follows the rows, and each task
    carries the plan of a stored table instead of that of the feature table."""
    *steps, estimator = pipeline.getStages()
    ensure_checkpoint_dir(rows.sparkSession)
    prepared = Pipeline(stages=steps).fit(rows)
    vectors = prepared.transform(_dealt(rows, keys)).select("features", estimator.getLabelCol()).checkpoint(eager=True)
    return PipelineModel([*prepared.stages, estimator.fit(vectors)])


def _dealt(rows: DataFrame, keys: Sequence[str], always: bool = False) -> DataFrame:
    """``rows`` in no more partitions than their number asks for, whatever the
    session's shuffle partitions; fewer ones stay as they are, if not ``always``.

    Few rows are dealt by series, many row by row, however long a series is."""
    most = max(PANEL_PARTITIONS, -(-rows.count() // PANEL_ROWS))
    if not always and rows.rdd.getNumPartitions() <= most:
        return rows
    own = [c for c in keys if c in rows.columns]
    order = dict.fromkeys([*own, *[c for c in rows.columns if c == "dt"], *rows.columns])
    return rows.repartition(most, *(own if own and most == PANEL_PARTITIONS else rows.columns)).sortWithinPartitions(*order)


# --- walk-forward CV, hold-out, training (V4-V6) --------------------------------

def cv_predictions(name: str, sup: DataFrame, k: int = 5, features: Sequence[str] = FEATURES,
                   scope: str | None = None, params: dict | None = None, impute: str | None = None) -> DataFrame:
    """V4: test-block predictions of every fold (symbol, fold, dt, label, prediction).

    ``impute`` (linear models per symbol) fills missing features with the
    median or mean of the fold's training rows."""
    spec = select_model(name)
    scope = scope or ("symbol" if spec.linear else "panel")
    cols = ["symbol", "fold", "dt", "i", *features, "label"]
    if scope == "symbol" and not spec.linear:
        return tree_cv_predictions(sup, k, features, [tree_params(name, params)]).drop("point")
    if scope == "symbol":
        params = dict(params or {})
        rows = sv.blocks(sup, k)
        keys, alpha_col = ["symbol"], None
        if "alpha_by_symbol" in params:
            rows = rows.join(params["alpha_by_symbol"].select("symbol", "alpha"), "symbol")
            keys, alpha_col = ["symbol", "alpha"], "alpha"
        alphas = None if alpha_col else [float(params.get("alpha", spec.default_alpha))]
        fills = _fills(rows, features, k, impute)
        coefs = linear.fit_walk_forward(rows, keys, list(features), k, name, alphas, alpha_col, fills=fills).drop("alpha")
        test = rows.where(F.col("fold") > 0).select(*cols)
        if fills is not None:
            test = linear.fill_folds(test, fills, ["symbol"], list(features))
        return linear.predict_linear(test, coefs, ["symbol", "fold"], list(features)).select("symbol", "fold", "dt", "label", "prediction")
    _no_fills(impute)
    f = sv.folds(sup, k)
    # read by every fold's fit and by the lazy result: kept as checkpoint files, which outlive executors
    ensure_checkpoint_dir(sup.sparkSession)
    f = f.select(*cols, "role").checkpoint(eager=True)

    def one(fold: int) -> DataFrame:
        train = f.where((F.col("fold") == fold) & (F.col("role") == "train"))
        test = f.where((F.col("fold") == fold) & (F.col("role") == "test"))
        m = fit(name, train, features, "panel", params=params)
        return m.predict(test).select("symbol", "fold", "dt", "label", "prediction")

    # the folds are independent: a few driver threads keep the cluster busy between a fit's short jobs
    with ThreadPoolExecutor(min(k, 4)) as pool:
        parts = list(pool.map(one, range(1, k + 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_cv_predictions(sup: DataFrame, k: int, features: Sequence[str], points: Sequence[tr.TreeParams]) -> DataFrame:
    """V4 for tree models per symbol: test-block predictions of every (point,
    fold), all fitted over one packed table (symbol, point, fold, dt, label, prediction)."""
    ensure_checkpoint_dir(sup.sparkSession)
    data = tr.packed(sv.blocks(sup, k), ["symbol"], features, block="fold").checkpoint(eager=True)
    jobs = [tr.Job(p, f, params) for p, params in enumerate(points) for f in range(1, k + 1)]
    return tr.score_blocks(data, tr.fit_trees(data, ["symbol"], jobs), ["symbol"])


def _fills(rows: DataFrame, features: Sequence[str], k: int, impute: str | None) -> DataFrame | None:
    """The fill values of every (symbol, fold), as checkpoint files: the fit and the scores read them."""
    if not impute:
        return None
    ensure_checkpoint_dir(rows.sparkSession)
    return linear.fold_fills(rows, ["symbol"], list(features), k, impute).checkpoint(eager=True)


def _no_fills(impute: str | None) -> None:
    if impute:
        raise ValueError("imputation inside folds is for linear models per symbol")


def linear_cv(name: str, sup: DataFrame, k: int, alphas: Sequence[float], features: Sequence[str] = FEATURES, impute: str | None = None) -> DataFrame:
    """V4 of linear models per symbol: symbol, alpha, fold, n, rmse, mae, r2.

    RMSE and R^2 come from the test block's own products; one more pass over
    the rows adds the absolute errors."""
    rows = sv.blocks(sup, k)
    features = list(features)
    fills = _fills(rows, features, k, impute)
    ensure_checkpoint_dir(sup.sparkSession)
    coefs = linear.fit_walk_forward(rows, ["symbol"], features, k, name, [float(a) for a in alphas], fills=fills).where("test_n > 0").checkpoint(eager=True)
    test = rows.where(F.col("fold") > 0).select("symbol", "fold", *features, "label")
    if fills is not None:
        test = linear.fill_folds(test, fills, ["symbol"], features)
    mae = linear.absolute_errors(test, coefs, ["symbol", "fold"], features, ["alpha"])
    r2 = (F.when(F.col("test_n") < 2, F.lit(None).cast("double"))
          .when(F.col("test_sst") == 0, F.when(F.col("test_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1.0 - F.try_divide(F.col("test_sse"), F.col("test_sst"))))
    return coefs.join(mae, ["symbol", "fold", "alpha"]).select(
        "symbol", "alpha", "fold", F.col("test_n").alias("n"), F.sqrt(F.col("test_sse") / F.col("test_n")).alias("rmse"), "mae", r2.alias("r2"))


def cv_score(name: str, sup: DataFrame, k: int = 5, features: Sequence[str] = FEATURES, scope: str | None = None, params: dict | None = None,
             impute: str | None = None) -> tuple[DataFrame, DataFrame]:
    """V4: fold metrics per (symbol, fold) and their means per symbol."""
    spec = select_model(name)
    if spec.linear and scope in (None, "symbol") and "alpha_by_symbol" not in (params or {}):
        fm = linear_cv(name, sup, k, [float((params or {}).get("alpha", spec.default_alpha))], features, impute).drop("alpha")
    else:
        fm = met.regression_metrics(cv_predictions(name, sup, k, features, scope, params, impute), ["symbol", "fold"])
    return fm, met.fold_means(fm)


def backtest(name: str, sup: DataFrame, test_size: float = 0.2, features: Sequence[str] = FEATURES,
             scope: str | None = None, params: dict | None = None, impute: str | None = None) -> tuple[DataFrame, DataFrame, Fitted]:
    """V5: fit on the first 80 % of each symbol, score the rest.

    Returns (symbol, dt, actual, predicted), metrics per symbol, the model.
    """
    h = sv.holdout(sup, test_size)
    pooled_boosting = scope in (None, "panel") and isinstance(select_model(name).factory(), GBTRegressor)
    if pooled_boosting:  # read by the fit and by the lazy scores
        ensure_checkpoint_dir(sup.sparkSession)
        h = h.checkpoint(eager=True)
    train = h.where(F.col("role") == "train")
    test = h.where(F.col("role") == "test")
    if pooled_boosting:
        train = _dealt(train, ["symbol"], always=True)
    m = fit(name, train, features, scope, params=params, impute=impute)
    pred = m.predict(test)
    bt = pred.select("symbol", "dt", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return bt, met.regression_metrics(pred, ["symbol"]), m


def train_model(name: str, sup: DataFrame, k: int = 5, tune: bool = False, tune_iter: int = 10,
                features: Sequence[str] = FEATURES, scope: str | None = None, impute: str | None = None) -> tuple[Fitted, DataFrame, DataFrame]:
    """V6: CV table (per symbol and fold), means, then a fit on all rows.

    With ``tune`` the final model uses the best parameters of
    :func:`random_search`.
    """
    params = None
    if tune:
        params, table = random_search(name, sup, k, tune_iter, features=features, scope=scope, impute=impute)
        if select_model(name).linear and scope in (None, "symbol"):
            best = table.where("best").select("symbol", "alpha")
            pred = cv_predictions(name, sup, k, features, "symbol", {"alpha_by_symbol": best}, impute)
            fm = met.regression_metrics(pred, ["symbol", "fold"])
            return fit(name, sup, features, "symbol", params={"alpha_by_symbol": best}, impute=impute), fm, met.fold_means(fm)
    fm, means = cv_score(name, sup, k, features=features, scope=scope, params=params, impute=impute)
    return fit(name, sup, features, scope, params=params, impute=impute), fm, means


def grid_points(grid: dict[str, list], n_iter: int, seed: int = SEED) -> list[dict]:
    """V7: up to ``n_iter`` grid points in a seeded order (md5 of the point),
    the whole grid when it is smaller -- independent of dict order."""
    names = sorted(grid)
    pts = [dict(zip(names, combo)) for combo in itertools.product(*[grid[n] for n in names])]
    pts.sort(key=lambda p: hashlib.md5(f"{seed}|{sorted(p.items())}".encode()).hexdigest())
    return pts[:n_iter]


def random_search(name: str, sup: DataFrame, k: int = 5, n_iter: int = 10, features: Sequence[str] = FEATURES,
                  scope: str | None = None, impute: str | None = None) -> tuple[dict, DataFrame]:
    """V7: score grid points by mean walk-forward RMSE; return the best point and the score table.

    Linear models in symbol scope score every alpha of the grid for every
    symbol and fold in one plan (the statistics of a fold serve all alphas)
    and pick the best alpha per symbol.  Tree models in symbol scope fit every
    (symbol, point, fold) over one binned table, in one plan.  Panel models loop
    over the sampled points.
    """
    spec = select_model(name)
    scope = scope or ("symbol" if spec.linear else "panel")
    if not spec.linear:
        _no_fills(impute)
    if scope == "symbol" and not spec.linear:
        return _search_trees(name, sup, k, n_iter, features)
    pts = grid_points(spec.grid, n_iter)
    if scope == "symbol":
        fm = linear_cv(name, sup, k, [p["alpha"] for p in pts], features, impute)
        scores = met.fold_means(fm, ["symbol", "alpha"])
        w = Window.partitionBy("symbol").orderBy(F.col("cv_rmse").asc(), F.col("alpha").asc())
        best = scores.withColumn("_rk", F.row_number().over(w)).withColumn("best", F.col("_rk") == 1).drop("_rk")
        return {"alpha": "per symbol"}, best
    rows = []
    for p in pts:
        _, means = cv_score(name, sup, k, features=features, scope="panel", params=p)
        r = means.agg(F.avg("cv_rmse").alias("cv_rmse")).first()
        rows.append((str(sorted(p.items())), float(r["cv_rmse"]) if r["cv_rmse"] is not None else float("inf")))
    best_i = min(range(len(pts)), key=lambda i: rows[i][1])
    spark = sup.sparkSession
    table = spark.createDataFrame([(s, v, i == best_i) for i, (s, v) in enumerate(rows)],
                                  "params string, cv_rmse double, best boolean")
    return pts[best_i], table


def _search_trees(name: str, sup: DataFrame, k: int, n_iter: int, features: Sequence[str]) -> tuple[dict, DataFrame]:
    pts = grid_points(TREE_GRIDS[name], n_iter)
    pred = tree_cv_predictions(sup, k, features, [tree_params(name, p) for p in pts])
    scores = met.fold_means(met.regression_metrics(pred, ["symbol", "point", "fold"]), ["symbol", "point"])
    w = Window.partitionBy("symbol").orderBy(F.col("cv_rmse").asc(), F.col("point").asc())
    text = F.element_at(F.array(*[F.lit(str(sorted(p.items()))) for p in pts]), F.col("point") + 1)
    return {"point": "per symbol"}, scores.withColumn("best", F.row_number().over(w) == 1).withColumn("params", text)
