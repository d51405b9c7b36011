"""Explanations (X1-X5): permutation importance, contributions, narrative.

* Permutation importance: rows x repeats ranked on
  ``md5(seed|repeat|symbol|dt)`` and joined to the row position, one
  permutation for all features -- deterministic on any partitioning and in any
  engine.  Features fan out as a narrow step; R^2 per group, mean drop.
* Linear contributions: ``w_j/sd_j * (x_j - mean_background(x_j))``.
* Exact Shapley values of trees per symbol, from the boxes of their leaves.
* Sampled Shapley values (any model): for every explained row, sampled
  feature order and background row, the chain of 23 inputs that switch
  features from the background value to the explained value one at a
  time; marginal differences averaged per feature.  They sum to
  ``f(x) - mean f(background)`` by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import metrics as met
from candlewick.operators import trees as tr
from candlewick.operators.models import Fitted
from candlewick.operators.projections import seeded_sample
from candlewick.session import ensure_checkpoint_dir

SEED = 42


def permutation_importance(model: Fitted, sup: DataFrame, features: Sequence[str] | None = None,
                           repeats: int = 10, seed: int = SEED, split_ranks: bool = True,
                           rank_prefix: int = 1) -> DataFrame:
    """Mean drop of R^2 per (symbol, feature) over ``repeats`` permutations.

    One permutation per (symbol, repeat) serves all features: rows are ranked
    by a hash of their key, and row i takes its values from the row of rank i.
    Rows x repeats are ranked and joined once, carrying all feature values; the
    features fan out afterwards as a narrow step.  A per-symbol linear model
    scores a permuted feature in closed form (base prediction + w_j/sd_j *
    (new - old)); any other model gets the full row in one ``transform``.

    ``split_ranks`` ranks inside (symbol, repeat, first ``rank_prefix`` hex
    digits of the key) and adds per-prefix offsets, so no task sorts a whole
    symbol (16**rank_prefix sorts of a share each); the ranks are identical.
    """
    feats = list(features or model.features)
    # x feeds the base score, the ranks and the donor join: materialise it
    # once, as checkpoint files, instead of re-running the window lineage;
    # nothing stays cached.
    ensure_checkpoint_dir(sup.sparkSession)
    x = sup.select("symbol", "dt", "i", *[F.col(f).cast("double").alias(f) for f in feats], "label").checkpoint(eager=True)
    base_pred = model.predict(x)
    base = met.regression_metrics(base_pred, ["symbol"]).select("symbol", F.col("r2").alias("base_r2"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("symbol"), F.col("dt").cast("string")))
    new = F.array(*feats).alias("_new")
    keyed = x.select("symbol", "dt", new, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).withColumn("_key", key)
    if split_ranks:
        from candlewick.operators.segments import with_positions

        donor = with_positions(keyed, ["symbol", "rep"], ["_key", "dt"], bucket=F.substring("_key", 1, rank_prefix))
        donor = donor.select("symbol", "rep", F.col("_pos").alias("i"), "_new")
    else:
        w = Window.partitionBy("symbol", "rep").orderBy("_key", "dt")
        donor = keyed.select("symbol", "rep", (F.row_number().over(w) - 1).alias("i"), "_new")
    names = F.array(*[F.lit(f) for f in feats])
    which = F.explode(F.sequence(F.lit(1), F.lit(len(feats)))).alias("_k")
    if model.coefs is not None:
        slope = model.coefs.select("symbol", F.zip_with("w", "sd", lambda a, b: a / b).alias("_c"))
        old = base_pred.select("symbol", "i", "label", F.col("prediction").alias("_bp"), F.array(*feats).alias("_old")).join(slope, "symbol")
        long = old.join(donor, ["symbol", "i"]).select("symbol", "rep", "label", "_bp", "_old", "_new", "_c", which)
        moved = F.element_at("_c", F.col("_k")) * (F.element_at("_new", F.col("_k")) - F.element_at("_old", F.col("_k")))
        scored = long.select("symbol", "rep", "label", F.element_at(names, F.col("_k")).alias("feature"), (F.col("_bp") + moved).alias("prediction"))
    else:
        long = x.join(donor, ["symbol", "i"]).select("symbol", "dt", "rep", "label", *feats, "_new", which)
        full = long.select("symbol", "dt", "rep", "label", F.element_at(names, F.col("_k")).alias("feature"), *[
            F.when(F.col("_k") == j + 1, F.element_at("_new", j + 1)).otherwise(F.col(f)).alias(f) for j, f in enumerate(feats)])
        scored = model.predict(full)
    r2 = met.regression_metrics(scored, ["symbol", "feature", "rep"])
    mean = r2.groupBy("symbol", "feature").agg(F.avg("r2").alias("_mr2"), F.stddev_pop("r2").alias("importance_std"))
    return mean.join(base, "symbol").select(
        "symbol", "feature", (F.col("base_r2") - F.col("_mr2")).alias("importance"), "importance_std")


def rank_importance(imp: DataFrame) -> DataFrame:
    """L3: rank features by importance, descending (ties by name)."""
    w = Window.partitionBy("symbol").orderBy(F.col("importance").desc(), F.col("feature"))
    return imp.withColumn("rank", F.row_number().over(w))


def explained_rows(sup: DataFrame) -> DataFrame:
    """The latest supervised row per symbol (the reference's ``X_all.iloc[-1]``)."""
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    return sup.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def linear_contributions(model: Fitted, sup: DataFrame, background: int = 200, seed: int = SEED) -> DataFrame:
    """``phi_j = w_j/sd_j * (x_j - mean of x_j over the background sample)``."""
    if model.coefs is None:
        raise ValueError("linear contributions need a per-symbol linear model")
    feats = model.features
    bg = seeded_sample(sup, background, seed).groupBy("symbol").agg(
        *[F.avg(f).alias(f"_bg_{j}") for j, f in enumerate(feats)])
    x = explained_rows(sup).join(bg, "symbol").join(model.coefs.select("symbol", "sd", "w"), "symbol")
    phis = F.array(*[F.struct(F.lit(f).alias("feature"),
                              (F.element_at("w", j + 1) / F.element_at("sd", j + 1) * (F.col(f) - F.col(f"_bg_{j}")))
                              .alias("phi")) for j, f in enumerate(feats)])
    long = x.select("symbol", "dt", F.explode(phis).alias("p")).select("symbol", "dt", "p.feature", "p.phi")
    return rank_contributions(long)


def rank_contributions(long: DataFrame) -> DataFrame:
    """Rank by absolute contribution, descending (ties by name)."""
    w = Window.partitionBy("symbol").orderBy(F.abs("phi").desc(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w))


def sampled_shapley(model: Fitted, sup: DataFrame, orders: int = 8, background: int = 200,
                    seed: int = SEED) -> DataFrame:
    """Sampled Shapley contributions of the latest row per symbol.

    Work per symbol is explained row x ``orders`` x background rows (at most
    ``background``) x (features+1) inputs, scored in one pass.  Returns
    symbol, feature, phi, phi_se (standard error over the sampled orders, NULL
    for one), rank, plus ``base_value`` (mean prediction on the background) and
    ``prediction`` (of the explained row).  ``orders`` is our own sampling
    parameter: more orders cost in proportion and shrink phi_se.
    """
    feats = model.features
    p = len(feats)
    x = explained_rows(sup).select("symbol", *[F.col(f).alias(f"_x_{j}") for j, f in enumerate(feats)])
    z = seeded_sample(sup, background, seed).select(
        "symbol", F.col("dt").alias("_bdt"), *[F.col(f).alias(f"_z_{j}") for j, f in enumerate(feats)])
    chains = x.join(z, "symbol").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    key = [F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("symbol"), F.col("m").cast("string"),
                                      F.lit(f))).alias("h"), F.lit(j).alias("j")) for j, f in enumerate(feats)]
    chains = chains.withColumn("_order", F.transform(F.array_sort(F.array(*key)), lambda s: s["j"]))
    chains = chains.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(p))))
    inputs = chains.select(
        "symbol", "m", "_bdt", "t", "_order",
        *[F.when(F.array_position("_order", j) <= F.col("t"), F.col(f"_x_{j}")).otherwise(F.col(f"_z_{j}")).alias(f)
          for j, f in enumerate(feats)])
    scored = model.predict(inputs.withColumn("dt", F.col("_bdt")))
    w = Window.partitionBy("symbol", "m", "_bdt").orderBy("t")
    marg = scored.select("symbol", "m", "t", "_order", F.col("prediction"),
                         (F.col("prediction") - F.lag("prediction").over(w)).alias("_d"))
    ends = marg.groupBy("symbol").agg(
        F.avg(F.when(F.col("t") == 0, F.col("prediction"))).alias("base_value"),
        F.avg(F.when(F.col("t") == p, F.col("prediction"))).alias("prediction"))
    contrib = marg.where(F.col("t") > 0).select(
        "symbol", "m", F.element_at("_order", F.col("t")).alias("j"), "_d").groupBy("symbol", "j", "m").agg(
        F.avg("_d").alias("_phi")).groupBy("symbol", "j").agg(
        F.avg("_phi").alias("phi"), (F.stddev_samp("_phi") / F.sqrt(F.count(F.lit(1)))).alias("phi_se"))
    names = F.array(*[F.lit(f) for f in feats])
    long = contrib.select("symbol", F.element_at(names, F.col("j") + 1).alias("feature"), "phi", "phi_se")
    return rank_contributions(long).join(ends, "symbol")


def leaf_paths(model: tr.Flat, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaves of all trees as boxes: (leaves, features) lower bounds
    (exclusive) and upper bounds (inclusive), and each leaf's part of the
    prediction."""
    t = np.arange(model.trees)
    lo, hi = np.full((model.trees, model.width, p), -np.inf), np.full((model.trees, model.width, p), np.inf)
    real = np.zeros((model.trees, model.width), bool)
    real[:, 0] = True
    for k in range(1, model.width):
        up = (k - 1) // 2
        f, cut = model.feature[:, up], model.threshold[:, up]
        lo[:, k], hi[:, k], real[:, k] = lo[:, up], hi[:, up], real[:, up] & (f >= 0)
        on = t[real[:, k]]
        if k % 2:
            hi[on, k, f[on]] = np.minimum(hi[on, k, f[on]], cut[on])
        else:
            lo[on, k, f[on]] = np.maximum(lo[on, k, f[on]], cut[on])
    leaf = real & (model.feature < 0)
    return lo[leaf], hi[leaf], model.value[leaf] * (model.rate if model.boost else 1.0 / model.trees)


def tree_contributions(model: tr.Flat, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Shapley values of one row against the mean over background rows, exactly.

    Of a leaf and a background row only three things count: the path features
    that only the explained row satisfies (``a`` of them), those that only the
    background row satisfies (``b``), and whether one fails both.  The leaf's
    value then spreads by the share of feature orders that put a feature of the
    first kind last, (a-1)! b! / (a+b)!, and of the second kind, negatively,
    a! (b-1)! / (a+b)!.
    """
    lo, hi, value = leaf_paths(model, len(x))
    mine = (x > lo) & (x <= hi)
    most = int((np.isfinite(lo) | np.isfinite(hi)).sum(axis=1).max(initial=0)) + 1
    fact = np.cumprod(np.concatenate([[1.0], np.arange(1.0, 2 * most + 1)]))
    phi = np.zeros(len(x))
    for z in background:
        its = (z > lo) & (z <= hi)
        use = np.flatnonzero((mine | its).all(axis=1))
        plus, minus = mine[use] & ~its[use], its[use] & ~mine[use]
        a, b = plus.sum(axis=1), minus.sum(axis=1)
        up = np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b], 0.0) * value[use]
        down = np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b], 0.0) * value[use]
        phi += up @ plus - down @ minus
    return phi / max(len(background), 1)


def exact_tree_contributions(model: Fitted, sup: DataFrame, background: int = 200, seed: int = SEED) -> DataFrame:
    """X3 for tree models per symbol: exact Shapley contributions of the latest
    row against at most ``background`` rows of its symbol.

    Returns symbol, feature, phi, rank, base_value (mean prediction over the
    background), prediction; base_value + sum of phi = prediction.  A group is
    one symbol's model, explained row and background rows."""
    if model.trees is None:
        raise ValueError("exact tree contributions need tree models per symbol")
    feats = list(model.features)
    values = F.array(*[F.col(f).cast("double") for f in feats])
    x = explained_rows(sup).select("symbol", values.alias("_x"))
    z = seeded_sample(sup, background, seed).groupBy("symbol").agg(F.collect_list(values).alias("_z"))

    def explain(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.to_dict("records")[0]
        m, row, back = tr.Flat(r), np.asarray(r["_x"], float), np.array([list(v) for v in r["_z"]], float)
        return pd.DataFrame({"symbol": r["symbol"], "feature": feats, "phi": tree_contributions(m, row, back),
                             "base_value": float(m.predict(back).mean()), "prediction": float(m.predict(row[None])[0])})

    long = x.join(z, "symbol").join(model.trees, "symbol").groupBy("symbol").applyInPandas(
        explain, "symbol string, feature string, phi double, base_value double, prediction double")
    return rank_contributions(long)


def narrative(contrib: DataFrame, target_type: str = "return", currency: Column | None = None,
              top: int = 5) -> DataFrame:
    """Top-``top`` lines "- **feature** increased/decreased the forecast by ~v"
    in rank order, one text per symbol (``%`` for returns, money for prices)."""
    cur = currency if currency is not None else F.lit("$")
    amount = F.format_string("%.2f", F.round(F.abs(F.col("phi")), 2))
    val = F.concat(amount, F.lit("%")) if target_type == "return" else F.concat(cur, amount)
    line = F.concat(F.lit("- **"), F.col("feature"), F.lit("** "),
                    F.when(F.col("phi") > 0, F.lit("increased")).otherwise(F.lit("decreased")),
                    F.lit(" the forecast by ~"), val)
    t = contrib.where(F.col("rank") <= top).select("symbol", "rank", line.alias("line"))
    g = t.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_l"))
    return g.select("symbol", F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("narrative"))


def net_effect(contrib: DataFrame) -> DataFrame:
    """Sum of contributions; > 0 is a bullish bias, else bearish."""
    g = contrib.groupBy("symbol").agg(F.sum("phi").alias("net_effect"))
    return g.withColumn("bias", F.when(F.col("net_effect") > 0, F.lit("bullish")).otherwise(F.lit("bearish")))
