"""Regression trees per group: forests and (regularised) boosting, all groups,
folds and parameter points in one plan (M2, M3, M6).

Features are binned once: quantile edges per group, then one byte a value.
``packed`` holds the bins as rows of bounded size (``CHUNK`` rows of one group),
which every fit, fold and grid point reads.  A tree grows level by level: sums
of gradients and Hessians per (node, feature, bin), the best split of each node,
the next level.  For squared loss the gradient is the residual and the Hessian
the row's weight.

Gradients are integers (fixed point, scaled to the group's labels), so a
histogram is the same however rows are cut up.  A group of one chunk is
therefore grown inside a task, one task per (group, job); a group of several is
grown by one histogram aggregate a level over (job, tree, node, feature), with
the same result.

Sampling is by hash of (seed, tree, row position): rows without replacement for
boosting, Poisson counts for the bootstrap of a forest; features per tree or per
node.  Sampling and binning differ from scikit-learn's, the split criterion and
the leaf values do not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.session import ensure_checkpoint_dir

BINS = 128
CHUNK = 200_000  # rows of a packed row (22 features: 4.4 MB of bins)
REFRESH = 25  # rounds after which the running predictions of a cut-up group are stored
BATCH = 8  # trees of a forest grown at once over a cut-up group
SCORED = 10_000  # rows scored at once
BROADCAST_NODES = 4_000_000  # nodes of all models that may go to every task (about 100 MB)
_U = np.uint64


@dataclass(frozen=True)
class TreeParams:
    """``l1``, ``l2`` and ``min_weight`` (Hessian a child needs) regularise;
    ``tree_features`` and ``node_features`` are shares of the features."""
    boost: bool
    trees: int
    depth: int
    min_weight: float = 1.0
    split_weight: float = 2.0
    rate: float = 1.0
    rows: float = 1.0
    bootstrap: bool = False
    tree_features: float = 1.0
    node_features: float | str = 1.0
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 42

    @property
    def width(self) -> int:
        return 2 ** (self.depth + 1) - 1


@dataclass(frozen=True)
class Job:
    """A fit: a parameter point, trained on the blocks before ``fold`` (0: on all rows)."""
    point: int
    fold: int
    params: TreeParams


# --- packed rows --------------------------------------------------------------------

def packed(rows: DataFrame, keys: Sequence[str], features: Sequence[str], block: str | None = None, label: str = "label",
           position: str = "i", chunk: int | None = None, bins: int = BINS) -> DataFrame:
    """keys, chunk, chunks, n (rows of the group), top (largest |label|), edges,
    and arrays of the chunk's rows: position, dt, block, label, x (bins).

    Rows with a missing feature or label are left out.  The edges are quantiles
    over all rows of the group (of the features only)."""
    keys, features = list(keys), list(features)
    size = chunk or CHUNK
    good = rows.select(*keys, F.col(position).cast("long").alias("position"), "dt", F.col(block).cast("int").alias("block") if block else F.lit(0).alias("block"),
                       F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)])
    for c in ["label", *[f"_x{j}" for j in range(len(features))]]:
        good = good.where(F.col(c).isNotNull() & ~F.isnan(c))
    steps = [k / bins for k in range(1, bins)]
    cuts = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("label")).alias("top"),
                                   F.array(*[F.array_distinct(F.percentile_approx(f"_x{j}", steps, 10_000)) for j in range(len(features))]).alias("edges"))
    cuts = _kept(cuts.withColumn("chunks", F.ceil(F.col("n") / size).cast("int")))  # one row a group, read twice
    dealt = good.join(cuts.select(*keys, "chunks"), keys).withColumn("chunk", F.pmod(F.xxhash64("position"), "chunks").cast("int"))
    dealt = dealt.drop("chunks")
    own = [f"_of_{k}" for k in keys]
    spread = cuts.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], "n", "top", "edges", "chunks",
                         F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("_of_chunk"))
    p = len(features)

    def pack(mine: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(cut):
            return pd.DataFrame(columns=names)
        mine = mine.sort_values("position", kind="stable")
        edges = [np.asarray(e, float) for e in cut["edges"].iloc[0]]
        x = np.column_stack([np.searchsorted(edges[j], mine[f"_x{j}"].to_numpy(float), "left") for j in range(p)]).astype(np.uint8)
        return pd.DataFrame([[*mine[keys].iloc[0], mine["chunk"].iloc[0], cut["chunks"].iloc[0], cut["n"].iloc[0], cut["top"].iloc[0], [e.tolist() for e in edges],
                              mine["position"].to_numpy("<i8").tobytes(), mine["dt"].to_list(), mine["block"].to_numpy("<i4").tobytes(),
                              mine["label"].to_numpy("<f8").tobytes(), x.tobytes()]], columns=names)

    schema = T.StructType([good.schema[k] for k in keys] + [
        T.StructField("chunk", T.IntegerType()), T.StructField("chunks", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("top", T.DoubleType()),
        T.StructField("edges", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("position", T.BinaryType()),
        T.StructField("dt", T.ArrayType(good.schema["dt"].dataType)), T.StructField("block", T.BinaryType()), T.StructField("label", T.BinaryType()),
        T.StructField("x", T.BinaryType())])
    names = schema.fieldNames()
    return dealt.groupBy(*keys, "chunk").cogroup(spread.groupBy(*own, "_of_chunk")).applyInPandas(pack, schema)


@dataclass
class Rows:
    """A packed row as arrays."""
    position: np.ndarray
    block: np.ndarray
    label: np.ndarray
    x: np.ndarray
    n: int
    top: float
    cuts: np.ndarray  # edges per feature

    @staticmethod
    def of(r) -> Rows:
        label = np.frombuffer(r["label"], "<f8")
        return Rows(np.frombuffer(r["position"], "<i8"), np.frombuffer(r["block"], "<i4"), label,
                    np.frombuffer(r["x"], np.uint8).reshape(len(label), -1), int(r["n"]), float(r["top"]), np.array([len(e) for e in r["edges"]]))

    @cached_property
    def base(self) -> np.ndarray:
        return self.x + np.arange(self.x.shape[1]) * BINS

    @property
    def unit(self) -> float:
        """Fixed-point units of one label: sums over the group stay below 2**52."""
        return 2.0 ** (47 - int(np.ceil(np.log2(max(self.n, 2)))) - int(np.ceil(np.log2(max(self.top, 1e-30)))))

    def train(self, fold: int) -> np.ndarray:
        return np.ones(len(self.label), bool) if fold == 0 else self.block < fold


# --- sampling -----------------------------------------------------------------------

def _mixed(*parts) -> np.ndarray:
    """A 64-bit hash of integers and integer arrays."""
    h = np.zeros((), _U)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.int64).astype(_U)) * _U(0x9E3779B97F4A7C15)
            h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
            h = h ^ (h >> _U(32))
    return h


def row_weights(p: TreeParams, tree: int, position: np.ndarray) -> np.ndarray:
    """Times that each row is drawn for a tree."""
    if not p.bootstrap and p.rows >= 1.0:
        return np.ones(len(position))
    u = _mixed(p.seed, tree, position) / 2.0**64
    if not p.bootstrap:
        return (u < p.rows).astype(float)
    # Poisson counts: their distribution function at 0, 1, 2, ...
    steps = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(16)])
    return np.searchsorted(steps, u, "right").astype(float)


def allowed_features(p: TreeParams, tree: int, first: int, nodes: int, features: int) -> np.ndarray:
    """(nodes, features): the features that the nodes first, first + 1, ... may split on."""
    ok = np.ones((nodes, features), bool)
    if p.tree_features < 1.0:
        order = np.argsort(_mixed(p.seed, -1 - tree, np.arange(features)))
        ok[:, order[max(1, int(p.tree_features * features)):]] = False
    m = max(1, int(np.sqrt(features) if p.node_features == "sqrt" else p.node_features * features))
    if m < features:
        order = np.argsort(_mixed(p.seed, tree, (first + np.arange(nodes))[:, None], -np.arange(features)[None]), axis=1)
        np.put_along_axis(ok, order[:, m:], False, axis=1)
    return ok


# --- growing ------------------------------------------------------------------------

def histogram(base: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """(2, nodes, features, bins): sums of gradients and weights; node < 0 is
    left out.  ``base`` is ``bins`` per feature, counted on from feature to feature."""
    f = base.shape[1]
    use = np.flatnonzero((node >= 0) & (h > 0))
    at = (node[use, None] * (f * BINS) + base[use]).ravel()
    size = nodes * f * BINS
    return np.stack([np.bincount(at, np.repeat(v[use], f), size).reshape(nodes, f, BINS) for v in (g, h)])


def level_sums(rows: Rows, p: TreeParams, depth: int, place: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Histogram of a level; the last one splits no more, so one feature gives its totals."""
    return histogram(rows.base[:, :1] if depth == p.depth else rows.base, place, g, h, 2**depth)


def level_splits(sums: np.ndarray, p: TreeParams, tree: int, depth: int, unit: float, cuts: np.ndarray) -> dict[str, np.ndarray]:
    if depth == p.depth:
        return best_splits(sums, p, unit, np.zeros(1, int), np.zeros((2**depth, 1), bool))
    return best_splits(sums, p, unit, cuts, allowed_features(p, tree, 2**depth - 1, 2**depth, len(cuts)))


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def best_splits(sums: np.ndarray, p: TreeParams, unit: float, cuts: np.ndarray, ok: np.ndarray) -> dict[str, np.ndarray]:
    """Per node: feature (-1: a leaf), bin, gain, value, weight.  ``ok`` names
    the same number of features for every node."""
    nodes, f, b = sums.shape[1:]
    total = sums[:, :, 0].sum(axis=2)
    l1 = p.l1 * unit

    def score(g, h):
        return np.divide(_soft(g, l1) ** 2, h + p.l2, out=np.zeros_like(g), where=h + p.l2 > 0)

    own = score(*total)
    out = {"feature": np.full(nodes, -1), "bin": np.zeros(nodes, int), "gain": np.zeros(nodes), "weight": total[1],
           "value": np.divide(_soft(total[0], l1), total[1] + p.l2, out=np.zeros(nodes), where=total[1] + p.l2 > 0) / unit}
    least = max(p.min_weight, 1e-9)
    live = np.flatnonzero((total[1] >= p.split_weight) & (total[1] >= 2 * least))
    if not len(live) or not ok.any():
        return out
    which = np.nonzero(ok[live])[1].reshape(len(live), -1)  # the features of each node, in order
    left = np.cumsum(sums[:, live[:, None], which], axis=3)
    right = total[:, live, None, None] - left
    gain = score(*left) + score(*right)
    gain[(left[1] < least) | (right[1] < least) | (np.arange(b) >= cuts[which][:, :, None])] = -np.inf
    gain = gain.reshape(len(live), -1)
    at = gain.argmax(axis=1)
    best = gain[np.arange(len(live)), at] - own[live]
    split = best > 1e-12 * np.maximum(own[live], 1.0)
    node, at = live[split], at[split]
    out["feature"][node], out["bin"][node] = which[split, at // b], at % b
    out["gain"][node] = best[split] / unit**2
    return out


class Trees:
    """Trees of a fit: heap-ordered nodes (children of k: 2k + 1, 2k + 2)."""

    def __init__(self, p: TreeParams) -> None:
        self.p, self.init = p, 0.0
        self.nodes = {c: np.zeros((p.trees, p.width)) for c in ("value", "weight", "gain")}
        self.nodes["feature"] = np.full((p.trees, p.width), -1)
        self.nodes["bin"] = np.zeros((p.trees, p.width), int)

    def place(self, x: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """Node of each row after so many levels (a leaf above stays)."""
        at = np.zeros(len(x), int)
        feature, cut = self.nodes["feature"][tree], self.nodes["bin"][tree]
        for _ in range(levels):
            f = feature[at]
            inner = f >= 0
            down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
            at = np.where(inner, down, at)
        return at

    def level(self, x: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """Place within the level of that depth, -1 for rows in a leaf above."""
        at = self.place(x, tree, depth)
        return np.where(at >= 2**depth - 1, at - (2**depth - 1), -1)

    def take(self, tree: int, depth: int, best: dict[str, np.ndarray]) -> bool:
        """Puts a level in; whether any node of it splits."""
        first = 2**depth - 1
        for c, v in best.items():
            self.nodes[c][tree, first:first + len(v)] = v
        return bool((best["feature"] >= 0).any())

    def scored(self, x: np.ndarray, first: int = 0, upto: int | None = None) -> np.ndarray:
        """Sum of the trees' leaf values (boosting: times the rate)."""
        out = np.zeros(len(x))
        for t in range(first, self.p.trees if upto is None else upto):
            out += self.p.rate * self.nodes["value"][t][self.place(x, t, self.p.depth)]
        return out

    def predicted(self, x: np.ndarray) -> np.ndarray:
        return self.init + self.scored(x) if self.p.boost else self.scored(x) / self.p.trees


def gradients(rows: Rows, mask: np.ndarray, trees: Trees, tree: int, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point gradients and weights of the rows for one tree."""
    p = trees.p
    h = row_weights(p, tree, rows.position) * mask
    goal = rows.label - trees.init - running if p.boost else rows.label
    return np.rint(goal * rows.unit) * h, h


def grown(rows: Rows, job: Job) -> Trees:
    """A fit over rows that one task holds."""
    out, mask, p = Trees(job.params), rows.train(job.fold), job.params
    if p.boost:
        out.init = float(np.rint(rows.label[mask] * rows.unit).sum() / rows.unit / max(mask.sum(), 1))
    running = np.zeros(len(rows.label))
    for t in range(p.trees):
        g, h = gradients(rows, mask, out, t, running)
        at = np.zeros(len(g), int)  # node of the heap; rows in finished leaves stay
        for depth in range(p.depth + 1):
            first = 2**depth - 1
            sums = level_sums(rows, p, depth, np.where(at >= first, at - first, -1), g, h)
            if not out.take(t, depth, level_splits(sums, p, t, depth, rows.unit, rows.cuts)):
                break
            f = out.nodes["feature"][t][at]
            at = np.where(f >= 0, 2 * at + 1 + (rows.x[np.arange(len(at)), np.maximum(f, 0)] > out.nodes["bin"][t][at]), at)
        if p.boost:
            running += p.rate * out.nodes["value"][t][at]
    return out


def _fields(keys: list[T.StructField]) -> T.StructType:
    return T.StructType([*keys, *[T.StructField(c, T.IntegerType()) for c in ("point", "fold", "trees", "width")], T.StructField("boost", T.BooleanType()),
                         T.StructField("rate", T.DoubleType()), T.StructField("init", T.DoubleType()), T.StructField("train_rows", T.LongType()),
                         T.StructField("feature", T.ArrayType(T.IntegerType())),
                         *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("threshold", "value", "weight", "gain")]])


def _model_row(key: tuple, job: Job, trees: Trees, edges: list, train_rows: int) -> tuple:
    feature, cut = trees.nodes["feature"].ravel(), trees.nodes["bin"].ravel()
    threshold = [float(edges[f][b]) if f >= 0 else None for f, b in zip(feature.tolist(), cut.tolist())]
    return (*key, job.point, job.fold, job.params.trees, job.params.width, job.params.boost, job.params.rate, trees.init, train_rows, feature.tolist(), threshold,
            *(trees.nodes[c].ravel().tolist() for c in ("value", "weight", "gain")))


def fit_trees(data: DataFrame, keys: Sequence[str], jobs: Sequence[Job]) -> DataFrame:
    """Models of every (group, job) over a ``packed`` table: keys, point, fold,
    trees, width (nodes of a tree), boost, rate, init, train_rows and the flat
    node arrays feature, threshold (left: at most), value, weight, gain."""
    keys, jobs = list(keys), list(jobs)
    schema = _fields([data.schema[k] for k in keys])
    data = _kept(data)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                rows, job = Rows.of(r), jobs[r["_job"]]
                n = int(rows.train(job.fold).sum())
                if n:
                    yield pd.DataFrame([_model_row(tuple(r[k] for k in keys), job, grown(rows, job), r["edges"], n)], columns=schema.names)

    whole = data.where("chunks = 1").withColumn("_job", F.explode(F.sequence(F.lit(0), F.lit(len(jobs) - 1))))
    spark = data.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = whole.drop("dt").repartition(tasks, *keys, "_job").mapInPandas(fit, schema)
    cut = data.where("chunks > 1")
    if cut.limit(1).count():
        out = out.unionByName(_grown_apart(cut, keys, jobs, schema))
    return out


def _kept(df: DataFrame) -> DataFrame:
    """Checkpoint files: read by every round and by the lazy results."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _grown_apart(data: DataFrame, keys: list[str], jobs: list[Job], schema: T.StructType) -> DataFrame:
    """Fits of groups of several chunks: one histogram aggregate a level."""
    spark = data.sparkSession
    about = {tuple(r[k] for k in keys): r for r in data.where("chunk = 0").select(*keys, "n", "top", "edges").collect()}
    names = T.StructType([data.schema[k] for k in keys])
    first = data.select(*keys, "n", "top", "edges", "position", "block", "label", "x")

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                rows = Rows.of(r)
                yield pd.DataFrame([(*(r[k] for k in keys), j, float(np.rint(rows.label[m] * rows.unit).sum()), int(m.sum()))
                                    for j, m in enumerate(rows.train(job.fold) for job in jobs)], columns=[*keys, "job", "s", "n"])

    simple = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
    begun = first.mapInPandas(starts, f"{simple}, job int, s double, n long").groupBy(*keys, "job").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    models: dict[tuple, tuple[Trees, int]] = {}
    for r in begun.where("n > 0").collect():
        key, job = tuple(r[k] for k in keys), jobs[r["job"]]
        unit = Rows(None, None, None, None, about[key]["n"], about[key]["top"], None).unit
        trees = Trees(job.params)
        trees.init = r["s"] / unit / r["n"] if job.params.boost else 0.0
        models[key, r["job"]] = (trees, r["n"])
    state = first.withColumn("running", F.lit(None).cast("binary"))  # boosting: scores of the trees before ``done``
    done, tree, most = 0, 0, max(j.params.trees for j in jobs)
    while tree < most:
        # trees grown side by side: several of a forest, one of boosting
        side = BATCH if all(not j.params.boost for j in jobs) else 1
        now = range(tree, min(tree + side, most))
        for depth in range(max(j.params.depth for j in jobs) + 1):
            shared = spark.sparkContext.broadcast((models, done, list(now), depth))

            def level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                models, done, now, depth = shared.value
                for frame in frames:
                    for r in frame.to_dict("records"):
                        rows, key = Rows.of(r), tuple(r[k] for k in keys)
                        for j, job in enumerate(jobs):
                            for t in now:
                                if (key, j) not in models or t >= job.params.trees or depth > job.params.depth:
                                    continue
                                trees = models[key, j][0]
                                if depth and not (trees.nodes["feature"][t, 2 ** (depth - 1) - 1:2**depth - 1] >= 0).any():
                                    continue
                                running = _running(r, j, len(jobs), len(rows.label)) + trees.scored(rows.x, done, t) if job.params.boost else 0.0
                                g, h = gradients(rows, rows.train(job.fold), trees, t, running)
                                sums = level_sums(rows, job.params, depth, trees.level(rows.x, t, depth), g, h)
                                f = sums.shape[2]
                                yield pd.DataFrame({**{k: [v] * f for k, v in zip(keys, key)}, "job": j, "tree": t, "f": range(f),
                                                    "sums": [np.ascontiguousarray(sums[:, :, c]).tobytes() for c in range(f)]})

            def added(frame: pd.DataFrame) -> pd.DataFrame:
                total = sum(np.frombuffer(b, float) for b in frame["sums"])
                return frame.iloc[:1].assign(sums=[total.tobytes()])

            sums_schema = f"{simple}, job int, tree int, f int, sums binary"
            merged = state.mapInPandas(level, sums_schema).groupBy(*keys, "job", "tree", "f").applyInPandas(added, sums_schema).collect()
            shared.unpersist()
            if not merged:
                break
            by_tree: dict[tuple, dict[int, np.ndarray]] = {}
            for r in merged:
                by_tree.setdefault((tuple(r[k] for k in keys), r["job"], r["tree"]), {})[r["f"]] = np.frombuffer(r["sums"], float).reshape(2, 2**depth, BINS)
            for (key, j, t), parts in by_tree.items():
                sums = np.stack([parts[f] for f in range(len(parts))], axis=2)
                a, p = about[key], jobs[j].params
                unit = Rows(None, None, None, None, a["n"], a["top"], None).unit
                cuts = np.array([len(e) for e in a["edges"]])
                models[key, j][0].take(t, depth, level_splits(sums, p, t, depth, unit, cuts))
        tree = now[-1] + 1
        if side == 1 and tree - done >= REFRESH and tree < most:
            state, done = _kept(_advanced(state, spark.sparkContext.broadcast((models, done, tree)), keys, jobs)), tree
    return spark.createDataFrame([_model_row(key, jobs[j], trees, about[key]["edges"], n) for (key, j), (trees, n) in models.items()], schema)


def _running(r: dict, job: int, jobs: int, n: int) -> np.ndarray:
    return np.zeros(n) if r["running"] is None else np.frombuffer(r["running"], "<f8").reshape(jobs, n)[job]


def _advanced(state: DataFrame, shared, keys: list[str], jobs: list[Job]) -> DataFrame:
    """The packed rows with the scores of all trees so far."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, done, upto = shared.value
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                rows, key = Rows.of(r), tuple(r[k] for k in keys)
                out.append(np.concatenate([_running(r, j, len(jobs), len(rows.label)) + (
                    models[key, j][0].scored(rows.x, done, min(upto, job.params.trees)) if (key, j) in models and job.params.boost else 0.0)
                    for j, job in enumerate(jobs)]).astype("<f8").tobytes())
            yield frame.assign(running=out)

    return state.mapInPandas(run, state.schema)


# --- scoring ------------------------------------------------------------------------

class Flat:
    """A model row's node arrays, for scoring raw feature values."""

    def __init__(self, r) -> None:
        self.trees, self.width, self.boost, self.rate, self.init = (r[c] for c in ("trees", "width", "boost", "rate", "init"))
        shape = (self.trees, self.width)
        self.feature = np.asarray(r["feature"], np.int16).reshape(shape)
        self.threshold = np.array([np.nan if v is None else v for v in r["threshold"]]).reshape(shape)
        self.value = np.asarray(r["value"], float).reshape(shape)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        at = np.zeros((len(x), self.trees), int)
        tree = np.arange(self.trees)[None]
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                return at
            with np.errstate(invalid="ignore"):
                right = ~(np.take_along_axis(x, np.maximum(f, 0), axis=1) <= self.threshold[tree, at])
            at = np.where(inner, 2 * at + 1 + right, at)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions; a row with a missing value has none."""
        parts = []
        for lo in range(0, len(x), SCORED):
            some = x[lo:lo + SCORED]
            total = self.value[np.arange(self.trees)[None], self.leaves(some)].sum(axis=1)
            parts.append(np.where(np.isnan(some).any(axis=1), np.nan, self.init + self.rate * total if self.boost else total / self.trees))
        return np.concatenate(parts) if parts else np.zeros(0)


def _by_key(models: DataFrame, keys: list[str]) -> dict[tuple, Flat] | None:
    """The models by key, if their nodes are few enough for every task."""
    nodes = models.agg(F.sum(F.size("feature"))).first()[0] or 0
    return {tuple(r[k] for k in keys): Flat(r) for r in models.collect()} if nodes <= BROADCAST_NODES else None


def predict_trees(rows: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], out: str = "prediction") -> DataFrame:
    """``rows`` with the prediction of their group's model; NULL where the group
    has none or a feature is missing.  Models go to every task if they are small
    (counted first); else rows meet their model in salted groups."""
    keys, features = list(keys), list(features)
    models = _kept(models.select(*keys, "trees", "width", "boost", "rate", "init", "feature", "threshold", "value"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def scored(frame: pd.DataFrame, model: Flat | None) -> pd.DataFrame:
        value = model.predict(frame[features].to_numpy(float)) if model is not None else np.full(len(frame), np.nan)
        return frame.assign(**{out: pd.Series([None if np.isnan(v) else v for v in value], index=frame.index, dtype=object)})[schema.names]

    held = _by_key(models, keys)
    if held is not None:
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for key, part in frame.groupby(keys, sort=False, dropna=False):
                    yield scored(part, shared.value.get(key))

        return rows.mapInPandas(run, schema)
    salts = 64
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    own = [f"_of_{k}" for k in keys]
    spread = models.withColumnsRenamed(dict(zip(keys, own))).withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        return scored(frame.drop(columns="_salt"), Flat(model.iloc[0]) if len(model) else None)

    return salted.groupBy(*keys, "_salt").cogroup(spread.groupBy(*own, "_of_salt")).applyInPandas(meet, schema)


def score_blocks(data: DataFrame, models: DataFrame, keys: Sequence[str], test_only: bool = True) -> DataFrame:
    """keys, point, fold, dt, label, prediction of the rows of block ``fold``
    (those a fold's model is tested on), from the packed bins."""
    keys = list(keys)
    held = models.select(*keys, *[c for c in models.columns if c not in (*keys, "gain", "weight", "train_rows")])
    both = data.join(held, keys)
    schema = T.StructType([data.schema[k] for k in keys] + [T.StructField("point", T.IntegerType()), T.StructField("fold", T.IntegerType()),
                          T.StructField("dt", data.schema["dt"].dataType.elementType), T.StructField("label", T.DoubleType()), T.StructField("prediction", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                rows, model = Rows.of(r), Flat(r)
                use = np.flatnonzero(rows.block == r["fold"]) if test_only else np.arange(len(rows.label))
                # a bin number stands for its values: the bin of a threshold is its place among the edges
                model.threshold = np.array([[np.searchsorted(r["edges"][f], v) if f >= 0 else np.nan for f, v in zip(fs, vs)]
                                            for fs, vs in zip(model.feature.tolist(), model.threshold.tolist())])
                dt = list(r["dt"])
                yield pd.DataFrame({**{k: [r[k]] * len(use) for k in keys}, "point": r["point"], "fold": r["fold"], "dt": [dt[i] for i in use],
                                    "label": rows.label[use], "prediction": model.predict(rows.x[use].astype(float))}, columns=schema.names)

    return both.mapInPandas(run, schema)
