"""Hard-negative mining with angular triangle filtering.

Every vector is stored with its norm and its angles to ``REFERENCES`` fixed
directions.  By the triangle inequality the angle between an anchor and a row
lies between the largest difference of their stored angles and the smallest
sum; the cosines of that interval times the norms bound the score (the inner
product).  Rows are kept in the order of (nearest direction, angle to it) and
taken in tiles of ``TILE``; a tile has the interval of its rows.  Bounds are
widened by more than the rounding of angles and cosines, so that a tile is left
out only where none of its scores can count.  The other tiles are scored in
integers.

Anchors go out in blocks of bounded size, one broadcast a block, against all
rows, twice:

1. *Positives*: the best ``positives`` rows of the anchor's label.  A tile counts
   while its upper bound reaches the anchor's last kept score.
2. *Negatives*: for each positive the best rows of other labels whose score lies
   in a window relative to the positive's score.  A tile counts for an anchor
   where its bounds overlap one of the anchor's windows, each cut off below at
   the last kept score.

A task sends on at most ``positives`` (times ``negatives``) rows per anchor; a
window function picks among them.  The references come from a sample of at most
``SAMPLE`` rows (they steer the bounds, not the results).

Defined cases: rows with a null vec_id, label or vector, or with a null or
non-finite component take no part; nor do vectors whose norm is 2**31 or more
(their scores may not fit 64 bits); rows with one vec_id count once, with the
smallest label, then vector; a zero or empty vector scores 0; vectors of
different lengths are never partners; anchors without positives, and positives
without rows in their window, give no rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import bound_batches, released, stored

REFERENCES = 16
SAMPLE = 2048
TILE = 256
ANCHORS = 20_000  # of a block, if ANCHOR_BYTES allows
ANCHOR_BYTES = 32_000_000
HELD = 400_000  # candidates a task holds before it keeps the best
LARGEST = 2.0**31
SLACK = 1e-6  # radians; angles of doubles are off by 2e-8 at most


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, one a vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return one.select("vec_id", "r.label", "r.embedding")


def directions(sample: list[np.ndarray], count: int = REFERENCES) -> np.ndarray:
    """Unit vectors, each the sampled one farthest from those before it."""
    v = np.stack(sample)
    norm = np.linalg.norm(v, axis=1)
    v = v[norm > 0] / norm[norm > 0][:, None]
    if not len(v):
        return np.zeros((0, len(sample[0])))
    picked, near = [0], v @ v[0]
    while len(picked) < min(count, len(v)):
        new = int(np.argmin(near))
        picked.append(new)
        near = np.maximum(near, v @ v[new])
    return v[picked]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), float).reshape(n, -1) if n else np.zeros((0, 0))


_STORED = "vec_id long, label long, dim int, q array<double>, norm double, angles array<double>, near int, angle double"


def _measured(shared, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.diff(whole.column("embedding").offsets.to_numpy())
            for d in np.unique(size):
                b = whole.take(pa.array(np.flatnonzero(size == d)))
                q = np.floor(scale * _matrix(b.column("embedding"))) if d else np.zeros((b.num_rows, 0))
                big = np.abs(q).max(axis=1, initial=0)
                norm = np.linalg.norm(q / np.maximum(big, 1)[:, None], axis=1) * np.maximum(big, 1)
                good = np.isfinite(norm) & (norm < LARGEST)
                b, q, norm = b.filter(pa.array(good)), q[good] + 0.0, norm[good]
                refs = shared.value.get(int(d), np.zeros((0, int(d))))
                cos = np.where(norm[:, None] > 0, q @ refs.T / np.maximum(norm, 1)[:, None], 0.0)
                angles = np.arccos(np.clip(cos, -1.0, 1.0))
                near = angles.argmin(axis=1) if len(refs) else np.zeros(len(q), int)
                angle = angles.min(axis=1, initial=9.0)
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id"), b.column("label"), pa.array(np.full(len(q), d), pa.int32()), pa.array(list(q), pa.list_(pa.float64())), pa.array(norm),
                    pa.array(list(angles), pa.list_(pa.float64())), pa.array(near, pa.int32()), pa.array(angle)],
                    names=[c.split()[0] for c in _STORED.split(", ")])

    return run


def measured(vectors: DataFrame, scale: float = 256.0, count: int = REFERENCES, seed: int = 7) -> DataFrame:
    """The stored table: components ``floor(scale * x)``, norm, angles to the
    references, in the order of (length, nearest reference, angle to it)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stored(clean(vectors))
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("embedding").collect():
        sample.setdefault(len(r[0]), []).append(np.asarray(r[0], float))
    shared = spark.sparkContext.broadcast({d: directions(v, count) for d, v in sample.items()})
    out = rows.mapInArrow(released(_measured(shared, scale)), _STORED)
    order = ["dim", "near", "angle", "vec_id"]
    return stored(stored(out).repartitionByRange(*order).sortWithinPartitions(*order))


@dataclass
class Block:
    """Anchors of one length, with the windows of their positives."""
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    angles: np.ndarray
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))  # (anchors, positives), low > high: none
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    def bounds(self, norm: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with rows of these norms and angles."""
        if angles.shape[1]:
            least, most = angles.min(axis=0), angles.max(axis=0)
            near = np.maximum(self.angles - most, least - self.angles).max(axis=1) - SLACK
            far = np.minimum(self.angles + most, 2 * np.pi - self.angles - least).min(axis=1) + SLACK
            top, bottom = np.cos(np.clip(near, 0, np.pi)), np.cos(np.clip(far, 0, np.pi))
        else:
            top, bottom = np.ones(len(self.ids)), -np.ones(len(self.ids))
        a, b = norm.min(), norm.max()
        high = self.norm * top * np.where(top >= 0, b, a)
        low = self.norm * bottom * np.where(bottom >= 0, a, b)
        wide = 1 + 1e-9 * self.norm * b
        return low - wide, high + wide

    def scores(self, which: np.ndarray, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Exact inner products (anchors, rows)."""
        own = self.q[which]
        if not len(which) or self.norm[which].max() * norm.max() < 2.0**53:  # sums of doubles below 2**53 are exact
            return (own @ q.T).astype(np.int64)
        return (own.astype(np.int64).astype(object) @ q.T.astype(np.int64).astype(object)).astype(np.int64)


def kept_best(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Of rows (group, score, id) the best ``k`` of each group: higher scores,
    then smaller ids."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
    first = np.flatnonzero(new)
    return rows[np.arange(len(rows)) - first[np.cumsum(new) - 1] < k]


def _searched(shared, k: int, negatives: bool):
    """Best rows of each anchor (or anchor and positive) in a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = shared.value
        none = np.zeros((0, 3), np.int64)
        held = {d: [none] for d in blocks}
        size = dict.fromkeys(blocks, 0)
        groups = {d: b.low.shape[1] if negatives else 1 for d, b in blocks.items()}
        least = {d: (b.low.copy() if negatives else np.full((len(b.ids), 1), -(1 << 62))) for d, b in blocks.items()}

        def trim(d: int) -> None:
            best = kept_best(held[d], k)
            group, n = np.unique(best[:, 0], return_counts=True)
            full = group[n == k]
            last = best[np.searchsorted(best[:, 0], full, "right") - 1, 1]
            flat = least[d].reshape(-1)
            flat[full] = np.maximum(flat[full], last)
            held[d], size[d] = [best], 0

        for whole in batches:
            dims = whole.column("dim").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                d = int(dims[x]) if y > x else -1
                if d not in blocks:
                    continue
                block, part = blocks[d], whole.slice(x, y - x)
                ids, labels, norm = (part.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
                q, angles = _matrix(part.column("q")), _matrix(part.column("angles"))
                for a in range(0, len(ids), TILE):
                    t = slice(a, a + TILE)
                    low, high = block.bounds(norm[t], angles[t])
                    if negatives:
                        use = ((high[:, None] >= least[d]) & (low[:, None] <= block.high) & (least[d] <= block.high)).any(axis=1)
                    else:
                        use = high >= least[d][:, 0]
                    which = np.flatnonzero(use)
                    if not len(which):
                        continue
                    score = block.scores(which, q[t], norm[t])
                    same = block.labels[which][:, None] == labels[t][None]
                    fits = ~same if negatives else same & (block.ids[which][:, None] != ids[t][None])
                    for g in range(groups[d]):
                        ok = fits & (score >= least[d][which, g][:, None])
                        if negatives:
                            ok &= score <= block.high[which, g][:, None]
                        i, j = np.nonzero(ok)
                        if len(i):
                            held[d].append(np.stack([which[i] * groups[d] + g, score[i, j], ids[t][j]], axis=1))
                            size[d] += len(i)
                            if size[d] > HELD:
                                trim(d)
                    if size[d] > HELD // 20:
                        trim(d)
        for d in blocks:
            trim(d)
            best = held[d][0]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[d].ids[best[:, 0] // groups[d]]), pa.array((best[:, 0] % groups[d]).astype(np.int32)),
                                              pa.array(best[:, 1]), pa.array(best[:, 2])], names=["anchor_id", "slot", "score", "id"])

    return run


_BEST = "anchor_id long, slot int, score long, id long"


def _ranked(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), F.col("id").asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def anchor_blocks(rows: DataFrame, every: int) -> Iterator[dict[int, Block]]:
    """The anchors by length, in blocks of bounded size."""
    anchors = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "label", "dim", "q", "norm", "angles"))
    count, total = anchors.agg(F.count("*"), F.sum((F.col("dim") + REFERENCES + 8) * 8)).first()
    parts = max(-(-count // ANCHORS), -(-(total or 0) // ANCHOR_BYTES))
    for part in range(parts):
        by_dim: dict[int, list] = {}
        for r in anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").collect():
            by_dim.setdefault(r["dim"], []).append(r)
        if by_dim:
            yield {d: Block(np.array([r["vec_id"] for r in v], np.int64), np.array([r["label"] for r in v], np.int64), np.array([r["q"] for r in v]).reshape(len(v), d),
                            np.array([r["norm"] for r in v]), np.array([r["angles"] for r in v]).reshape(len(v), -1)) for d, v in by_dim.items()}


def _windows(block: Block, found: dict[int, list], least: int, most: int) -> None:
    """Score windows [least %, most %] of the positives' scores."""
    wide = max((len(v) for v in found.values()), default=0)
    block.low, block.high = np.ones((len(block.ids), wide), np.int64), np.zeros((len(block.ids), wide), np.int64)
    for i, a in enumerate(block.ids.tolist()):
        for j, (_, score) in enumerate(found.get(a, [])):
            block.low[i, j], block.high[i, j] = -(-least * score // 100), most * score // 100


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score: for every anchor (vec_id divisible by ``every``) and each of
    its best ``positives`` rows of the same label, the best ``negatives`` rows of
    other labels with ``least`` % to ``most`` % of the positive's score."""
    spark = vectors.sparkSession
    rows = measured(vectors, scale)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for blocks in anchor_blocks(rows, every):
        shared = spark.sparkContext.broadcast(blocks)  # at most ANCHORS anchors, about ANCHOR_BYTES
        best = _ranked(rows.mapInArrow(released(_searched(shared, positives, False)), _BEST), positives)
        found: dict[int, list] = {}
        for r in best.orderBy("anchor_id", "rank").collect():  # ``positives`` rows an anchor of the block
            found.setdefault(r["anchor_id"], []).append((r["id"], r["score"]))
        shared.unpersist()
        for block in blocks.values():
            _windows(block, found, least, most)
        named = spark.createDataFrame([(a, j, i, s) for a, v in found.items() for j, (i, s) in enumerate(v)],
                                      "anchor_id long, slot int, positive_id long, positive_score long")
        shared = spark.sparkContext.broadcast(blocks)
        hard = _ranked(rows.mapInArrow(released(_searched(shared, negatives, True)), _BEST), negatives)
        out = out.unionByName(hard.join(named, ["anchor_id", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


def shifted(vectors: DataFrame) -> DataFrame:
    """The vectors with the next label (modulo 10) where vec_id is divisible by 7."""
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", label.alias("label"))
