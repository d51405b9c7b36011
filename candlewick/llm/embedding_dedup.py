"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine
verification, connected components.

Equal vectors of one label are collapsed first (a class with a count).  Every
class is hashed in several tables; a code is the signs of the products with a
table's random hyperplanes.  Classes that share (label, table, code) form a
bucket, and every pair of a bucket is verified by its cosine in double
precision.  Large buckets are dealt into parts and compared part by part, so
no task holds more than two parts; no bucket is cut.  A pair that meets in
several tables counts in the first one only, which the codes themselves tell.

A bucket hands on a count of links per class and a spanning forest of its
links, never all of its pairs, so a dense group stays linear.  Components come
from the forests.

``bits`` follows the number of classes and ``tables`` the wanted chance to
meet a pair at the threshold (``recall``).

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and are their own
component; vectors of different lengths do not link; repeated rows are equal
vectors and link; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import cut, stored
from candlewick.llm.components import components

THRESHOLD = 0.98
PART = 1024


def sizes(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): about 64 classes a code, and tables enough that a pair
    at the threshold meets with the wanted chance."""
    bits = min(20, max(6, math.ceil(math.log2(max(classes, 1) / 64 + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _scaled(vectors: list) -> np.ndarray:
    """The vectors over their largest component, so that no norm overflows or vanishes."""
    v = np.stack(vectors).astype(float)
    return v / np.abs(v).max(axis=1, keepdims=True)


def _codes(bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.zeros((len(frame), tables), np.int32)
            size = frame["embedding"].map(len).to_numpy(int)
            for d in np.unique(size):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * bits))
                at = np.flatnonzero(size == d)
                signs = _scaled(frame["embedding"].iloc[at].to_list()) @ planes[d] > 0
                out[at] = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits))
            yield pd.DataFrame({"rep": frame["rep"], "codes": list(out)})

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    left, edges = linked.any(axis=1), []
    while left.any():
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front:
            here = front.pop()
            new = np.flatnonzero(linked[here] & left)
            left[new] = False
            edges += [(here, int(j)) for j in new]
            front += new.tolist()
    return edges


def _compared(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one bucket (or two of its parts): counts and a forest."""
    v = _scaled(rows["embedding"].to_list())
    v /= np.linalg.norm(v, axis=1)[:, None]
    codes = np.stack(rows["codes"].to_list())
    part, lo, hi = rows["part"].to_numpy(), rows["lo"].iloc[0], rows["hi"].iloc[0]
    linked = v @ v.T >= threshold
    np.fill_diagonal(linked, False)
    if lo != hi:
        linked &= part[:, None] != part[None, :]
    i, j = np.nonzero(linked)
    t = int(rows["tab"].iloc[0])
    if t and len(i):
        for a in range(0, len(i), 1 << 18):
            s = slice(a, a + (1 << 18))
            earlier = (codes[i[s], :t] == codes[j[s], :t]).any(axis=1)
            linked[i[s][earlier], j[s][earlier]] = False
    counts = linked @ rows["copies"].to_numpy()
    ids = rows["rep"].to_numpy()
    some = np.flatnonzero(counts)
    edges = _forest(linked) if len(some) else []
    return pd.DataFrame({
        "a": np.concatenate([ids[some], ids[[e[0] for e in edges]]]) if edges else ids[some],
        "b": pd.array([None] * len(some) + [int(ids[e[1]]) for e in edges], dtype="Int64"),
        "n": np.concatenate([counts[some], np.zeros(len(edges), np.int64)]).astype(np.int64)})


_BUCKET = ["label", "dim", "tab", "code", "lo", "hi"]


def _buckets(threshold: float):
    """Runs of equal bucket columns of a sorted partition."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            keys = frame[_BUCKET].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            held = frame.iloc[edges[-1]:]
            found = [_compared(frame.iloc[a:b], threshold) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]
            if found:
                yield pd.concat(found, ignore_index=True)
        if held is not None and len(held) > 1:
            yield _compared(held, threshold)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9999, part: int = PART,
                    seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    own = vectors.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    own = own.withColumn("ok", usable).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    key = ["label", "h1", "h2"]
    classes = stored(own.where("ok").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))

    bits, tables = sizes(classes.count(), threshold, recall)
    kinds = dict(classes.dtypes)
    coded = (classes.select("rep", "embedding").mapInPandas(_codes(bits, tables, seed), f"rep {kinds['rep']}, codes array<int>")
             .join(classes.select("rep", "label", "copies", "embedding"), "rep"))
    spread = coded.select("*", F.size("embedding").alias("dim"), F.posexplode("codes").alias("tab", "code"))
    bucket = ["label", "dim", "tab", "code"]
    large = spread.groupBy(*bucket).agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    spread = spread.join(large, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(seed)), "parts").cast("int"))
    spread = (spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")))
    ready = spread.select(*_BUCKET, "part", "rep", "copies", "embedding", "codes").repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)
    found = stored(ready.mapInPandas(_buckets(threshold), f"a {kinds['rep']}, b {kinds['rep']}, n long"))

    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    named = (classes.select(*key, "rep", "copies").join(links, F.col("rep") == F.col("a"), "left")
             .join(parts, F.col("rep") == F.col("node"), "left")
             .select(*(F.col(k).alias(f"_{k}") for k in key), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
                     F.coalesce("component", "rep").alias("_component")))
    named = cut(named)
    out = own.join(named, F.col("ok") & (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
