"""Quality rules by robust multivariate outliers (minimum covariance determinant).

Every document gets a few statistics of its whole text.  Fixed base rules
reject documents of too few words or too much repetition.  For the rest, a
vector of transformed shares (angular transform, drawn towards the corpus rate
by ``PRIOR`` pseudo-words so that short texts are not extreme by chance) is
compared with its unit: the documents of one language and source.

Location and scatter of a unit are a minimum-covariance-determinant estimate:
starting from medians and absolute deviations, concentration steps keep the
``SUPPORT`` share of the unit's documents that lie nearest by Mahalanobis
distance and take their mean and covariance anew.  Each step is a pair of
grouped aggregations over all rows, so a source holding a third of all
documents is summed map-side and never gathered.  The scatter has a floor per
dimension (most texts have no symbols at all, the plain determinant would be
zero).  Documents whose squared distance, scaled to the support's median,
exceeds ``CUTOFF`` are rejected.

Vectors are whole numbers (1/1024 units), so sums are exact and reruns agree.

Units of fewer than ``LEAST`` documents are pooled by language, and what is
still too small into one rest unit; a rest unit below LEAST rejects nothing.

Defined cases: null and empty texts have zero words and fail the base rules;
null language or source are values of their own; repeated rows are judged one
by one and alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import words as W
from candlewick.llm.common import bound_batches, cut, released, stored

SLICE_BYTES = 1_000_000
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of the words
SCALE = 1024
PRIOR = 30
STEPS = 4
SUPPORT = 0.75
LEAST = 60
MAX_UNITS = 20_000  # rows of about 0.5 KB: a broadcast of 10 MB at most
#: upper 1e-6 point of chi-squared with six degrees of freedom, doubled for heavy tails
CUTOFF = 2 * 38.26
MEDIAN = 5.348  # median of the same distribution
#: name, least standard deviation in transformed units (wider for digits and marks, which a
#: number, an address or a key brings into ordinary text)
SHARES = (("symbols", 0.06), ("capitals", 0.06), ("digits", 0.12), ("marks", 0.12), ("repeated", 0.08))
DIMS = ["x0", "x1", "x2", "x3", "x4", "x5"]
FLOORS = [s[1] for s in SHARES] + [0.08]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _class(SYMBOLS)
_CAPITAL = _class(bytes(range(65, 91)))
_DIGIT = _class(b"0123456789")
_MARK = _class(b"!?;:\"'()[]{}=+~^_/\\@")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_digits", "n_marks"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[offsets])


def _twice(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more in its row, not the first there) of each hash."""
    key = W.mix64(hashes ^ W.mix64(row.astype(np.uint64)))
    _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return count[which] > 1, later


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row, over its whole text."""
    rows = len(offsets) - 1
    w = W.split(data, offsets)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
    chars = np.bincount(w.row, weights=point[w.ends] - point[w.starts], minlength=rows)[:rows].astype(np.int64)

    # lines: split at newlines and row borders
    cuts = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, cuts, "right") - 1])
    row = row[np.argsort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")]
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(row[1:] == row[:-1], starts[1:] - 1, offsets[row[:-1] + 1])
    if len(ends):
        ends[-1] = offsets[-1]
    lines = W.Words(starts, ends, row, np.zeros(0), np.zeros(0))
    began = np.zeros(len(data) + 1, np.int64)
    began[w.starts + 1] = 1
    began = np.cumsum(began)
    worded = np.flatnonzero(began[ends] > began[starts])
    hashes = W.word_hashes(data, lines)[worded] if len(data) else np.zeros(0, np.uint64)
    later = _twice(row[worded], hashes)[1] if len(worded) else np.zeros(0, bool)
    dup = np.bincount(row[worded][later], minlength=rows)[:rows]

    repeat = np.zeros(rows, np.int64)
    grams = W.gram_hashes(W.word_hashes(data, w), 5)
    at = np.flatnonzero(W.inside_rows(w, 5))
    if len(at):
        at = at[_twice(w.row[at], grams[at])[0]]
        edge = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + 5, 1)
        repeat = np.bincount(w.row[np.cumsum(edge[:-1]) > 0], minlength=rows)[:rows]
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": _per_row(_SYMBOL[data], offsets), "n_dup_lines": dup,
            "n_repeat_words": repeat, "n_capitals": _per_row(_CAPITAL[data], offsets), "n_digits": _per_row(_DIGIT[data], offsets),
            "n_marks": _per_row(_MARK[data], offsets)}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, reach = W.utf8(whole.column("text"))
            for lo, hi in W.slices(reach, SLICE_BYTES):
                b = whole.slice(lo, hi - lo)
                found = text_statistics(*W.utf8(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                                                 names=["doc_id", "lang", "source", *COUNTS])

    kinds = dict(docs.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source"))
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(released(run), f"{head}, " + ", ".join(f"{c} long" for c in COUNTS))


def _vectors(rows: DataFrame) -> DataFrame:
    """The transformed vector of each row as whole numbers."""
    parts = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "digits": ("n_digits", "word_chars"),
             "marks": ("n_marks", "word_chars"), "repeated": ("n_repeat_words", "n_words")}
    rates = rows.agg(*(F.sum(c).alias(c) for c in COUNTS)).collect()[0]
    out = rows
    for k, (name, _) in enumerate(SHARES):
        top, under = parts[name]
        rate = (rates[top] or 0) / max(1, rates[under] or 0)
        prior = PRIOR * (1 if under == "n_words" else 5)
        share = F.least(F.lit(1.0), (F.col(top) + F.lit(prior * rate)) / (F.col(under) + prior))
        out = out.withColumn(DIMS[k], F.round(F.asin(F.sqrt(share)) * SCALE).cast("long"))
    mean = (rates["word_chars"] or 0) / max(1, rates["n_words"] or 0)
    length = (F.col("word_chars") + F.lit(PRIOR * max(mean, 1.0))) / (F.col("n_words") + PRIOR)
    return out.withColumn(DIMS[-1], F.round(F.log(length) * SCALE).cast("long"))


def _units(rows: DataFrame) -> DataFrame:
    """Rows with ``unit``: language and source, else language, else the rest."""
    own = F.to_json(F.array(F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))))
    pool = F.to_json(F.array(F.coalesce("lang", F.lit("\x00"))))
    rows = rows.withColumn("own", own).withColumn("pool", pool)
    counts = rows.groupBy("own", "pool").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < LEAST)
    pools = small.groupBy("pool").agg(F.sum("n").alias("m"))
    named = counts.join(pools, "pool", "left").select("own", F.when(F.col("n") >= LEAST, F.col("own"))
                                                     .when(F.col("m") >= LEAST, F.col("pool")).otherwise(F.lit("rest")).alias("unit"))
    return rows.join(_sized(named, counts.count()), "own").drop("own", "pool")


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x, centre and inverse."""
    p = len(DIMS)
    diff = [F.col(DIMS[i]) / SCALE - F.col("centre")[i] for i in range(p)]
    total = None
    for i in range(p):
        for j in range(i, p):
            term = diff[i] * diff[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2)
            total = term if total is None else total + term
    return total


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse covariance (with the floors) from exact sums."""
    p = len(DIMS)
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            n = float(r.n)
            mean = np.array([float(s) for s in r.sums]) / n
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = np.array([float(s) for s in r.products]) / n
            cov = (np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)) / SCALE ** 2
            inverse = np.linalg.inv(cov + np.diag(np.square(FLOORS)))
            rows.append((r.unit, (mean / SCALE).tolist(), inverse.ravel().tolist()))
        yield pd.DataFrame(rows, columns=["unit", "centre", "inverse"])


def _sized(units: DataFrame, n: int) -> DataFrame:
    """Broadcast one row a unit while there are few units; else a plain join,
    whose hot units adaptive execution splits."""
    return F.broadcast(units) if n <= MAX_UNITS else units


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """unit, centre, inverse, middle (median squared distance of the support
    scaled as a whole unit's) for units of LEAST rows or more."""
    p = len(DIMS)
    units = rows.select("unit").distinct().count()
    big = rows.groupBy("unit").agg(F.count("*").alias("n"), *(F.percentile(d, F.lit(0.5)).alias(f"m{i}") for i, d in enumerate(DIMS)))
    big = big.where(F.col("n") >= LEAST).drop("n")
    spread = rows.join(_sized(big, units), "unit").groupBy("unit").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(p)),
        *(F.percentile(F.abs(F.col(d) - F.col(f"m{i}")), F.lit(0.5)).alias(f"s{i}") for i, d in enumerate(DIMS)))
    variance = [F.pow(1.4826 * F.col(f"s{i}") / SCALE, 2) + FLOORS[i] ** 2 for i in range(p)]
    start = spread.select("unit", F.array(*(F.col(f"m{i}") / SCALE for i in range(p))).alias("centre"),
                          F.array(*(1 / variance[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p))).alias("inverse"))
    now = cut(start)
    for _ in range(steps):
        far = rows.join(_sized(now, units), "unit").withColumn("d", F.round(_distance() * 64).cast("long"))
        edge = far.groupBy("unit").agg(F.percentile(F.least("d", F.lit(1 << 14)), F.lit(SUPPORT)).alias("edge"))
        near = far.join(_sized(edge, units), "unit").where(F.col("d") <= F.col("edge"))
        sums = near.groupBy("unit").agg(
            F.count("*").alias("n"), F.array(*(F.sum(d) for d in DIMS)).alias("sums"),
            F.array(*(F.sum(F.col(DIMS[i]) * F.col(DIMS[j])) for i in range(p) for j in range(i, p))).alias("products"))
        now = cut(sums.mapInPandas(_solved, "unit string, centre array<double>, inverse array<double>"))
    far = rows.join(_sized(now, units), "unit").withColumn("d", F.least(F.round(_distance() * 64).cast("long"), F.lit(1 << 14)))
    return cut(now.join(far.groupBy("unit").agg((F.percentile("d", F.lit(0.5)) / 64).alias("middle")), "unit"))


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the distance."""
    rows = stored(statistics(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    judged = stored(_units(_vectors(rows.where("NOT base_failed"))))
    found = estimates(judged)
    far = judged.join(_sized(found, found.count()), "unit", "left").withColumn("distance", _distance() / F.greatest(F.col("middle") / MEDIAN, F.lit(0.25)))
    names = ["doc_id", *COUNTS[:5]]
    return (far.select(*names, "base_failed", F.coalesce(F.col("distance") <= cutoff, F.lit(True)).alias("kept"), "distance")
            .union(rows.where("base_failed").select(*names, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))))
