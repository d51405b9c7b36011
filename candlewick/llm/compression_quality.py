"""Quality classifier by compression (zstandard dictionaries).

Two dictionaries are built, one from good and one from bad labelled text.
A text is cut into fixed segments; every segment of the whole text is
compressed with either dictionary.  The evidence is the normalised size
difference ``(bad - good) / (bad + good)`` of the summed sizes and, from the
same sizes, the log of the compressed share (text that repeats itself leaves
little for a dictionary to tell apart).  A logistic calibration fitted on
other labelled documents turns them into a score from 0 to 1.

The dictionaries and the calibration come from a bounded sample of labelled
rows (``sample_docs`` per class and purpose, ``sample_segments`` segments
each, all chosen by hash order over all labelled rows).  Scoring covers every
byte of every row.

Defined cases: null and empty texts have no evidence and get the calibrated
score of zero evidence; labels that are null are ignored, contradicting
labels of one id count as bad; with one class missing every score is the
prior; repeated rows are scored one by one; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import bound_batches, crc_fold, released

SEGMENT = 2048
LEVEL = 3
THRESHOLD = 0.7


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    intercept: float = 0.0
    weights: tuple[float, ...] = (0.0, 0.0)
    segment: int = SEGMENT

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text: normalised size difference, log of the compressed share."""
        sizes = np.zeros((2, len(texts)), np.int64)
        for k, body in enumerate((self.good, self.bad)):
            if not body:
                continue
            words = zstandard.ZstdCompressionDict(body)
            words.precompute_compress(level=LEVEL)
            press = zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_checksum=False,
                                             write_content_size=False, write_dict_id=False).compress
            step = self.segment
            for i, text in enumerate(texts):
                sizes[k, i] = sum(len(press(text[j:j + step])) for j in range(0, len(text), step))
        good, bad = sizes
        raw = np.array([len(t) for t in texts], np.int64)
        return np.column_stack([(bad - good) / np.maximum(bad + good, 1), np.log((bad + good + 1) / (2 * raw + 1))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        log_odds = self.intercept + self.evidence(texts) @ np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Weighted logistic regression, Newton steps with a small ridge on scaled features."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.diag([1e-9] + [1e-2] * x.shape[1])
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    weights = beta[1:] / scale
    return float(beta[0] - weights @ mean), tuple(map(float, weights))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the folds that may be learnt from, one row an id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 2))
    return known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 1500, sample_segments: int = 3000,
          dictionary_bytes: int = 112_640, segment: int = SEGMENT) -> CompressionModel:
    """Dictionaries and calibration from a bounded sample of labelled rows.

    ``sample_docs`` documents per class for the dictionaries and as many
    others for the calibration; ``sample_segments`` segments per class are
    brought to the driver for the dictionaries (at most
    2 * 3000 * 2 KB = 12 MB); calibration sizes are computed on executors.
    """
    bound_batches(docs.sparkSession)
    lab = training_labels(labels)
    prior = {r["quality"]: r["n"] for r in lab.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    positive = prior.get(1, 0) / max(1, prior.get(0, 0) + prior.get(1, 0))
    if not prior.get(0) or not prior.get(1):
        p = min(max(positive, 1e-3), 1 - 1e-3) if prior else 0.5
        return CompressionModel(b"", b"", float(np.log(p / (1 - p))), segment=segment)

    picked = None
    for q in (0, 1):
        some = (lab.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_docs))
        picked = some if picked is None else picked.unionByName(some)
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = picked.withColumn("use", F.row_number().over(order) % 2)  # 1: dictionaries, 0: calibration
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")

    n = F.length("text")
    pieces = (text.where("use = 1 AND text <> ''")
              .select("doc_id", "quality", "text", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / segment).cast("int"))).alias("part"))
              .select("doc_id", "quality", "part", F.substring("text", F.col("part") * segment + 1, F.lit(segment)).alias("text")))
    dictionaries = {}
    for q in (0, 1):
        rows = pieces.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", "part"), "doc_id", "part").limit(sample_segments).collect()
        samples = [r["text"].encode() for r in rows]
        try:
            dictionaries[q] = zstandard.train_dictionary(dictionary_bytes, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to select from: the text itself is the dictionary
            dictionaries[q] = b"".join(samples)[-dictionary_bytes:] or b"\0" * 8
    model = CompressionModel(dictionaries[1], dictionaries[0], segment=segment)
    fit = text.where("use = 0")
    if fit.isEmpty():
        fit = text
    fit = fit.select("doc_id", "text", "quality").mapInArrow(_evidence(model), "quality int, diff double, share double").toPandas()
    if fit["quality"].nunique() == 2:
        weight = fit["quality"].map({q: prior[q] / max(1, (fit["quality"] == q).sum()) for q in (0, 1)}).to_numpy(float)
        fit = fit.sort_values(["diff", "share", "quality"])  # sums in one order, whatever the partitions
        weight = weight[fit.index.to_numpy()]
        model.intercept, model.weights = _logistic(fit[["diff", "share"]].to_numpy(float), fit["quality"].to_numpy(float), weight / weight.mean())
    else:
        model.intercept = float(np.log(positive / (1 - positive)))
    return model


def _bytes(column) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def _evidence(model: CompressionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.evidence(_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("quality"), *(pa.array(found[:, k], pa.float64()) for k in (0, 1))],
                                             names=["quality", "diff", "share"])
    return run


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 110 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = shared.value.score(_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(values, pa.float64())], names=[id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(released(run), f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, all columns as they were."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(_bytes(b.column(at))) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs, train(docs, labels, **sample))
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
