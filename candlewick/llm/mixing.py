"""Mixing sources to target weights.

Every source's words, document after document, are packed into blocks of a
fixed number of words.  The mix is a sequence of slots, one block each, cut
into output shards.  How many slots of a shard come from which source is a
multinomial draw conditioned on the sources' totals: the totals are split down
a binary tree of shards (multivariate hypergeometric draws seeded by tree
node), so each shard finds its own counts, and the first slot number of each
source, without seeing any other shard.  Slot j of a source is the block at
position j modulo n of a pseudorandom permutation of its n block indices, a
new one for each pass.  Slots and blocks meet in a join by (source, block).

The last slot of a source is cut so that the words taken are its target,
rounded to a whole word.  A target never exceeds ``max_repeat`` times the
source, whole passes come first, so no document is taken more often than that.

Per-source figures (one row a source) are the only thing brought to the
driver; more than ``MAX_SOURCES`` of them is an error, not a cut.

Defined cases: null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; rows with a null doc_id are told apart by
their text like any others; repeated rows are packed one by one;
an empty table gives an empty mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import bound_batches, cut, released
from candlewick.llm.words import WORD

MAX_SOURCES = 100_000
CHUNK_ROWS = 2_000
BLOCK_WORDS = 128
SHARD_SLOTS = 1024


def targets(sizes: list[int], weights: list[float], max_repeat: float = 3) -> list[float]:
    """Shares of the total by weight, capped at max_repeat times each size;
    what is cut off is shared again by weight until nothing is above."""
    out = [0.0] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > max_repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(max_repeat * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


_M = np.uint64


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n): four Feistel rounds on the next
    even power of two, walked until the value is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = _M((1 << half) - 1)
    keys = np.random.default_rng([key, n]).integers(0, 2**63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> _M(half), x & low
        for k in (keys[::-1] if inverse else keys):
            if inverse:
                left, right = right, left
            f = (right + k) * _M(0x9E3779B97F4A7C15)
            f ^= f >> _M(29)
            f *= _M(0xBF58476D1CE4E5B9)
            left = left ^ ((f >> _M(32)) & low)
            if not inverse:
                left, right = right, left
        return (left << _M(half)) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (above := out >= n).any():
        out[above] = once(out[above])
    return out.astype(np.int64)


@dataclass
class Plan:
    """What a shard needs to find its slots; one entry a source."""
    words: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    whole: np.ndarray  # whole passes over the blocks
    quota: np.ndarray  # slots
    last_take: np.ndarray  # words of the last slot
    block_words: int
    shard_slots: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-int(self.quota.sum()) // self.shard_slots)


def plan(words: list[int], target: list[float], block_words: int, shard_slots: int, seed: int) -> Plan:
    n = len(words)
    blocks, whole, quota, last = (np.zeros(n, np.int64) for _ in range(4))
    for s, (size, aim) in enumerate(zip(words, target)):
        take = int(aim + 0.5)
        if not size or not take:
            continue
        blocks[s] = -(-size // block_words)
        whole[s], rest = divmod(take, size)
        tail = size - (int(blocks[s]) - 1) * block_words
        at = int(permute(np.array([blocks[s] - 1]), int(blocks[s]), _key(seed, s, int(whole[s])), inverse=True)[0])
        held = lambda m: m * block_words - (block_words - tail if at < m else 0)  # noqa: B023, E731
        m = -(-rest // block_words)
        m += held(m) < rest
        quota[s] = whole[s] * blocks[s] + m
        last[s] = rest - held(m - 1) if m else 0
    return Plan(np.asarray(words, np.int64), np.asarray(target, float), blocks, whole, quota, last, block_words, shard_slots, seed)


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * 1_000_003 + turn


def _drawn(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """n slots from sources that have ``counts`` left; beyond what numpy's
    hypergeometric draw takes, binomial draws held inside the same bounds."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for s, c in enumerate(map(int, counts)):
        others = rest - c
        if rest < 1_000_000_000:
            x = int(rng.hypergeometric(c, others, n)) if n else 0
        else:
            x = min(max(int(rng.binomial(n, c / rest)), n - others, 0), c, n)
        out[s], n, rest = x, n - x, others
    return out


def shard_counts(p: Plan, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of this shard by source, and the number of each source's first."""
    counts, start, lo, hi = p.quota.copy(), np.zeros_like(p.quota), 0, p.shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _drawn(np.random.default_rng([p.seed, lo, hi]), counts, (mid - lo) * p.shard_slots)
        if shard < mid:
            counts, hi = left, mid
        else:
            start, counts, lo = start + left, counts - left, mid
    return counts, start


def shard_slots(p: Plan, shard: int) -> pd.DataFrame:
    """The shard's slots in pseudorandom order: shard, slot, source_no, block, take."""
    counts, start = shard_counts(p, shard)
    parts = []
    for s in np.flatnonzero(counts):
        j = start[s] + np.arange(counts[s])
        turn, at = np.divmod(j, p.blocks[s])
        block = np.empty_like(j)
        for t in np.unique(turn):
            block[turn == t] = permute(at[turn == t], int(p.blocks[s]), _key(p.seed, int(s), int(t)))
        take = np.minimum(p.block_words, p.words[s] - block * p.block_words)
        if p.last_take[s]:
            take[j == p.quota[s] - 1] = p.last_take[s]
        parts.append(pd.DataFrame({"source_no": np.full(len(j), s, np.int32), "block": block, "take": take.astype(np.int32)}))
    out = pd.concat(parts, ignore_index=True)
    out["slot"] = permute(np.arange(len(out)), len(out), _key(p.seed, shard, -1 & 0xFFFF))
    out["shard"] = shard
    return out[["shard", "slot", "source_no", "block", "take"]]


@dataclass
class Mix:
    rows: DataFrame  # one per document row: key columns, size, source_no, first word in its source
    slots: DataFrame
    takes: DataFrame  # one per (slot, document piece): key columns, shard, slot, word_from, word_to
    plan: Plan
    sources: DataFrame  # source_no, source, source_size, target


KEY = ["doc_id", "_print", "_copy"]


def _print() -> F.Column:
    """Hash of what a row adds to the mix; a hash skips nulls, so flags tell which value is one."""
    return F.xxhash64("text", "source", F.col("text").isNull(), F.col("source").isNull())


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """Rows under a key that tells repeated rows apart."""
    keyed = docs.withColumn("_print", _print())
    same = Window.partitionBy("doc_id", "_print").orderBy(F.lit(0))
    return keyed.select(*docs.columns, "_print", *more).withColumn("_copy", F.row_number().over(same))


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Both joined by KEY, where a null doc_id equals a null doc_id."""
    right = right.withColumnsRenamed({k: f"_its{k}" for k in KEY})
    same = [left[k].eqNullSafe(right[f"_its{k}"]) if k == "doc_id" else left[k] == right[f"_its{k}"] for k in KEY]
    return left.join(right, same, how).drop(*(f"_its{k}" for k in KEY))


def mix(docs: DataFrame, weights=(1, 2, 3), max_repeat: float = 3, block_words: int = BLOCK_WORDS,
        shard_slots_: int = SHARD_SLOTS, seed: int = 17) -> Mix:
    """Plan and slots of the mix; ``weights`` go round the sources in code
    point order, null last."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), _print().alias("_print"))
    same = Window.partitionBy("doc_id", "_print").orderBy(F.lit(0))
    sized = cut(sized.withColumn("_copy", F.row_number().over(same)))

    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [int(r["words"]) for r in found]
    aim = targets(words, [float(weights[i % len(weights)]) for i in range(len(found))], max_repeat)
    sources = spark.createDataFrame(
        pd.DataFrame({"source_no": np.arange(len(found), dtype=np.int32), "_source": [r["source"] for r in found],
                      "source_size": np.array(words, np.int64), "target": np.array(aim, float),
                      "_chunks": np.array([-(-r["n"] // CHUNK_ROWS) for r in found], np.int64)}),
        "source_no int, _source string, source_size long, target double, _chunks long")

    # first word of each document in its source: sums within bounded chunks, then over chunks
    rows = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["_source"])).drop("_source")
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(*KEY), "_chunks"))  # rows without an id spread too
    here = Window.partitionBy("source_no", "_chunk")
    chunks = rows.groupBy("source_no", "_chunk").agg(F.sum("size").alias("_held"))
    before = chunks.select("source_no", "_chunk", (F.sum("_held").over(Window.partitionBy("source_no").orderBy("_chunk")) - F.col("_held")).alias("_before"))
    rows = (rows.withColumn("_first", F.sum("size").over(here.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .join(before, ["source_no", "_chunk"]).withColumn("_first", F.col("_first") + F.col("_before"))
            .drop("_before", "_chunk", "_chunks"))

    p = plan(words, aim, block_words, shard_slots_, seed)
    shared = spark.sparkContext.broadcast(p)  # six numbers a source

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                yield shard_slots(shared.value, int(shard))

    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = spark.range(0, p.shards, 1, max(1, min(p.shards, parallel))).mapInPandas(
        draw, "shard long, slot long, source_no int, block long, take int")

    b = F.lit(block_words)
    last = F.col("_first") + F.col("size")
    pieces = (rows.where("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("_first") / b), F.floor((last - 1) / b))))
              .withColumn("_from", F.greatest("_first", F.col("block") * b)).withColumn("_to", F.least(last, (F.col("block") + 1) * b)))
    # both sides grow with the corpus; the planner's size guess for slots is that of shard numbers
    takes = (pieces.join(slots.hint("merge"), ["source_no", "block"])
             .withColumn("_to", F.least("_to", F.col("block") * b + F.col("take"))).where("_to > _from")
             .select(*KEY, "shard", "slot", (F.col("_from") - F.col("_first")).alias("word_from"), (F.col("_to") - F.col("_first")).alias("word_to")))
    return Mix(rows, slots, takes, p, sources)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document row."""
    m = mix(docs, **options)
    taken = m.takes.groupBy(*KEY).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return (_with(m.rows, taken, "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def blocks_of(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: for every slot one row per document piece in it, with
    the document's columns; ``text`` is the piece (words and what is between
    them as in the document) and ``n_chars``, if there, its length."""
    m = mix(docs, **options)
    ranges = m.takes.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("shard", "slot", "word_from", "word_to"))).alias("_takes"))
    names = docs.columns
    held = _with(_keyed(docs), ranges).select(*names, "_takes")
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, takes = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
            rows, out = [], []
            for i, (text, mine) in enumerate(zip(texts, takes)):
                found = [m.span() for m in word.finditer(text)]
                out += [text[found[t["word_from"]][0]:found[t["word_to"] - 1][1]] for t in mine]
                rows += [i] * len(mine)
            columns = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:len(names)]]
            columns[at] = pa.array(out, b.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array(map(len, out), b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([b.schema.field(i) for i in range(len(names))]))

    return held.mapInArrow(released(run), docs.schema)
