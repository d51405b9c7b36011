"""Benchmark decontamination with an FM-index per training shard.

Words are runs of letters, digits and non-ASCII characters, A-Z folded.  A
shard is up to ``SHARD`` words of documents that a map task reads in a row
(longer documents are cut into pieces that overlap by a window less one word).
A shard's words become symbols, every piece ends in a separator of its own, and
the shard is indexed once:

* the suffix order, by prefix doubling on the positions that are still tied;
* the Burrows-Wheeler transform as a wavelet matrix (bit rows by level);
* every ``SAMPLE``-th text position of the suffix array, with a mark per row.

The index is a table (``build``): one row a shard, kept in the shared folder,
and searched any number of times.  ``search`` takes the benchmark's windows
(``window`` consecutive words of an item; a shorter item is one window) in
blocks of bounded size, one broadcast a block, runs all windows of a block
backwards through the ranks of the wavelet matrix at once, and walks the rows
found back to sampled positions.  Occurrences are merged to spans per document.

Words and windows are compared by 64-bit hashes of the words; among n distinct
words a false match has probability about n * n / 2**65.

Defined cases: null text has no words and no hits; items without words or with
null text have no windows; an item with a null item_id marks words, but is not
counted or listed; rows with one item_id are one item; equal items each count;
repeated document rows get equal results, one each; null doc_ids are rows of
their own; an empty benchmark or table gives no hits or no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm import words as W
from candlewick.llm.common import bound_batches, released, stored

WINDOW = 10
SHARD = 1_000_000  # words of a shard; with its separators it has fewer than 2**21 symbols
SLICE_BYTES = 1_000_000
SAMPLE = 16
BLOCK_WORDS = 4_000_000  # benchmark words of a block (32 MB of hashes)
PIECE = 50_000  # words of a benchmark row
LOCATED = 500_000  # rows walked back at once

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the rows with the words per row and the hash of each word."""
    for whole in batches:
        _, reach = W.utf8(whole.column("text"))
        for lo, hi in W.slices(reach, SLICE_BYTES):
            b = whole.slice(lo, hi - lo)
            data, offsets = W.utf8(b.column("text"))
            w = W.split(data, offsets, _SEPARATOR)
            yield b, w.counts, W.word_hashes(data, w, lower=True)


# --- the index of a shard ---------------------------------------------------------

def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Positions in the order of their suffixes.  Every suffix is told apart
    before the text ends, as each piece ends in a separator of its own."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    place = max(n - 1, 1).bit_length()
    wide = max(symbols - 1, 1).bit_length()
    at = np.arange(n, dtype=np.uint64)
    first = text.astype(np.uint64)
    depth = min(2, (64 - place) // wide)
    key = first
    if depth == 2:
        key = (first << np.uint64(wide)) | np.append(first[1:], np.uint64(0))
    packed = np.sort((key << np.uint64(place)) | at)
    low = np.uint64((1 << place) - 1)
    order = (packed & low).astype(np.int64)
    packed >>= np.uint64(place)
    head = np.concatenate([[True], packed[1:] != packed[:-1]])
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    while True:
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        tied = ~(head & np.append(head[1:], True))
        slots = slots[tied]
        if not len(slots):
            return order
        where = order[slots]
        after = rank[np.minimum(where + depth, n - 1)].astype(np.uint64)
        own = rank[where].astype(np.uint64)
        if 3 * place <= 64:
            packed = np.sort((((own << np.uint64(place)) | after) << np.uint64(place)) | where.astype(np.uint64))
            order[slots] = (packed & low).astype(np.int64)
            packed >>= np.uint64(place)
        else:
            new = np.lexsort((after, own))
            order[slots] = where[new]
            packed = (own[new] << np.uint64(32)) | after[new]
        head = np.concatenate([[True], packed[1:] != packed[:-1]])
        depth *= 2


def wavelet_rows(codes: np.ndarray, levels: int) -> np.ndarray:
    """Bit rows of the wavelet matrix, one a level, as 64-bit words."""
    out = np.zeros((levels, len(codes) // 64 + 1), np.uint64)
    now = codes.astype(np.int32)
    for k in range(levels):
        bit = (now >> (levels - 1 - k)) & 1 == 1
        out[k] = np.packbits(np.append(bit, np.zeros(out.shape[1] * 64 - len(bit), bool)), bitorder="little").view("<u8")
        now = np.concatenate([now[~bit], now[bit]])
    return out


class Ranks:
    """Rank queries on a bit row."""

    def __init__(self, row: np.ndarray, n: int) -> None:
        self.row = row
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(row).astype(np.int64))])
        self.zeros = n - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.row[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.row[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Index:
    """An FM-index: counts before each symbol, wavelet matrix, samples."""

    def __init__(self, vocabulary: np.ndarray, below: np.ndarray, bits: np.ndarray, marks: np.ndarray, samples: np.ndarray) -> None:
        n = int(below[-1])
        self.n, self.symbols = n, len(below) - 1
        self.pieces = self.symbols - len(vocabulary)
        self.levels = [Ranks(row, n) for row in bits]
        self.marks, self.samples = Ranks(marks, n), samples
        self.sorted = np.argsort(vocabulary)
        self.vocabulary = vocabulary[self.sorted]
        symbol = np.arange(self.symbols)
        # a symbol's rows before it, less where its part of the last level begins
        self.shift = below[:-1] - self._down(symbol, np.zeros(self.symbols, np.int64))
        self.below = below

    @staticmethod
    def made(hashes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of the index over pieces with these words and word counts."""
        pieces = len(counts)
        code, vocabulary = pd.factorize(hashes)
        ends = np.cumsum(counts + 1) - 1  # places of the separators
        text = np.empty(len(hashes) + pieces, np.int64)
        word = np.ones(len(text), bool)
        word[ends] = False
        text[ends], text[word] = np.arange(pieces), code + pieces
        symbols = pieces + len(vocabulary)
        order = suffix_order(text, symbols)
        levels = max(symbols - 1, 1).bit_length()
        sampled = order % SAMPLE == 0
        marks = np.packbits(np.append(sampled, np.zeros((len(order) // 64 + 1) * 64 - len(order), bool)), bitorder="little").view("<u8")
        return {"vocabulary": np.asarray(vocabulary, np.uint64), "below": np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64),
                "bits": wavelet_rows(text[order - 1], levels), "marks": marks, "samples": order[sampled].astype(np.int64), "ends": ends.astype(np.int64)}

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position goes on the way of a symbol through the levels."""
        for k, row in enumerate(self.levels):
            ones = row.ones(at)
            at = np.where((symbol >> (len(self.levels) - 1 - k)) & 1 == 1, row.zeros + ones, at - ones)
        return at

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, -1 where the shard has no such word."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.sorted[at] + self.pieces, -1)

    def backward(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the phrases, given as symbols that end at the
        right border of the matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.flatnonzero(((phrases >= 0) | (np.arange(phrases.shape[1])[None] < phrases.shape[1] - sizes[:, None])).all(axis=1))
        for step in range(phrases.shape[1]):
            now = live[sizes[live] > step]
            symbol = phrases[now, phrases.shape[1] - 1 - step]
            both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo[now], hi[now]])) + np.concatenate([self.shift[symbol]] * 2)
            lo[now], hi[now] = both[:len(now)], both[len(now):]
            live = live[lo[live] < hi[live]]
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back in the text to a sampled row."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows, 0
        while len(left):
            done = self.marks.get(at)
            out[left[done]] = self.samples[self.marks.ones(at[done])] + steps
            left, at = left[~done], at[~done]
            symbol, to = np.zeros(len(at), np.int64), at
            for row in self.levels:
                bit, ones = row.get(to), row.ones(to)
                symbol = symbol * 2 + bit
                to = np.where(bit, row.zeros + ones, to - ones)
            at, steps = to + self.shift[symbol], steps + 1
        return out


_PARTS = {"vocabulary": np.uint64, "below": np.int64, "bits": np.uint64, "marks": np.uint64, "samples": np.int64, "ends": np.int64}


def index_schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("shard", T.LongType()), T.StructField("rows", T.ArrayType(T.LongType())),
                         T.StructField("doc_ids", T.ArrayType(doc_id)), T.StructField("counts", T.ArrayType(T.LongType())),
                         T.StructField("piece_rows", T.BinaryType()), T.StructField("piece_starts", T.BinaryType()),
                         *(T.StructField(p, T.BinaryType()) for p in _PARTS)])


def build(docs: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row a shard: its documents (row number, doc_id, words), its pieces
    (document row, first word) and the parts of its FM-index."""
    bound_batches(docs.sparkSession)
    schema = index_schema(docs.schema["doc_id"].dataType)
    overlap = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        rows, ids, counts, pieces, held, number, shards = [], [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            parts = Index.made(np.concatenate([p[2] for p in pieces]) if pieces else np.zeros(0, np.uint64), np.array([len(p[2]) for p in pieces], np.int64))
            values = [[base + shards], [rows], [ids], [counts], [np.array([p[0] for p in pieces], "<i8").tobytes()], [np.array([p[1] for p in pieces], "<i8").tobytes()],
                      *([np.ascontiguousarray(parts[p], kind).tobytes()] for p, kind in _PARTS.items())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, arrow)], names=schema.names)

        from pyspark.sql.pandas.types import to_arrow_type
        arrow = [to_arrow_type(f.dataType) for f in schema.fields]
        for b, size, hashes in _hashed(batches):
            first = 0
            for doc_id, n in zip(b.column("doc_id").to_pylist(), size.tolist()):
                rows.append(base + number)
                ids.append(doc_id)
                counts.append(n)
                own, at = hashes[first:first + n], 0
                first += n
                while at < n:
                    take = min(n - at, max(shard - held, window))
                    pieces.append((base + number, at, own[at:at + take].copy()))
                    held += take
                    at = at + take if at + take == n else at + take - overlap
                    if held >= shard:
                        yield close()
                        rows, ids, counts, pieces, held, shards = [], [], [], [], 0, shards + 1
                number += 1
        if rows or pieces:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


# --- benchmark windows --------------------------------------------------------------

def phrases(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (text), words (hashes) of pieces of bounded size of each item;
    every window of an item lies in one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, size, hashes in _hashed(batches):
            ids, bodies, n_words = [], [], []
            first = 0
            for item, n in zip(b.column("item_id").to_pylist(), size.tolist()):
                for at in range(0, max(n - window + 1, 1 if n else 0), PIECE):
                    own = hashes[first + at:first + min(at + PIECE + window - 1, n)]
                    ids.append(item)
                    bodies.append(own.astype("<u8").tobytes())
                    n_words.append(len(own))
                first += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(bodies, pa.binary()), pa.array(n_words, pa.int64())], names=["item_id", "words", "n"])

    return bench.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(released(run), "item_id string, words binary, n long")


@dataclass
class Block:
    """Distinct windows of a block, right-aligned, and the items of each."""
    words: np.ndarray  # (windows, window) hashes
    sizes: np.ndarray
    items: list[list[str]]

    @staticmethod
    def of(rows: list, window: int) -> Block:
        seen: dict[bytes, set] = {}
        for r in rows:
            body, n = bytes(r["words"]), r["n"]
            for at in range(max(n - window + 1, 1)):
                items = seen.setdefault(body[8 * at:8 * min(at + window, n)], set())
                if r["item_id"] is not None:
                    items.add(r["item_id"])
        sizes = np.array([len(k) // 8 for k in seen], np.int64)
        words = np.zeros((len(seen), window), np.uint64)
        for i, k in enumerate(seen):
            words[i, window - sizes[i]:] = np.frombuffer(k, "<u8")
        return Block(words, sizes, [sorted(v) for v in seen.values()])


def blocks(bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark's windows in blocks of at most about ``block_words``."""
    table = stored(phrases(bench, window))
    total = table.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // block_words))
    for part in range(parts if total else 0):
        yield Block.of(table.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part).collect(), window)


# --- search -------------------------------------------------------------------------

def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as disjoint intervals in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


_FOUND = "row long, spans binary, items array<string>"


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for b in batches:
            for i in range(b.num_rows):
                part = {c: np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in _PARTS.items()}
                if not len(part["ends"]):
                    continue
                part["bits"] = part["bits"].reshape(-1, len(part["marks"]))
                ends = part.pop("ends")
                index = Index(**part)
                lo, hi = index.backward(index.symbols_of(block.words.ravel()).reshape(block.words.shape), block.sizes)
                row, start = (np.frombuffer(b.column(c)[i].as_buffer(), "<i8") for c in ("piece_rows", "piece_starts"))
                first = np.concatenate([[0], ends[:-1] + 1])
                spans, items = {}, {}
                some, done = np.flatnonzero(lo < hi), 0
                reach = np.cumsum(hi[some] - lo[some])
                while done < len(some):
                    upto = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + LOCATED, "right")))
                    which = some[done:upto]
                    n = hi[which] - lo[which]
                    phrase = np.repeat(which, n)
                    at = np.repeat(lo[which], n) + np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
                    at = np.concatenate([index.locate(at[a:a + LOCATED]) for a in range(0, len(at), LOCATED)])
                    piece = np.searchsorted(ends, at)
                    owner, begin = row[piece], start[piece] + at - first[piece]
                    order = np.lexsort((begin, owner))
                    owner, begin, phrase = owner[order], begin[order], phrase[order]
                    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
                    for x, y in zip(cuts[:-1], cuts[1:]):
                        key, s = int(owner[x]), slice(x, y)
                        old = spans.get(key, (np.zeros(0, np.int64),) * 2)
                        spans[key] = _merged(np.concatenate([old[0], begin[s]]), np.concatenate([old[1], begin[s] + block.sizes[phrase[s]]]))
                        items.setdefault(key, set()).update(*(block.items[p] for p in np.unique(phrase[s])))
                    done = upto
                if spans:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(list(spans), pa.int64()), pa.array([np.stack(v).astype("<i8").tobytes() for v in spans.values()], pa.binary()),
                        pa.array([sorted(items[k]) for k in spans], pa.list_(pa.string()))], names=["row", "spans", "items"])

    return run


def search(index: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row, spans, items per document, shard and block with an occurrence."""
    spark = index.sparkSession
    out = spark.createDataFrame([], _FOUND)
    for block in blocks(bench, window, block_words):
        shared = spark.sparkContext.broadcast(block)  # at most about block_words hashes for each of the window's places
        out = out.unionByName(index.mapInArrow(released(_searched(shared)), _FOUND))
    return out


def spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard: int = SHARD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (array of [start, end) word numbers, merged) and
    items (sorted ids) of every row of ``docs``."""
    index = stored(build(docs, window, shard))
    found = search(index, bench, window, block_words).groupBy("row").agg(
        F.collect_list("spans").alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = index.select(F.explode(F.arrays_zip("rows", "doc_ids", "counts")).alias("d")).select(
        F.col("d.rows").alias("row"), F.col("d.doc_ids").alias("doc_id"), F.col("d.counts").alias("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bodies in b.column("_spans").to_pylist():
                both = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in bodies], axis=1) if bodies else np.zeros((2, 0), np.int64)
                s, e = _merged(*both) if both.shape[1] else both
                out.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(out, kind), b.column("items")],
                                             names=["doc_id", "n_words", "spans", "items"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    joined = every.join(found, "row", "left").select("doc_id", "n_words", "_spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return joined.mapInArrow(run, f"doc_id {id_type}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard: int = SHARD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return spans(docs, bench, window, shard, block_words).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
