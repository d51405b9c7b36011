"""Repeated passages by prefix-partitioned suffix groups.

A suffix starts at every word that has ``window`` words (20) from there on in
its document.  Suffixes are split among groups by prefixes of variable length.
Prefixes of one word are counted first; only where a prefix cell holds more
suffixes than a share of a group's memory are its suffixes counted again by
their first 2 words, and so on to 4, 8 and 16 words and at last the whole
window.  Each level is a pass of its own over what is still open, and its
number of cells follows the number of open suffixes, so that prefixes split
the suffixes at any size of input.

A group is one subtree of the suffix tree, cut off at the depth of the window:
its suffixes, sorted by their label (the hash of the window's words), form
runs, and a run of two or more is an internal node that deep, that is, a
repeat.  A node's first leaf (smallest document, then start) stays, the others
are repeats of it.  Nodes at successive starts make up a maximal repeat, so
covering the words of all repeated windows removes exactly the maximal repeats
but for their first occurrence.

Map tasks resolve what repeats within their own chunk and send one leaf a
label: a label held by a third of all rows reaches its group once per chunk.
Leaves travel as sorted, compressed labels with positions.  What repeats comes
back packed: one row for each group and range of documents, merged per range
into the repeated spans of each document.

Labels are 64-bit hashes; among n windows a false repeat is expected with
probability about n * n / 2**65.

Defined cases: null text has no words; documents of fewer words than the
window keep all of them; equal rows (doc_id and text) count as one document and
get equal results; rows with one doc_id and different texts, or with different
texts and a null doc_id, are documents of their own, ordered by the hash of the
text; a null doc_id counts as the smallest; other columns are not read.  The
hash is sent only for ids in cells where some id has several texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import words as W
from candlewick.llm.common import bound_batches, released

WINDOW = 20
SLICE_BYTES = 1_000_000
CHUNK = 1_000_000  # words a map task gathers before it sends them
GROUP = 1_500_000  # suffixes of one group
LEVELS = (1, 2, 4, 8, 16)  # words of a prefix, before the whole window
FIRST_BITS = 14  # cells of one-word prefixes
MOST_BITS = 26  # cells of any level; its flags take 8 MB then
CELL_RANGES = 32  # rows that a chunk's counts of one level are dealt to
MERGED = 256  # packed counts that one merge reads
RANGES = 64  # ranges of documents that results are packed by, and the words of a range beyond
RANGE_WORDS = 4_000_000
ID_CELLS = 1 << 16  # cells of ids; a bound for what is known about ids with several texts
_NULL_ID = -(1 << 63)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, W.Words, np.ndarray]]:
    for whole in batches:
        _, reach = W.utf8(whole.column("text"))
        for lo, hi in W.slices(reach, SLICE_BYTES):
            b = whole.slice(lo, hi - lo)
            data, offsets = W.utf8(b.column("text"))
            w = W.split(data, offsets)
            yield b, w, W.word_hashes(data, w)


@dataclass
class Level:
    """Prefixes of ``size`` words, hashed to cells; the flags tell which cells are over the bound."""
    size: int
    bits: int
    flags: np.ndarray  # eight cells a byte

    def over(self, cell: np.ndarray) -> np.ndarray:
        return (self.flags[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _cells(hashes: np.ndarray, size: int, bits: int, at: np.ndarray) -> np.ndarray:
    return (W.gram_hashes(hashes, size)[at] >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Split:
    """The levels counted so far, and how many groups there are."""
    groups: int
    levels: list[Level]
    words: int = 0  # suffixes in all

    def still_open(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the suffixes at ``at`` that are in cells over the bound at every level."""
        for level in self.levels:
            at = at[level.over(_cells(hashes, level.size, level.bits, at))]
        return at

    def group(self, hashes: np.ndarray, labels: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Group of the suffixes at positions ``at`` with these labels."""
        key, open_ = labels.copy(), np.arange(len(at))
        for level in self.levels:
            cell = _cells(hashes, level.size, level.bits, at[open_])
            over = level.over(cell)
            key[open_[~over]] = W.mix64(cell[~over].astype(np.uint64) * np.uint64(64) + np.uint64(level.size))
            open_ = open_[over]
        return (key % np.uint64(self.groups)).astype(np.int64)

    def ranges(self) -> int:
        return max(RANGES, -(-self.words // RANGE_WORDS))


_COUNTS = "part int, rng int, cells binary, counts binary"


def _summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, with the sums of their counts."""
    cell, n = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    if not len(cell):
        return cell, n
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[at], np.add.reduceat(n, at)


def _level_counts(shared, size: int, bits: int, window: int):
    """Open suffixes in each cell of one level: a packed row for each chunk and range of cells."""
    shift = max(0, bits - CELL_RANGES.bit_length() + 1)

    def packed(cells: list, counts: list) -> pa.RecordBatch:
        cell, n = _summed(cells, counts)
        rng, at = np.unique(cell >> shift, return_index=True)
        cut = list(zip(at, [*at[1:], len(cell)]))
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([
            pa.array([part] * len(rng), pa.int32()), pa.array(rng, pa.int32()),
            pa.array([W.pack_sorted(cell[a:b].astype(np.uint64)) for a, b in cut], pa.binary()),
            pa.array([_press(n[a:b].astype("<i8").tobytes()) for a, b in cut], pa.binary())], names=["part", "rng", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts, held = [], [], 0
        for _, w, hashes in _texts(batches):
            at = shared.value.still_open(hashes, np.flatnonzero(W.inside_rows(w, window)))
            if not len(at):
                continue
            cell, n = np.unique(_cells(hashes, size, bits, at), return_counts=True)
            cells.append(cell)
            counts.append(n)
            held += len(cell)
            if held >= CHUNK:
                yield packed(cells, counts)
                cells, counts, held = [], [], 0
        if held:
            yield packed(cells, counts)

    return run


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _summed([W.unpack_sorted(b).astype(np.int64) for b in frame["cells"]], [_unpress(b) for b in frame["counts"]])


def _merged_counts(frame: pd.DataFrame) -> pd.DataFrame:
    cell, n = _unpacked(frame)
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "rng": [frame["rng"].iloc[0]],
                         "cells": [W.pack_sorted(cell.astype(np.uint64))], "counts": [_press(n.astype("<i8").tobytes())]})


def _over(bound: int):
    """A range's cells over the bound, their suffixes, and all suffixes."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cell, n = _unpacked(frame)
        over = n > bound
        return pd.DataFrame({"cells": [W.pack_sorted(cell[over].astype(np.uint64))], "held": [int(n[over].sum())], "total": [int(n.sum())]})

    return run


def prefix_split(docs: DataFrame, window: int = WINDOW) -> Split:
    """Counts prefixes level by level, each over the suffixes still open, and sets the groups."""
    sc = docs.sparkSession.sparkContext
    split, left, bits, bound = Split(1, []), None, FIRST_BITS, max(1, GROUP // 8)
    for size in (k for k in LEVELS if k < window):
        if left is not None:
            # evenly spread cells hold an eighth of the bound, which rises towards a group where flags would be too many
            bits = min(MOST_BITS, max(FIRST_BITS, (8 * left // bound).bit_length()))
            bound = max(bound, min(GROUP, left >> (MOST_BITS - 3)))
        counts = docs.select("text").mapInArrow(released(_level_counts(sc.broadcast(split), size, bits, window)), _COUNTS)
        parts = docs.rdd.getNumPartitions() if left is None else parts
        several = parts
        while several > MERGED:  # a merge reads a bounded number of rows
            several = -(-several // MERGED)
            counts = counts.withColumn("part", F.col("part") % several).groupBy("part", "rng").applyInPandas(_merged_counts, _COUNTS)
        found = counts.groupBy("rng").applyInPandas(_over(bound), "cells binary, held long, total long").collect()  # a row a range
        flags = np.zeros(1 << bits >> 3, np.uint8)
        for r in found:
            cell = W.unpack_sorted(bytes(r["cells"])).astype(np.int64)
            np.bitwise_or.at(flags, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
        if left is None:
            split.words = sum(r["total"] for r in found)
        left = sum(r["held"] for r in found)
        split = Split(max(1, -(-split.words // GROUP)), [*split.levels, Level(size, bits, flags)], split.words)
        if not left:
            break
    return split


def _runs(labels: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For leaves sorted by label: (is its node's first leaf, key above the first leaf's)."""
    head = np.concatenate([[True], labels[1:] != labels[:-1]])
    run = np.cumsum(head) - 1
    many = np.bincount(run)[run] > 1
    first, later = head.copy(), np.zeros(len(labels), bool)
    at = np.flatnonzero(many)
    if len(at):
        order = at[np.lexsort((starts[at], ids[at], run[at]))]
        new = np.concatenate([[True], run[order][1:] != run[order][:-1]])
        first[at] = False
        first[order[new]] = True
        lead = order[new][np.cumsum(new) - 1]
        later[order] = (ids[order] != ids[lead]) | (starts[order] != starts[lead])
    return first, later


_RESULTS = ("ids", "prints", "counts", "starts")


def _packed(ids: np.ndarray, prints: np.ndarray, starts: np.ndarray, ranges: int) -> tuple[list[int], list[tuple]]:
    """Repeated starts of documents, one packed row for each range of documents."""
    if not len(ids):
        return [], []
    own = W.mix64(ids.view(np.uint64) ^ W.mix64(prints.view(np.uint64))) % np.uint64(ranges)
    order = np.lexsort((starts, prints, ids, own))
    own, ids, prints, starts = own[order], ids[order], prints[order], starts[order]
    change = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
    new = np.concatenate([[True], change | (starts[1:] != starts[:-1])])  # equal rows say the same
    head = np.concatenate([[True], change])[new]
    own, ids, prints, starts = own[new], ids[new], prints[new], starts[new]
    rng, at = np.unique(own, return_index=True)
    rows = []
    for a, b in zip(at, [*at[1:], len(own)]):
        lead = np.flatnonzero(head[a:b])
        rows.append((*(_press(x[a:b][lead].astype("<i8").tobytes()) for x in (ids, prints)),
                     W.pack_counts(np.diff(lead, append=b - a)), W.pack_counts(starts[a:b])))
    return rng.astype(int).tolist(), rows


def _spans(window: int):
    """A range of documents: the spans that their repeated windows cover, a row a document."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = [W.unpack_counts(b) for b in frame["counts"]]
        ids, prints = (np.concatenate([np.repeat(_unpress(b), n) for b, n in zip(frame[c], counts)]) for c in ("ids", "prints"))
        starts = np.concatenate([W.unpack_counts(b) for b in frame["starts"]]).astype(np.int64)
        order = np.lexsort((starts, prints, ids))
        ids, prints, starts = ids[order], prints[order], starts[order]
        doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])])
        new = doc | np.concatenate([[True], starts[1:] > starts[:-1] + window])
        at = np.flatnonzero(new)
        ends = starts[np.concatenate([at[1:], [len(starts)]]) - 1] + window
        pairs = np.column_stack([starts[at], ends]).astype("<u4")
        lead = np.flatnonzero(doc[at])
        return pd.DataFrame({"doc_id": ids[at][lead], "print": prints[at][lead], "spans": [p.tobytes() for p in np.split(pairs, lead[1:])]})

    return run


def _ranks(ids: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row among the distinct (id, print), and a row of each rank."""
    order = np.lexsort((prints, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (prints[order][1:] != prints[order][:-1])
    ranks = np.empty(len(ids), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks, order[new]


_SENT = "grp int, rng int, ids binary, prints binary, counts binary, starts binary, labels binary, places binary, firsts binary"


def _sent(shared, window: int):
    """Map side: leaves by group (rng null), and what repeats inside the chunk, packed."""
    def send(split: Split, parts: list) -> pa.RecordBatch:
        ids = np.concatenate([p[0] for p in parts])
        prints = np.concatenate([p[1] for p in parts])
        counts = np.concatenate([p[2] for p in parts])
        hashes = np.concatenate([p[3] for p in parts])
        firsts = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(ids)), counts)
        at = np.flatnonzero(row[:-window + 1] == row[window - 1:]) if len(row) >= window else np.zeros(0, np.int64)
        labels = W.gram_hashes(hashes, window)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(labels, kind="stable")
        at, labels = at[order], labels[order]
        ranks, named = _ranks(ids, prints)
        own, starts = ranks[row[at]], at - firsts[row[at]]
        if len(at):
            first, later = _runs(labels, own, starts)
        else:
            first = later = np.zeros(0, bool)
        held = named[own[later]]
        rng, packed = _packed(ids[held], prints[held], starts[later], split.ranges())
        at, labels = at[first], labels[first]
        group = split.group(hashes, labels, at)
        order = np.argsort(group, kind="stable")  # labels stay sorted inside a group
        cuts = np.searchsorted(group[order], np.arange(split.groups + 1))
        used = np.flatnonzero(np.diff(cuts))
        pick = [order[cuts[g]:cuts[g + 1]] for g in used]
        rows = [np.unique(row[at[p]]) for p in pick]  # a group gets the rows that its leaves are in
        table = {c: [_press(t[r].astype("<i8").tobytes()) for r in rows] for c, t in (("ids", ids), ("prints", prints), ("firsts", firsts))}
        table["labels"] = [W.pack_sorted(labels[p]) for p in pick]
        table["places"] = [W.pack_counts(at[p]) for p in pick]
        done = dict(zip(_RESULTS, zip(*packed))) if packed else {}
        none = [None] * max(len(rng), len(used))
        return pa.RecordBatch.from_arrays([
            pa.array([r % split.groups for r in rng] + used.tolist(), pa.int32()), pa.array(rng + none[:len(used)], pa.int32()),
            *(pa.array([*done.get(c, none[:len(rng)]), *table.get(c, none[:len(used)])], pa.binary())
              for c in ("ids", "prints", "counts", "starts", "labels", "places", "firsts"))],
            names=[c.split()[0] for c in _SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b, w, hashes in _texts(batches):
            long = w.counts >= window
            keep = np.repeat(long, w.counts)
            parts.append((*(b.column(c).to_numpy(zero_copy_only=False)[long] for c in ("doc_id", "print")), w.counts[long], hashes[keep]))
            held += int(keep.sum())
            if held >= CHUNK:
                yield send(shared.value, parts)
                parts, held = [], 0
        if held:
            yield send(shared.value, parts)

    return run


def _press(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(-1, 8).T).tobytes())


def _unpress(body: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


_FOUND = "rng int, ids binary, prints binary, counts binary, starts binary"


def _subtree(ranges: int):
    """One group: runs of equal labels are the deep nodes; all leaves but the first repeat."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame["rng"].notna()
        out = [frame.loc[known, ["rng", *_RESULTS]].astype({"rng": "int32"})]
        sent = frame.loc[~known].reset_index(drop=True)
        if len(sent):
            rng, rows = _packed(*_leaves_of_nodes(sent), ranges)
            out.append(pd.DataFrame([(r, *row) for r, row in zip(rng, rows)], columns=["rng", *_RESULTS]).astype({"rng": "int32"}))
        return pd.concat(out, ignore_index=True)

    return run


def _leaves_of_nodes(sent: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, prints and starts of the leaves that repeat a node's first leaf."""
    parts = [W.unpack_sorted(b) for b in sent["labels"]]
    size = np.array([len(p) for p in parts])
    labels = np.concatenate(parts)
    del parts
    order = np.argsort(labels, kind="stable")
    labels = labels[order]
    same = labels[1:] == labels[:-1]
    many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    order, labels = order[many], labels[many]
    ends = np.cumsum(size)
    chunk = np.searchsorted(ends, order, "right")
    ids, prints, starts = (np.zeros(len(order), np.int64) for _ in range(3))
    for c in np.unique(chunk):
        mine = np.flatnonzero(chunk == c)
        at = W.unpack_counts(sent["places"][c])[order[mine] - (ends[c] - size[c])].astype(np.int64)
        firsts = _unpress(sent["firsts"][c])
        row = np.searchsorted(firsts, at, "right") - 1
        ids[mine], prints[mine], starts[mine] = _unpress(sent["ids"][c])[row], _unpress(sent["prints"][c])[row], at - firsts[row]
    if not len(order):
        return ids, prints, starts
    _, later = _runs(labels, _ranks(ids, prints)[0], starts)
    return ids[later], prints[later], starts[later]


def _named(docs: DataFrame) -> DataFrame:
    """The documents with ``_id`` (null as the smallest) and ``_print``: the hash
    of the text where the id may not tell texts apart, else 0."""
    own = F.xxhash64("text", F.col("doc_id").isNull())
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(ID_CELLS)).cast("int")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a != b")
    cells = several.select(cell.alias("_cell")).distinct().collect()  # at most ID_CELLS
    needed = F.col("doc_id").isNull()
    if cells:
        found = docs.sparkSession.createDataFrame(cells, "_cell int").withColumn("_several", F.lit(True))
        docs = docs.withColumn("_cell", cell).join(F.broadcast(found), "_cell", "left").drop("_cell")
        needed |= F.col("_several").isNotNull()
    return (docs.withColumn("_id", F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long"))
            .withColumn("_print", F.when(needed, own).otherwise(F.lit(0)).cast("long")).drop("_several"))


def _repeated(named: DataFrame, window: int) -> DataFrame:
    docs = named.select(F.col("_id").alias("doc_id"), F.col("_print").alias("print"), "text")
    split = prefix_split(docs, window)
    shared = docs.sparkSession.sparkContext.broadcast(split)  # flags of at most 8 MB a level
    sent = docs.mapInArrow(released(_sent(shared, window)), _SENT).repartition(split.groups, "grp")  # tasks grow with the groups
    found = sent.groupBy("grp").applyInPandas(_subtree(split.ranges()), _FOUND)
    return found.groupBy("rng").applyInPandas(_spans(window), "doc_id long, print long, spans binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, print, spans (little-endian 32-bit pairs: first word, word behind
    the last) that repeated windows cover; one row for each document that has any."""
    bound_batches(docs.sparkSession)
    return _repeated(_named(docs), window)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with ``_spans``: what repeated windows cover in each, or null."""
    bound_batches(docs.sparkSession)
    named = _named(docs)
    found = _repeated(named, window).withColumnsRenamed({"doc_id": "_its", "print": "_own", "spans": "_spans"})
    return named.join(found, (F.col("_id") == F.col("_its")) & (F.col("_print") == F.col("_own")), "left").drop("_id", "_print", "_its", "_own")


def _kept_mask(count: int, spans: bytes | None) -> np.ndarray:
    kept = np.ones(count, bool)
    for lo, hi in np.frombuffer(spans or b"", "<u4").reshape(-1, 2).tolist():
        kept[lo:hi] = False
    return kept


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, reach = W.utf8(whole.column("text"))
            for lo, hi in W.slices(reach, SLICE_BYTES):
                b = whole.slice(lo, hi - lo)
                data, offsets = W.utf8(b.column("text"))
                w = W.split(data, offsets)
                body, gone, digest = data.tobytes(), [], []
                for i, spans in enumerate(b.column("_spans").to_pylist()):
                    kept = _kept_mask(int(w.counts[i]), spans)
                    at = np.flatnonzero(kept) + w.first[i]
                    gone.append(len(kept) - len(at))
                    digest.append(hashlib.sha256(b" ".join([body[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist())])).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return removed(docs.select("doc_id", "text"), window).select("doc_id", "text", "_spans").mapInArrow(
        released(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
