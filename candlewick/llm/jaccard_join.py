"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct five-word shingles (A-Z folded), as 64-bit
hashes; a document of one to four words has its whole word sequence as its
one shingle.  Two documents link when the similarity of their sets reaches the
threshold (100 * intersection >= 75 * union).

1. Sets are fingerprinted; documents of equal sets are one node from here on.
2. Shingles are counted over all documents.  Map tasks send sorted, compressed
   shingle ranges (40 bits of each hash) with counts; range owners add them
   up.  A chunk's ranges also name the document of each shingle that the chunk
   has once, and the owners hand back, by chunk, the documents of shingles
   seen once in all.  A document with more of these than a linked one may have
   for itself can link with nothing and goes no further.  No task and not the
   driver holds anything of the size of all shingles.  *Frequent* shingles (seen
   ``frequent`` times or more) come in levels of a power of two, in a table of
   bounded size; beyond it a shingle counts as rare, which costs time only.
3. All sets are ordered alike: rare, then frequent by level, ties by hash.  A
   prefix takes shingles until the mismatches a linked partner may
   have cannot break every signature: a rare shingle is a
   signature by itself; frequent shingles are dealt to hash groups, and each
   two of one group are a signature, so a group counts its shingles less one.
   The prefix is extended accordingly.  Any two linked sets share a signature.
   Groups grow with the size of the set, so that the number of combinations
   stays in proportion to it; sets near a border of two size bands combine under
   both.
4. Signatures held by the very same nodes count once.  Nodes of one signature
   are compared and verified on whole sets: first with
   a few centres of the signature (rounds with changing centres, the first of
   them with the smallest share of shingles of its own, as the original of near
   copies has), where each node goes to those it shares most signatures with;
   components of what was found make most other comparisons needless.  Then
   every pair of different components that shares a signature is verified: pairs
   of signatures with at most ``HOT`` nodes one by one, the others in tiles of
   bounded size, one task a tile, by products of their shingle matrices.  A tile
   hands on a spanning forest of its links, never its pairs.

Components are exact; links inside a component beyond a spanning set are not
expanded.

Defined cases: null and empty texts (also of separators alone) have an empty
set and link with nothing; repeated rows are equal sets and so link; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm import words as W
from candlewick.llm.common import bound_batches, cut, release, released, stored
from candlewick.llm.components import components

WIDTH, NUM, DEN = 5, 75, 100
SLICE_BYTES = 1_000_000
CHUNK, CHUNK_RANGE = 500_000, 500  # shingles a map task gathers before it sends them: in all, and a range
RANGE = 1_000_000  # shingles of one range owner
MAX_BITS = 26  # the bitmap of asked nodes has at most 2**26 bits (8 MB)
MAX_FREQUENT = 500_000  # shingles in the frequent table (8 MB)
SHORT = 24  # bits dropped of a hash for counting
CENTRE_ROUNDS = 2
MERGE_ROUNDS = 2
HOT = 48  # nodes of a signature that is compared in tiles
PART, PART_SHINGLES = 3072, 1_200_000  # nodes and shingles of a side of a tile: a node goes to as many tiles as its signature has sides
SLICE = 2048  # shingles of a matrix product
CENTRES, TRIES = 4, 2  # centres of a signature in a round, and how many of all its centres a node is compared with


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row end to end, and row offsets."""
    w = W.split(data, offsets)
    hashes = W.word_hashes(data, w, lower=True)
    grams = W.gram_hashes(hashes, width)
    out, ends = [], np.zeros(len(w.counts) + 1, np.int64)
    for i, n in enumerate(w.counts.tolist()):
        a = int(w.first[i])
        if n >= width:
            own = np.sort(grams[a:a + n - width + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            out.append(W.mix64(W.gram_hashes(hashes[a:a + n], n) + np.uint64(n)))
        ends[i + 1] = ends[i] + (len(out[-1]) if n else 0)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[ends[1:]] - total[ends[:-1]]


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits that stand for each row's set."""
    size = np.diff(ends).astype(np.uint64)
    return W.mix64(_sums(W.mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), ends) + W.mix64(size)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        _, reach = W.utf8(whole.column("text"))
        for lo, hi in W.slices(reach, SLICE_BYTES):
            b = whole.slice(lo, hi - lo)
            yield b, *shingle_sets(*W.utf8(b.column("text")))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, hashes, ends in _sets(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(fingerprints(hashes, ends))],
                                         names=["doc_id", "n_shingles", "node"])


# -- counting -----------------------------------------------------------------
def _counted(ranges: int, chunk: int):
    """Map side, by chunks of documents: compressed (range, shingles, counts,
    documents of shingles that the chunk has once) of a chunk; the nodes and
    sizes of its documents as a negative range."""
    shift = np.uint64(64 - SHORT - max(0, ranges.bit_length() - 1))

    def send(name: int, parts: list[np.ndarray], ends: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(parts)
        size = np.concatenate([np.diff(e) for e in ends])
        short = hashes >> np.uint64(SHORT)
        order = np.argsort(short)
        values = short[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        values, counts = values[heads], np.diff(np.append(heads, len(values)))
        place = np.where(counts == 1, np.repeat(np.arange(len(size)), size)[order[heads]], 0)
        cut_at = np.searchsorted(values >> shift, np.arange(ranges + 1)) if ranges > 1 else np.array([0, len(values)])
        used = np.flatnonzero(np.diff(cut_at))
        spans = [slice(cut_at[r], cut_at[r + 1]) for r in used]
        node = np.concatenate([fingerprints(h, e) for h, e in zip(parts, ends)])
        return pa.RecordBatch.from_arrays(
            [pa.array([*used.tolist(), -1 - name % ranges], pa.int32()), pa.array([name] * (len(used) + 1), pa.int64()),
             pa.array([*(W.pack_sorted(values[x]) for x in spans), node.tobytes()], pa.binary()),
             pa.array([*(W.pack_counts(counts[x]) for x in spans), W.pack_counts(size)], pa.binary()),
             pa.array([*(W.pack_counts(place[x]) for x in spans), None], pa.binary())], names=["range", "chunk", "shingles", "counts", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, reach, held, name = [], [], 0, TaskContext.get().partitionId() << 32
        for _, hashes, ends in _sets(batches):
            parts.append(hashes)
            reach.append(ends)
            held += len(hashes)
            if held >= chunk:
                yield send(name, parts, reach)
                parts, reach, held, name = [], [], 0, name + 1
        if held:
            yield send(name, parts, reach)

    return run


def _added(frequent: int):
    """Range owner: by chunk, the documents of single shingles (level -1), and
    its frequent shingles by level; the nodes of a chunk pass (level -2)."""
    columns = ["range", "level", "n", "chunk", "body", "sizes"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = int(frame["range"].iloc[0])
        if own < 0:
            return pd.DataFrame([(own, -2, 0, *r) for r in zip(frame["chunk"], frame["shingles"], frame["counts"])], columns=columns)
        values = [W.unpack_sorted(b) for b in frame["shingles"]]
        chunk = np.repeat(np.arange(len(values)), [len(v) for v in values])
        values = np.concatenate(values)
        counts = np.concatenate([W.unpack_counts(b) for b in frame["counts"]]).astype(np.int64)
        place = np.concatenate([W.unpack_counts(b) for b in frame["places"]]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values = values[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        total, values = np.add.reduceat(counts[order], heads), values[heads]
        once = order[heads[total == 1]]
        once = np.sort(chunk[once] << 32 | place[once])
        ends = np.searchsorted(once, np.arange(len(frame) + 1) << 32)
        once = (once & 0xFFFFFFFF).astype(np.uint64)
        rows = [(own, -1, int(b - a), int(c), W.pack_sorted(once[a:b]), None) for a, b, c in zip(ends[:-1], ends[1:], frame["chunk"]) if b > a]
        hot = total >= frequent
        values, level = values[hot], np.floor(np.log2(total[hot])).astype(np.int64)
        rows += [(own, int(k), int((level == k).sum()), -1, W.pack_sorted(values[level == k]), None) for k in np.unique(level)]
        return pd.DataFrame(rows, columns=columns)

    return run


def _openable(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a chunk with too few single shingles to stand alone, and the
    share of these among their shingles, in thousandths."""
    whole = frame["level"] == -2
    node, size = np.frombuffer(frame["body"][whole].iloc[0], np.int64), W.unpack_counts(frame["sizes"][whole].iloc[0]).astype(np.int64)
    alone = np.zeros(len(node), np.int64)
    for body in frame["body"][~whole]:
        alone += np.bincount(W.unpack_sorted(body).astype(np.int64), minlength=len(node))
    some = (size > 1) & (alone < size - -(-NUM * size // DEN) + 1)
    return pd.DataFrame({"node": node[some], "own": 1000 * alone[some] // size[some]})


@dataclass
class Classes:
    """What a task needs to order shingles; bounded by the constants above."""
    hot: np.ndarray  # sorted short hashes of frequent shingles
    level: np.ndarray

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """0 for shingles that are not frequent."""
        if not len(self.hot):
            return np.zeros(len(hashes), np.int64)
        short = hashes >> np.uint64(SHORT)
        at = np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)
        return np.where(self.hot[at] == short, self.level[at], 0)


def count_classes(docs: DataFrame, total: int, frequent: int) -> tuple[Classes, DataFrame]:
    """The frequent shingles, and (node, own) of the nodes that may link."""
    ranges = 1 << max(0, (total // RANGE)).bit_length()
    sent = docs.select("text").mapInArrow(released(_counted(ranges, max(CHUNK, ranges * CHUNK_RANGE))),
                                          "range int, chunk long, shingles binary, counts binary, places binary")
    added = stored(sent.groupBy("range").applyInPandas(_added(frequent), "range int, level int, n long, chunk long, body binary, sizes binary"))
    held, least = 0, None
    for r in added.where("level >= 0").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        held += r["n"]
        if held > MAX_FREQUENT:
            break
        least = r["level"]
    hot, level = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in added.where(F.col("level") >= (least if least is not None else 99)).select("level", "body").collect():
        hot.append(W.unpack_sorted(r["body"]))
        level.append(np.full(len(hot[-1]), r["level"]))
    hot, level = np.concatenate(hot), np.concatenate(level)
    order = np.argsort(hot)
    release()
    some = added.where("level < 0").select("level", "chunk", "body", "sizes").groupBy("chunk").applyInPandas(_openable, "node long, own long")
    return Classes(hot[order], level[order]), stored(some.groupBy("node").agg(F.min("own").alias("own")))


# -- signatures ---------------------------------------------------------------
def band_groups(n: int) -> list[tuple[int, int]]:
    """(band, hash groups) that a set of this size indexes under: its own
    band, and the one a smaller partner may be of."""
    def band(size: int) -> int:
        return 0 if size < 32 else (size.bit_length() - 6) // 2 + 1
    bands = sorted({band(n), band(-(-NUM * n // DEN))})
    return [(b, 1 if b == 0 else 4 ** b) for b in bands]


def signatures(tokens: np.ndarray, single: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Signature hashes of one sorted set; ``single`` flags shingles known to
    be of no other set."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.uint64)  # only equal sets can link, and they are one node
    need = n - -(-NUM * n // DEN) + 1 - int(single.sum())
    if need <= 0:
        return np.zeros(0, np.uint64)  # enough shingles that no other document has
    rare = tokens[~single & (level == 0)]
    out, left = [rare[:need]], need - len(rare)
    if left > 0:
        hot = np.flatnonzero(level > 0)
        hot = tokens[hot[np.lexsort((tokens[hot], level[hot]))]]
        for band, groups in band_groups(n):
            salt = np.uint64(0x632BE59BD9B4E019 * (band + 1) & 0xFFFFFFFFFFFFFFFF)
            group = (hot >> np.uint64(7)) % np.uint64(groups)
            counts = np.ones(len(hot), np.int64)
            counts[np.unique(group, return_index=True)[1]] = 0  # a group's first shingle makes no pair
            size = int(np.searchsorted(np.cumsum(counts), left)) + 1
            part, group = hot[:size], group[:size]
            order = np.argsort(group, kind="stable")
            part, group = part[order], group[order]
            for mine in np.split(part, np.flatnonzero(group[1:] != group[:-1]) + 1):
                i, j = np.triu_indices(len(mine), 1)
                out.append(W.mix64(W.mix64(mine[i] ^ salt) + W.mix64(mine[j])))
    return np.unique(np.concatenate(out))


def asked_bits(nodes: DataFrame, many: int) -> tuple[int, np.ndarray]:
    """A bitmap of nodes (one column, node; ``many`` or fewer), and its bits as
    a power of two."""
    bits = min(MAX_BITS, max(16, (16 * many).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_spots(b.column("node").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16, pa.int32()), pa.array(at & 0xFFFF, pa.int32())], names=["part", "at"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        body = np.zeros(1 << 16, bool)
        body[frame["at"].to_numpy()] = True
        return pd.DataFrame({"part": frame["part"].iloc[:1], "body": [np.packbits(body).tobytes()]})

    asked = np.zeros((1 << bits >> 16, 1 << 13), np.uint8)
    for r in nodes.mapInArrow(spots, "part int, at int").groupBy("part").applyInPandas(merged, "part int, body binary").collect():
        asked[r["part"]] = np.frombuffer(r["body"], np.uint8)
    return bits, asked.ravel()


def _spots(node: np.ndarray, bits: int) -> np.ndarray:
    return (W.mix64(node.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _asked(node: np.ndarray, asked: tuple[int, np.ndarray]) -> np.ndarray:
    """Whether the bitmap has the nodes (some others as well)."""
    spot = _spots(node, asked[0])
    return (asked[1][spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1


def _signed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, asked = shared.value
        for _, hashes, ends in _sets(batches):
            node, size = fingerprints(hashes, ends), np.diff(ends)
            some = (size > 1) & _asked(node, asked)
            at = np.flatnonzero(np.repeat(some, size))
            level, single = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
            level[at] = classes.levels(hashes[at])
            rows, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i in np.flatnonzero(some):
                a, b = ends[i], ends[i + 1]
                found = signatures(hashes[a:b], single[a:b], level[a:b])
                rows.append(np.full(len(found), i))
                sigs.append(found)
            at, sig = np.concatenate(rows), np.concatenate(sigs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(node[at], pa.int64()), pa.array(size[at], pa.int64())], names=["sig", "node", "n"])

    return run


# -- verification -------------------------------------------------------------
def _held(shared):
    """node, body of documents whose node may be asked for (48 bits a shingle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for _, hashes, ends in _sets(batches):
            node = fingerprints(hashes, ends)
            wanted = np.flatnonzero(_asked(node, asked) & (np.diff(ends) > 0))
            _, once = np.unique(node[wanted], return_index=True)
            wanted = wanted[once]
            short = (hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[wanted], pa.int64()), pa.array([short[ends[i]:ends[i + 1]].tobytes() for i in wanted], pa.binary())], names=["node", "body"])

    return run


def _opened(body: bytes) -> np.ndarray:
    wide = np.zeros((len(body) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column("body_a"), b.column("body_b")):
            x, y = _opened(x.as_py()), _opened(y.as_py())
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = int((y[at] == x).sum())
            good.append(DEN * same >= NUM * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])


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


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of a tile between different components, as a spanning forest."""
    sets = [_opened(b) for b in frame["body"]]
    size = np.array([len(x) for x in sets])
    code, known = pd.factorize(np.concatenate(sets))
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(code, minlength=len(known)) > 1
    code, row = (np.cumsum(shared) - 1)[code[shared[code]]], row[shared[code]]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    same = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), SLICE):
        a, b = np.searchsorted(code, [lo, lo + SLICE])
        has = np.zeros((len(sets), SLICE), np.float32)
        has[row[a:b], code[a:b] - lo] = 1.0
        same += has @ has.T
    linked = DEN * same >= NUM * (size[:, None] + size[None] - same)  # exact: whole numbers below 2**24
    component, part = frame["component"].to_numpy(), frame["part"].to_numpy()
    linked &= component[:, None] != component[None]
    if frame["lo"].iloc[0] != frame["hi"].iloc[0]:
        linked &= part[:, None] != part[None]
    edges = np.array(_forest(linked), np.int64).reshape(-1, 2)
    node = frame["node"].to_numpy()
    return pd.DataFrame({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})


def merged(rows: DataFrame, turn: int) -> DataFrame:
    """Signatures (sig, node, n, component, c nodes, total shingles) of much the
    same nodes as one: those with the same smallest node by a hash, where the
    pairs of all their nodes are no more than their own pairs one by one."""
    columns = ["sig", "node", "n", "component", "c", "total"]
    lead = rows.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("lead"), F.count("*").alias("held"))
    lead = lead.select("sig", F.col("lead.node").alias("lead"), (F.col("held") * F.col("held")).alias("pairs"))
    led = rows.join(lead, "sig")
    nodes = led.groupBy("lead", "node").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    fits = (nodes.groupBy("lead").agg(F.count("*").alias("c"), F.sum("n").alias("total")).join(lead.groupBy("lead").agg(F.sum("pairs").alias("pairs")), "lead")
            .where(F.col("c") * F.col("c") <= F.col("pairs")).select("lead", "c", "total"))
    one = nodes.join(fits, "lead").withColumn("sig", F.xxhash64("lead", F.lit(turn))).select(*columns)
    return one.union(led.join(fits, "lead", "left_anti").select(*columns))


def tile_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that join the components of every signature's nodes, for
    signatures (sig, c nodes, total shingles) too large to list their pairs."""
    parts = F.greatest(F.ceil(F.col("c") / PART), F.ceil(F.col("total") / PART_SHINGLES)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("sig", "node", "component", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return dealt.join(sets, "node").groupBy("sig", "lo", "hi").applyInPandas(_tile, "a long, b long")


def candidate_sets(docs: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """node, body of every node of ``nodes`` (one column, node; ``many`` or fewer)."""
    shared = docs.sparkSession.sparkContext.broadcast(asked_bits(nodes, many))
    sets = docs.select("text").mapInArrow(released(_held(shared)), "node long, body binary").groupBy("node").agg(F.first("body").alias("body"))
    sets = stored(sets.join(nodes, "node", "left_semi"))
    shared.destroy()
    return sets


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, linked for pairs of nodes, on whole sets."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b"))
    return both.select("a", "b", "body_a", "body_b").mapInArrow(released(_linked), "a long, b long, linked boolean")


def _fits() -> F.Column:
    return F.greatest("na", "nb") * NUM <= F.least("na", "nb") * DEN


def _telling(rows: DataFrame) -> DataFrame:
    """Rows of signatures that two nodes or more have; of signatures with the
    very same nodes, which ask for the same comparisons, one stays."""
    held = rows.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return rows.join(held.where("c > 1").groupBy("c", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig")


def linked_components(docs: DataFrame, nodes: DataFrame, frequent: int = 16) -> DataFrame:
    """(node, component) of nodes that link with another; components are named
    by their smallest node."""
    spark = docs.sparkSession
    total = nodes.agg(F.sum("n_shingles")).collect()[0][0] or 0
    classes, some = count_classes(docs, total, frequent)
    many = some.count()
    shared = spark.sparkContext.broadcast((classes, asked_bits(some.select("node"), many)))
    signed = docs.select("text").mapInArrow(released(_signed(shared)), "sig long, node long, n long")
    rows = stored(signed.groupBy("sig", "node").agg(F.first("n").alias("n")))
    shared.destroy()
    rows = stored(_telling(rows).join(some, "node"))
    sets = candidate_sets(docs, rows.select("node").distinct(), many)

    none = spark.createDataFrame([], "a long, b long, linked boolean")
    checked, found = none, spark.createDataFrame([], "node long, component long")
    for turn in range(CENTRE_ROUNDS):
        open_ = _open(rows, found)
        rows = open_.drop("component")
        picked = [F.min(F.struct(F.col("own") if turn + k == 0 else F.lit(0), F.xxhash64("node", F.lit(turn * CENTRES + k)), "node", "n", "component"))
                  for k in range(CENTRES)]
        centre = open_.groupBy("sig").agg(F.array(*[F.struct(p["node"].alias("node"), p["n"].alias("n"), p["component"].alias("component")) for p in picked]).alias("c"))
        centre = centre.select("sig", F.explode("c").alias("c"))
        centre = centre.select("sig", F.col("c.node").alias("b"), F.col("c.n").alias("nb"), F.col("c.component").alias("cb")).distinct()
        near = open_.join(centre, "sig").where("component <> cb").select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb").where(_fits())
        near = near.groupBy("a", "b").agg(F.count("*").alias("c"))
        near = near.join(checked.select(F.col("a").alias("b"), F.col("b").alias("a")).union(checked.select("b", "a")), ["a", "b"], "left_anti")
        best = near.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("k") <= TRIES)
        pairs = cut(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not pairs.isEmpty():
            checked = cut(checked.union(verify(sets, pairs)))
            found = components(checked.where("linked").select("a", "b"))

    open_ = _open(rows, found)
    sized = open_.groupBy("sig").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    open_ = stored(open_.join(sized, "sig"))
    hot = open_.where(F.col("c") > HOT)
    for turn in range(MERGE_ROUNDS):
        hot = stored(merged(hot, turn))
    forest = cut(tile_links(hot, sets))
    cold = open_.where(F.col("c") <= HOT)
    left = cold.select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    right = cold.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = left.join(right, "sig").where("a < b AND ca <> cb").where(_fits()).select("a", "b").distinct()
    last = verify(sets, cut(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")))
    return components(cut(checked.union(last).where("linked").select("a", "b").union(forest)))


def _open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with their components, of signatures whose nodes are of several."""
    open_ = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = open_.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
    return stored(open_.join(mixed, "sig"))


def component_table(docs: DataFrame, frequent: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id for every document row."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    nodes = stored(docs.mapInArrow(released(_nodes), f"doc_id {kind}, n_shingles long, node long"))
    found = linked_components(docs, nodes, frequent)
    whole = nodes.where("n_shingles > 0").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (whole.join(first, "component").select("doc_id", "n_shingles", "component_id")
            .union(nodes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def _marked(columns: list[str]):
    """The rows with the size and the fingerprint of their sets, and a number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b, hashes, ends in _sets(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(np.diff(ends), pa.int64()), pa.array(fingerprints(hashes, ends)),
                                              pa.array(np.arange(number, number + b.num_rows))], names=[*columns, "__n", "__node", "__row"])
            number += b.num_rows

    return run


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents, all columns as they were: the
    one with the smallest doc_id (null last), of several such one.  Rows without
    words stay.  Rows that share a doc_id but hold different texts are judged
    each for itself."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__n", "__node", "__row"))])
    rows = stored(docs.mapInArrow(released(_marked(docs.columns)), schema))
    nodes = rows.select("doc_id", F.col("__n").alias("n_shingles"), F.col("__node").alias("node"))
    found = linked_components(rows.select("doc_id", "text"), nodes)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    first = rows.where("__n > 0").groupBy(F.col("__node").alias("node")).agg(F.min(place).alias("place"))
    first = first.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("place").alias("place"))
    stay = first.select(F.col("place.row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").select(*docs.columns).union(rows.where("__n = 0").select(*docs.columns))
