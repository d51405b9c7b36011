"""SentencePiece sampled encoding and lossless decoding.

A text is escaped as SentencePiece does (a dummy space in front, spaces shown
as U+2581), its piece lattice is built from the vocabulary, and a segmentation
is drawn with probability proportional to the product of its piece weights:
forward filtering sums the weights of all ways to reach each position,
backward sampling walks from the end and picks an incoming piece by its share.

The uniform number of a step is a hash of (seed, row key, position in the
row's text), so a row's segmentation depends on nothing else: not on its
partition, batch or neighbours.  Shares are rounded to 2**-30 and compared as
integers.

The lattice falls apart at every U+2581 that starts a run and around newlines,
because no multi-character piece crosses them (checked when the vocabulary is
loaded); each distinct chunk of a batch is filtered once.  All steps are
vectorised over the chunks and rows of a batch.

Weights: unigram vocabularies use ``alpha`` times the stored log probability.
BPE vocabularies store merge ranks instead, so a piece of rank r weighs
(r + 2) ** -alpha.  Characters without a piece become byte pieces.  No
normalisation is applied; with a literal U+2581 spelled in byte pieces,
decoding gives back every text exactly.

Defined cases: null text gives null ids; empty text gives no ids; repeated
rows (equal key and text) get equal segmentations; a null key is hashed as a
value of its own; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import bound_batches, released
from candlewick.llm.words import mix64, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
BATCH_BYTES = 400_000
BITS = 30
_SPACE, _LITERAL, _NEWLINE = 0x2581, 0x110001, 0x0A
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0xD1B54A32D192ED03)


@dataclass
class Vocabulary:
    """Pieces of a model as plain arrays (a few MB, fixed by the vocabulary)."""
    pieces: list[str]
    weights: np.ndarray  # log weight of each normal piece, nan for others
    byte_ids: np.ndarray  # id of each byte's piece
    byte_weight: float
    _ready: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    @staticmethod
    def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)])
        byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, decoding could not be lossless")
        normal = scores[~special]
        ranks = len(normal) and (normal == np.round(normal)).all() and normal.min() <= -len(normal) / 2
        log_weight = -alpha * np.log(-scores + 2) if ranks else alpha * scores
        for i in np.flatnonzero(~special):
            p = pieces[i]
            if len(p) > 1 and ("\n" in p or "▁" in p.lstrip("▁")):
                raise ValueError(f"piece {p!r} crosses a chunk border")
        return Vocabulary(pieces, np.where(special, np.nan, log_weight), byte_ids, float(np.min(log_weight[~special])) - 10)

    # -- lookup of substrings ------------------------------------------------
    def table(self):
        """Open-addressing table: hash of every prefix of a piece -> piece id,
        or -1 where the prefix is no piece itself."""
        if "table" not in self._ready:
            entries: dict[int, int] = {}
            for i, p in enumerate(self.pieces):
                if np.isnan(self.weights[i]):
                    continue
                h = 0
                for k, c in enumerate(p):
                    h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                    entries[h] = i if k == len(p) - 1 else entries.get(h, -1)
            size = 1 << (8 * len(entries)).bit_length()
            keys, values, probes = np.zeros(size, np.uint64), np.full(size, -2, np.int32), 1
            slots = (mix64(np.fromiter(entries, np.uint64, len(entries))) & np.uint64(size - 1)).astype(np.int64)
            for at, (h, v) in zip(slots.tolist(), entries.items()):
                tries = 1
                while values[at] != -2:
                    at, tries = (at + 1) & (size - 1), tries + 1
                keys[at], values[at], probes = h, v, max(probes, tries)
            longest = max((len(p) for i, p in enumerate(self.pieces) if not np.isnan(self.weights[i])), default=0)
            text = [b"" if np.isnan(w) else p.replace("▁", " ").encode() for p, w in zip(self.pieces, self.weights)]
            for b, i in enumerate(self.byte_ids):
                text[i] = bytes([b])
            lengths = np.array([len(t) for t in text], np.int64)
            self._ready["table"] = (keys, values, probes, longest, np.frombuffer(b"".join(text), np.uint8),
                                    np.concatenate([[0], np.cumsum(lengths)]))
        return self._ready["table"]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 (only a prefix) or -2 (neither) of each hash."""
        keys, values, probes = self.table()[:3]
        mask = len(keys) - 1
        at = (mix64(h) & np.uint64(mask)).astype(np.int64)
        out = np.where(keys[at] == h, values[at], -2)
        open_ = np.flatnonzero((keys[at] != h) & (values[at] != -2))
        for _ in range(probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & mask
            hit = keys[at[open_]] == h[open_]
            out[open_[hit]] = values[at[open_[hit]]]
            open_ = open_[~hit & (values[at[open_]] != -2)]
        return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


@dataclass
class Lattice:
    """Edges of a batch's distinct chunks, sorted by end node.  Nodes are
    numbered per chunk: chunk c has length + 1 nodes from ``node[c]`` on."""
    node: np.ndarray
    upper: np.ndarray  # cumulated share of each edge among those with its end node, times 2**BITS
    edge: np.ndarray  # first edge of each node
    start: np.ndarray  # start node of each edge
    piece: np.ndarray  # piece id, -1 for a character spelled in bytes


def build_lattice(vocab: Vocabulary, codes: np.ndarray, lengths: np.ndarray) -> Lattice:
    """Edges and forward-filtered shares of chunks laid end to end."""
    longest = vocab.table()[3]
    first = np.cumsum(lengths) - lengths
    chunk = np.repeat(np.arange(len(lengths)), lengths)
    end_of = (first + lengths)[chunk]
    at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    starts, sizes, found = [], [], []
    single = np.zeros(len(codes), bool)
    for size in range(1, longest + 1):
        h = h * _BASE + codes[at + size - 1].astype(np.uint64) + np.uint64(1)
        v = vocab.find(h)
        hit = v >= 0
        if size == 1:
            single[at[hit]] = True
        starts.append(at[hit])
        sizes.append(np.full(int(hit.sum()), size))
        found.append(v[hit])
        go = (v > -2) & (at + size < end_of[at])
        at, h = at[go], h[go]
        if not len(at):
            break
    spelled = np.flatnonzero(~single)
    start = np.concatenate([*starts, spelled])
    size = np.concatenate([*sizes, np.ones(len(spelled), np.int64)])
    piece = np.concatenate([*found, np.full(len(spelled), -1)]).astype(np.int64)
    weight = np.where(piece >= 0, vocab.weights[piece], vocab.byte_weight)

    node = first + np.arange(len(lengths))
    level = start + size - first[chunk[start]]  # characters up to the edge's end
    to = node[chunk[start]] + level
    order = np.argsort(level * (len(codes) + len(lengths) + 1) + to, kind="stable")
    start, size, piece, weight, level, to = (x[order] for x in (start, size, piece, weight, level, to))
    from_node = to - size

    # runs of edges with one end node
    head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(to))))
    alpha = np.full(len(codes) + len(lengths), -np.inf)
    alpha[node] = 0.0
    share = np.empty(len(to), np.int64)
    stops = np.searchsorted(level, np.arange(1, (int(level[-1]) if len(level) else 0) + 2))
    for a, b in zip(stops[:-1], stops[1:]):
        if a == b:
            continue
        r0, r1 = run[a], run[b - 1] + 1
        heads, mine = head[r0:r1] - a, run[a:b] - r0
        v = alpha[from_node[a:b]] + weight[a:b]
        top = np.maximum.reduceat(v, heads)
        part = np.exp(v - top[mine])
        whole = np.add.reduceat(part, heads)
        alpha[to[a + heads]] = top + np.log(whole)
        share[a:b] = part / whole[mine] * (1 << BITS)
    # cumulated shares inside each run, as integers; the last one is 2**BITS
    total = np.cumsum(share)
    before = np.concatenate([[0], total])[head] if len(head) else np.zeros(0, np.int64)
    upper = total - before[run] if len(to) else total
    if len(head):
        upper[np.append(head[1:], len(to)) - 1] = 1 << BITS
    edge = np.zeros(len(alpha), np.int64)
    edge[to[head]] = head
    return Lattice(node, upper, edge, from_node, piece)


def _chunks(codes: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Start positions of chunks: rows, runs of spaces, newlines and what follows them."""
    space, line = codes == _SPACE, codes == _NEWLINE
    cut = np.zeros(len(codes) + 1, bool)
    cut[:-1] = line
    cut[1:] |= line
    cut[1:-1] |= space[1:] & ~space[:-1]
    cut[row_start[row_start < len(codes)]] = True
    return np.flatnonzero(cut[:-1])


def encode_rows(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets of the ids) of UTF-8 rows; ``keys`` are 64-bit row hashes."""
    rows = len(offsets) - 1
    text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    seen = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.diff(seen[offsets])
    # a dummy space before every row that is not empty
    extra = (chars > 0).astype(np.int64)
    row_len = chars + extra
    row_start = np.cumsum(row_len) - row_len
    codes = np.empty(int(row_len.sum()), np.int64)
    dummy = row_start[extra > 0]
    body = np.ones(len(codes), bool)
    body[dummy] = False
    text = np.where(text == _SPACE, _LITERAL, np.where(text == 0x20, _SPACE, text))
    codes[dummy], codes[body] = _SPACE, text
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)

    begin = _chunks(codes, row_start)
    length = np.diff(np.append(begin, len(codes)))
    step = (codes.astype(np.uint64) + np.uint64(1)) * _GOLD
    # two sums over each chunk, one with position weights from a table, tell distinct chunks apart
    inside = np.arange(len(codes)) - np.repeat(begin, length)
    mark = mix64(mix64(inside.astype(np.uint64)) ^ step)
    digest = mix64(np.add.reduceat(mark, begin) + length.astype(np.uint64))
    _, example, which = np.unique(digest, return_index=True, return_inverse=True)
    sizes = length[example]
    lattice = build_lattice(vocab, codes[_ranges(begin[example], sizes)], sizes)

    row = np.repeat(np.arange(rows), row_len)
    base = mix64(keys ^ mix64(np.array([seed], np.uint64))[0])
    chosen = np.full(len(codes), -2, np.int64)
    first = lattice.node[which]  # node of each chunk's start
    node = first + length
    shift = begin - first  # character position = node + shift
    own = row[begin]
    key, zero = base[own], row_start[own]
    live = np.arange(len(begin))
    while len(live):
        here = node[live]
        place = (here + shift[live] - zero[live]).astype(np.uint64)
        u = (mix64(key[live] + place * _GOLD) >> np.uint64(64 - BITS)).astype(np.int64)
        edge = lattice.edge[here]
        past = np.flatnonzero(lattice.upper[edge] <= u)
        while len(past):  # a node has at most as many edges as the longest piece has characters
            edge[past] += 1
            past = past[lattice.upper[edge[past]] <= u[past]]
        back = lattice.start[edge]
        chosen[back + shift[live]] = lattice.piece[edge]
        node[live] = back
        live = live[back > first[live]]

    at = np.flatnonzero(chosen > -2)
    piece = chosen[at]
    spelled = np.flatnonzero(piece == -1)
    if not len(spelled):
        return piece, np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=rows))])
    c = codes[at[spelled]]
    c = np.where(c == _LITERAL, _SPACE, np.where(c == _SPACE, 0x20, c))
    as_bytes = np.frombuffer(c.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    width = np.ones(len(at), np.int64)
    width[spelled] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    ids = np.repeat(piece, width)
    ids[ids == -1] = vocab.byte_ids[as_bytes]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(row[at], weights=width, minlength=rows).astype(np.int64))])


def decode_rows(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of rows of ids."""
    flat, place = vocab.table()[4:]
    size = np.diff(place)[ids]
    out = flat[_ranges(place[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    keep = np.ones(len(out), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False  # the dummy space of rows that are not empty
    return out[keep], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


def vocabulary(spark: SparkSession, path: str = MODEL, alpha: float = ALPHA):
    """The vocabulary, read on the driver and shared (its size is fixed by the model)."""
    return spark.sparkContext.broadcast(Vocabulary.load(path, alpha))


_KEPT: dict = {}


def _vocab(shared) -> Vocabulary:
    """One per worker, so that its lookup table is built once."""
    if _KEPT.get("of") != (key := id(shared.value)):
        _KEPT.update(of=key, vocab=shared.value)
    return _KEPT["vocab"]


def encode(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), path: str = MODEL, alpha: float = ALPHA,
           seed: int = 11) -> DataFrame:
    """key, kept columns, token_ids (array<int>), n_tokens and lossless (the
    ids were decoded and compared with the text) of every row."""
    bound_batches(docs.sparkSession)
    shared = vocabulary(docs.sparkSession, path, alpha)
    kinds = dict(docs.dtypes)
    names = [key, *(k for k in keep if k != key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocab(shared)
        for whole in batches:
            _, reach = utf8(whole.column("_text"))
            for lo, hi in slices(reach, BATCH_BYTES):
                b = whole.slice(lo, hi - lo)
                data, offsets = utf8(b.column("_text"))
                ids, ends = encode_rows(vocab, data, offsets, b.column("_key").to_numpy().view(np.uint64), seed)
                back, back_ends = decode_rows(vocab, ids, ends)
                same = np.array_equal(back_ends, offsets) and np.array_equal(back, data)
                good = np.full(len(b), True) if same else np.array(
                    [back[back_ends[i]:back_ends[i + 1]].tobytes() == data[offsets[i]:offsets[i + 1]].tobytes() for i in range(len(b))])
                null = b.column("_text").is_null()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n) for n in names), lists, pa.array(np.diff(ends), pa.int64()), pa.array(good)],
                    names=[*names, "token_ids", "n_tokens", "lossless"])

    kept = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return docs.select(*names, F.col("text").alias("_text"), F.xxhash64(key).alias("_key")).mapInArrow(
        released(run), f"{kept}, token_ids array<int>, n_tokens long, lossless boolean")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """key and text of rows of ``token_ids``; null ids give null text."""
    bound_batches(encoded.sparkSession)
    shared = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocab(shared)
        for b in batches:
            lists = b.column("token_ids")
            ids = lists.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            body, offsets = decode_rows(vocab, ids, ends)
            text = pa.LargeStringArray.from_buffers(len(b), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
            text = pa.array([t if v else None for t, v in zip(text.to_pylist(), lists.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(key), text], names=[key, "text"])

    return encoded.select(key, "token_ids").mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")
