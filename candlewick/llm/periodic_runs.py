"""Periodic run detection: Lyndon arrays by Baier grouping, roots extended by LCE.

A run is a stretch of consecutive words of one document with smallest period q
and a length of at least ``max(LEAST, POWER * q)`` that no neighbouring word
extends.  Three steps:

1. *Reach.*  In such a run every word lies in a ``SEED``-word window that is
   found again a period further on in the document (``LEAST`` and ``POWER``
   leave room for both).  Words in no repeated window are in no run and extend
   none, so the text falls into independent stretches of repeated windows.
2. *Lyndon arrays.*  The first phase of Baier's suffix sorter groups positions
   by their longest Lyndon prefix: groups are taken from the highest down, and
   a group's word is appended to the words that end where it starts.  It runs
   once on the order of the word codes and once on the inverse order.
3. *Runs.*  By the runs theorem the Lyndon root of every run is the longest
   Lyndon word, under one of the orders, at some position.  Each pair (position,
   root length) is extended to both sides by longest common extensions, read
   off a table of ranks of 2**k-word factors; equal results are one run.

Words are compared by 64-bit hashes.  The work is per document, so there is
no shuffle; a task holds the words of about ``SLICE_BYTES`` of text, or of one
longer document.

Defined cases: null text has no words and no runs; a null doc_id has no
checksum, so its words stay as they are; repeated rows get equal results, one
each; the empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from candlewick.llm import words as W
from candlewick.llm.common import bound_batches, released

LEAST = 6
POWER = 4
SEED = 5
SLICE_BYTES = 2_000_000


# --- Lyndon arrays ------------------------------------------------------------------

def lyndon_lengths(codes: list[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word at each place, for words numbered
    0 to ``kinds`` - 1 in their order; -1 is the border between stretches."""
    n = len(codes)
    length, group = [1] * n, list(codes)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(codes):
        if c >= 0:
            members[c].append(i)
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    #: place -> the place of the unfinished word that ends before it (-1: none)
    owner = [-1] * (n + 1)
    for i in range(1, n):
        if codes[i] >= 0 and codes[i - 1] >= 0:
            owner[i] = i - 1
    group.append(-1)
    top = kinds - 1
    while top >= 0:
        moved: dict[tuple[int, int], list[int]] = {}
        for s in members[top]:
            if group[s] != top:
                continue  # went up to a longer word
            p = owner[s]
            if p >= 0 and group[p] == top:
                continue  # inside a chain of equal words, taken from its head
            size = length[s]
            end, times = s + size, 1
            while end < n and group[end] == top:
                end, times = end + size, times + 1
            if p >= 0:
                length[p] += end - s
                moved.setdefault((group[p], times), []).append(p)
            if end < n and codes[end] >= 0:
                owner[end] = p
        # the more copies follow, the higher the longer word: just above the one it grew from
        for (old, _), places in sorted(moved.items(), key=lambda m: -m[0][1]) if len(moved) > 1 else moved.items():
            new = len(members)
            members.append(places)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = below[up] = new  # there is one above: the group at hand
            for p in places:
                group[p] = new
        members[top] = []
        top = below[top]
    return length


# --- common extensions --------------------------------------------------------------

class Factors:
    """Ranks of the 2**k-word factors at every place."""

    def __init__(self, codes: np.ndarray) -> None:
        """``codes`` ends every stretch with a border that occurs once."""
        self.ranks = [codes]
        size, n = 1, len(codes)
        while True:
            last = self.ranks[-1]
            if 2 * size > n:
                break
            pair = last[:n - 2 * size + 1].astype(np.int64) << 32 | last[size:n - size + 1]
            code, known = pd.factorize(pair)
            if len(known) == len(pair):
                break  # no factor of this size occurs twice
            self.ranks.append(code)
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from ``a`` and from ``b`` on that agree."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, size = self.ranks[k], 1 << k
            while True:  # a border stops every pair, and the top size can fit again
                x, y = a + out, b + out
                fits = np.flatnonzero(y < len(r))
                same = fits[r[x[fits]] == r[y[fits]]]
                out[same] += size
                if k < len(self.ranks) - 1 or not len(same):
                    break
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before ``a`` and before ``b`` that agree."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, size = self.ranks[k], 1 << k
            while True:
                x, y = a - out - size, b - out - size
                fits = np.flatnonzero((x >= 0) & (y < len(r)))
                same = fits[r[x[fits]] == r[y[fits]]]
                out[same] += size
                if k < len(self.ranks) - 1 or not len(same):
                    break
        return out


# --- runs ---------------------------------------------------------------------------

def repeated(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of ``SEED`` words that its row has twice."""
    n = len(hashes) - SEED + 1
    out = np.zeros(len(hashes) + 1, np.int64)
    if n > 0:
        grams = W.gram_hashes(hashes, SEED)
        inside = np.flatnonzero(row[:n] == row[SEED - 1:])
        own = W.mix64(grams[inside] ^ W.mix64(row[inside].astype(np.uint64) + np.uint64(1)))
        at = inside[pd.Series(own).duplicated(keep=False).to_numpy()]
        np.add.at(out, at, 1)
        np.subtract.at(out, at + SEED, 1)
    return np.cumsum(out[:-1]) > 0


@dataclass
class Runs:
    """Runs of the rows, by row, start and period."""
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(hashes: np.ndarray, row: np.ndarray, first: np.ndarray) -> Runs:
    """All runs of the rows whose words (in row order) have these hashes;
    ``first`` is the index of each row's first word."""
    covered = repeated(hashes, row)
    at = np.flatnonzero(covered)
    none = np.zeros(0, np.int64)
    if not len(at):
        return Runs(none, none, none, none)
    # stretches one after the other, a border after each
    cut = np.concatenate([[False], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
    place = np.arange(len(at)) + np.cumsum(cut)
    word = np.full(place[-1] + 2, -1, np.int64)
    word[place] = at
    code, known = pd.factorize(hashes[at])
    codes = np.full(len(word), -1, np.int64)
    codes[place] = code
    kinds = len(known)
    borders = np.flatnonzero(codes < 0)
    apart = codes.copy()
    apart[borders] = kinds + np.arange(len(borders))
    factors = Factors(apart)
    places, periods = [], []
    for order in (codes, np.where(codes < 0, -1, kinds - 1 - codes)):
        lengths = np.array(lyndon_lengths(order.tolist(), kinds), np.int64)
        places.append(place)
        periods.append(lengths[place])
    a, q = np.concatenate(places), np.concatenate(periods)
    # the root is followed by its first word again, else it is no period of anything longer
    some = apart[a] == apart[a + q]
    a, q = a[some], q[some]
    left = factors.backward(a, a + q)
    length = left + q + factors.forward(a, a + q)
    long = length >= np.maximum(LEAST, POWER * q)
    start, length, q = (a - left)[long], length[long], q[long]
    pick = np.lexsort((q, start))
    start, length, q = start[pick], length[pick], q[pick]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (q[1:] != q[:-1])
    start, length, q = word[start[new]], length[new], q[new]
    return Runs(row[start], start - first[row[start]], length, q)


# --- documents ----------------------------------------------------------------------

def planted(n: int, doc_id) -> np.ndarray | None:
    """Word numbers of the text that is judged, where it differs: by the
    checksum of the id a tenth of the documents end periodically."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


#: n_runs and the strongest run, the digests, and the runs themselves
_COLUMNS = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
            "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _row(runs: list[tuple[int, int, int]], words: list[bytes]) -> tuple:
    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    collapsed = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(collapsed).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed.decode())


def periodic_runs(docs: DataFrame, plant: bool = False, full: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with
    the greatest length to period, runs_sha256, collapsed_sha256 and, with
    ``full``, the runs and the text without the words that a run repeats.

    ``plant`` judges the texts that :func:`planted` makes of the documents.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = _COLUMNS if full else _COLUMNS[:_COLUMNS.index(", runs array")]
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if full else [])]
    types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, reach = W.utf8(whole.column("text"))
            for lo, hi in W.slices(reach, SLICE_BYTES):
                b = whole.slice(lo, hi - lo)
                data, offsets = W.utf8(b.column("text"))
                w = W.split(data, offsets)
                pick = np.arange(len(w.starts))
                if plant:
                    for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                        new = planted(int(w.counts[i]), doc_id)
                        if new is not None:
                            pick[w.first[i]:w.first[i + 1]] = w.first[i] + new
                found = find_runs(W.word_hashes(data, w)[pick], w.row, w.first[:-1])
                order = np.lexsort((found.period, found.start, found.row))
                by_row: dict[int, list] = {}
                for r, *one in zip(*(x[order].tolist() for x in (found.row, found.start, found.length, found.period))):
                    by_row.setdefault(r, []).append(tuple(one))
                body, starts, ends = data.tobytes(), w.starts[pick].tolist(), w.ends[pick].tolist()
                rows = [_row(by_row.get(i, []), [body[s:e] for s, e in zip(starts[x:y], ends[x:y])])
                        for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist()))]
                values = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t, _ in zip(values, types, names))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, {columns}")


def report(docs: DataFrame) -> DataFrame:
    """The runs of the documents as :func:`planted` makes them."""
    return periodic_runs(docs, plant=True, full=False)
