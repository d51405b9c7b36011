import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import words as W
from candlewick.llm.components import components

TEXT = st.text(alphabet=st.sampled_from(list("ab AZ\n\t\x0b\x0c\x0d\x1cé漢😀 .")), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_split_and_hashes_follow_the_pattern(texts):
    data, offsets = W.utf8(pa.array(texts, pa.string()))
    w = W.split(data, offsets)
    body = data.tobytes()
    got = [[body[s:e].decode() for s, e, r in zip(w.starts, w.ends, w.row) if r == i] for i in range(len(texts))]
    want = [re.findall(W.WORD, t or "") for t in texts]
    assert got == want
    flat = [x for ws in want for x in ws]
    for lower in (False, True):
        h = W.word_hashes(data, w, lower)
        names = [re.sub("[A-Z]", lambda m: m.group().lower(), x) if lower else x for x in flat]
        for i in range(len(flat)):
            for j in range(i):
                assert (h[i] == h[j]) == (names[i] == names[j])


def test_gram_hashes_tell_sequences_apart():
    rng = np.random.default_rng(1)
    h = W.mix64(rng.integers(0, 3, 400).astype(np.uint64))
    for k in (1, 2, 5, 8, 20):
        g = W.gram_hashes(h, k)
        assert len(g) == len(h) - k + 1
        names = {}
        for i in range(len(g)):
            assert names.setdefault(tuple(h[i:i + k]), g[i]) == g[i]
        assert len(set(names.values())) == len(names)
    assert len(W.gram_hashes(h[:3], 5)) == 0


def test_packing_round_trip():
    v = np.sort(np.random.default_rng(2).integers(0, 2**63, 1000).astype(np.uint64))
    assert (W.unpack_sorted(W.pack_sorted(v)) == v).all()
    c = np.array([0, 1, 70000, 2**32 - 1])
    assert (W.unpack_counts(W.pack_counts(c)) == c).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_empty_word_behind_the_last_byte_has_a_hash(monkeypatch):
    monkeypatch.setattr(W, "_POWERS", W._Powers())
    data = np.frombuffer(b"a" * 15 + b"\n", np.uint8)
    found = W.word_hashes(data, W.Words(np.array([0, 16]), np.array([15, 16]), np.array([0, 0]), np.array([2]), np.array([0, 2])))
    assert len(found) == 2 and found[0] != found[1]
