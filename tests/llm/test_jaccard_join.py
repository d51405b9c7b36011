import re

import numpy as np
import pytest

from candlewick.llm import jaccard_join as J
from candlewick.llm.words import WORD

SCHEMA = "doc_id long, text string, component_id string, n_shingles string, node string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = re.findall(WORD, fold(text))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    name = {}
    for i, (k, _) in enumerate(rows):
        name[find(i)] = min(name.get(find(i), k), k)
    return sorted((k, len(sets[i]), name[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed, passage):
    """Documents of many sizes with near copies at all distances round the
    threshold, and a passage that most of them share."""
    rng = np.random.default_rng(seed)
    shared = [f"p{j}" for j in range(passage)]
    rows = []
    for g in range(14):
        n = int(rng.integers(2, 160))
        base = [f"g{g}w{j}" for j in range(n)]
        for c in range(int(rng.integers(1, 7))):
            w = list(base)
            for at in rng.integers(0, n, int(rng.integers(0, max(2, n // 20)))):
                w[at] = f"x{rng.integers(10**9)}"
            cutoff = int(rng.integers(0, max(1, n // 6)))
            w = w[cutoff:]
            if rng.random() < 0.7:
                w = shared + w if rng.random() < 0.5 else w + shared
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,passage,frequent", [(1, 0, 2), (2, 30, 3), (3, 120, 2)])
def test_components_match_brute_force(spark, seed, passage, frequent):
    rows = corpus(seed, passage)
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)
    got = sorted(map(tuple, J.component_table(docs, frequent=frequent).collect()))
    assert got == brute(rows)


def test_edges_of_the_contract(spark):
    same = "a b c d e f g h"
    rows = [(5, same), (3, same.upper()), (9, None), (8, ""), (7, " \t "), (1, "one two"), (2, "ONE two"), (4, "one"), (6, "one three"),
            (5, same), (20, "É b c d e"), (21, "é b c d e"), (30, "w " * 50_000), (31, "w " * 9)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    got = sorted(map(tuple, J.component_table(docs).collect()))
    assert got == brute(rows)
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9, 20, 21, 30]


def near_copies(n, seed, edits):
    """Near copies of one text that lie about the threshold, with and without the text itself."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    rows = [(1, " ".join(base))] if seed % 2 else []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, edits))):
            w[at] = f"e{rng.integers(0, 40)}"
        rows.append((10 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,part", [(1, 1024), (2, 16), (3, 7)])
def test_a_hot_group_about_the_threshold(spark, monkeypatch, seed, part):
    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "PART", part)
    monkeypatch.setattr(J, "SLICE", 64)
    rows = near_copies(90, seed, 7)
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)
    got = sorted(map(tuple, J.component_table(docs, frequent=3).collect()))
    want = brute(rows)
    assert got == want and 3 < len({r[2] for r in want}) < 88


def test_signatures_of_much_the_same_nodes_share_their_tiles(spark, monkeypatch):
    """Near copies share a hundred signatures; a node's set goes out a few times, not once for each."""
    seen, tiles = [], J.tile_links

    def watched(rows, sets):
        seen.append((rows.count(), rows.select("node").distinct().count()))
        return tiles(rows, sets)

    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "tile_links", watched)
    rows = near_copies(90, 2, 7)
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)
    assert sorted(map(tuple, J.component_table(docs, frequent=3).collect())) == brute(rows)
    assert seen[0][1] > 20 and seen[0][0] <= 4 * seen[0][1]


def test_merged_signatures_hold_every_pair(spark):
    rng = np.random.default_rng(5)
    held = {sig: sorted({int(x) for x in rng.choice(np.arange(40 * (sig % 3), 40 * (sig % 3) + 60), int(rng.integers(2, 40)))}) for sig in range(30)}
    rows = [(sig, node, 5, node % 4, len(nodes), 5 * len(nodes)) for sig, nodes in held.items() for node in nodes]
    frame = spark.createDataFrame(rows, "sig long, node long, n long, component long, c long, total long")
    for turn in range(2):
        frame = J.merged(frame, turn)
    out = {}
    for r in frame.collect():
        assert r["n"] == 5 and r["component"] == r["node"] % 4
        out.setdefault((r["sig"], r["c"], r["total"]), []).append(r["node"])
    assert all(len(nodes) == len(set(nodes)) == c and total == 5 * c for (_, c, total), nodes in out.items())
    pairs = {(a, b) for nodes in out.values() for a in nodes for b in nodes}
    assert {(a, b) for nodes in held.values() for a in nodes for b in nodes} <= pairs
    assert sum(len(x) ** 2 for x in out.values()) < sum(len(x) ** 2 for x in held.values())


def test_a_tile_gives_the_links_between_components():
    import pandas as pd

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**47, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(45, 60)), replace=False), rng.integers(0, 2**47, 4).astype(np.uint64)])) for _ in range(50)]
    component, part = rng.integers(0, 5, 50), rng.integers(0, 2, 50)

    def body(x):
        return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

    for lo, hi in ((0, 0), (0, 1)):
        out = J._tile(pd.DataFrame({"node": np.arange(50), "component": component, "part": part, "lo": lo, "hi": hi, "body": [body(x) for x in sets]}))
        links = {(i, j) for i in range(50) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
                 and component[i] != component[j] and (lo == hi or part[i] != part[j])}
        got = {(max(a, b), min(a, b)) for a, b in zip(out["a"], out["b"])}
        assert got <= links

        def reach(edges):
            name = list(range(50))
            for a, b in sorted(edges) * 50:
                name[a] = name[b] = min(name[a], name[b])
            return name

        assert reach(got) == reach(links)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4"
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c), (None, c), (None, "own text without an id here"), (None, None), (5, None), (5, None)]
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)
    assert sorted(((r["doc_id"], r["text"]) for r in J.keep_first(docs).collect()), key=str) == sorted(
        [(1, a), (1, b), (4, c), (None, "own text without an id here"), (None, None), (5, None), (5, None)], key=str)


def test_empty_table(spark):
    assert J.component_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_that_link_with_nothing_are_not_indexed(spark, monkeypatch):
    """However many shingles the table repeats: 150,000 here, more than any bounded bitmap of 2**16 bits tells apart."""
    monkeypatch.setattr(J, "MAX_BITS", 16)
    indexed, stored = [], J.stored

    def watched(df):
        out = stored(df)
        if "sig" in out.columns:
            indexed.append({r["node"] for r in out.select("node").distinct().collect()})
        return out

    monkeypatch.setattr(J, "stored", watched)
    twice = [" ".join(f"t{g}w{j}" for j in range(500)) for g in range(300)]
    near = [twice[0].replace("t0w7 ", "other "), twice[1].replace("t1w400 ", "")]
    alone = [" ".join(f"a{g}w{j}" for j in range(120)) for g in range(200)]
    rows = [(i, t) for i, t in enumerate([*twice, *twice, *near, *alone])]
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)
    own = {r["node"] for r in docs.where("doc_id >= 602").mapInArrow(J._nodes, "doc_id long, n_shingles long, node long").collect()}
    got = {r["doc_id"]: r["component_id"] for r in J.component_table(docs).collect()}
    assert got == {i: i if i < 300 or i >= 602 else i % 300 for i in range(802)}
    assert indexed and len(own) == 200 and all(len(own & nodes) <= 10 for nodes in indexed)


def test_chunks_name_the_documents_that_may_link(spark, monkeypatch):
    """Small chunks and many ranges: a node may link unless more than a quarter of its shingles are nobody else's."""
    monkeypatch.setattr(J, "CHUNK", 200)
    monkeypatch.setattr(J, "CHUNK_RANGE", 1)
    monkeypatch.setattr(J, "RANGE", 300)
    rows = corpus(5, 60)
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA).repartition(3)
    nodes = J.stored(docs.mapInArrow(J._nodes, "doc_id long, n_shingles long, node long"))
    _, some = J.count_classes(docs, nodes.agg({"n_shingles": "sum"}).collect()[0][0], 3)
    texts = [J.W.utf8(J.pa.array([t])) for _, t in rows]
    sets = [J.shingle_sets(*t)[0] for t in texts]
    node = [int(J.fingerprints(h, np.array([0, len(h)]))[0]) for h in sets]
    seen = np.unique(np.concatenate(sets) >> np.uint64(J.SHORT), return_counts=True)
    once = {int(v) for v, c in zip(*seen) if c == 1}
    alone = [sum(int(h) >> J.SHORT in once for h in s) for s in sets]
    want = {k: 1000 * a // len(s) for k, s, a in zip(node, sets, alone) if len(s) > 1 and a <= len(s) - -(-75 * len(s) // 100)}
    assert {r["node"]: r["own"] for r in some.collect()} == want and 0 < len(want) < len(set(node))


def test_any_two_linked_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(2, 400))
        universe = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        x = np.unique(universe[:n])
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(0.8, 1))), replace=False), universe[n:n + int(rng.integers(0, 1 + n // 8))]]))
        if 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)) or np.array_equal(x, y):
            continue
        # any classes that are the same for both sets; what only one has may be single
        level = {int(t): int(v) for t, v in zip(universe, rng.integers(0, 4, len(universe)) * (rng.random() < 0.8))}
        both = np.intersect1d(x, y)
        got = []
        for s in (x, y):
            lv = np.array([level[int(t)] for t in s])
            single = ~np.isin(s, both) & (lv == 0) & (s % np.uint64(2) == 0)
            got.append(J.signatures(s, single, np.where(single, 0, lv)))
        assert len(np.intersect1d(*got))
