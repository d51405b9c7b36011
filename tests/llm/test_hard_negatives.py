import math

import numpy as np
import pytest

from candlewick.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, q string, norm string, rank int"


def brute(rows, shift):
    own = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if shift and i % 7 == 0 else lab
        v = [float(np.float32(x)) for x in v]
        if i not in own or (lab, v) < own[i]:
            own[i] = (lab, v)
    whole = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in own.items()}
    whole = {i: r for i, r in whole.items() if sum(x * x for x in r[1]) < 2**62}
    out = []
    for a in whole:
        if a % 100:
            continue
        lab, v = whole[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in whole.items() if len(w) == len(v)}
        best = sorted((i for i in score if i != a and whole[i][0] == lab), key=lambda i: (-score[i], i))[:5]
        for p in best:
            fits = [i for i in score if whole[i][0] != lab and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:10])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)


def got(spark, rows, shift=True):
    df = frame(spark, rows)
    out = H.mine(H.shifted(df) if shift else df)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(seed, n, d=8, step=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    v = centres[rng.integers(0, 6, n)] * rng.uniform(0.2, 2, (n, 1)) + rng.standard_normal((n, d)) * rng.choice([0, 0.01, 0.5], (n, 1))
    return [(i * step, [float(np.float32(x)) for x in v[i]], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("tile,anchors,shift", [(256, 20_000, True), (3, 7, True), (16, 4, False)])
def test_matches_brute_force(spark, monkeypatch, tile, anchors, shift):
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    rows = vectors(tile, 400)
    want = brute(rows, shift)
    assert got(spark, rows, shift) == want and len(want) > 300


def test_defined_cases(spark):
    rows = vectors(1, 60, d=4, step=20) + [
        (None, [1.0] * 4, 1), (101, None, 1), (102, [1.0] * 4, None), (103, [float("nan")] + [1.0] * 3, 1), (104, [None, 1.0, 1.0, 1.0], 2),
        (105, [float("inf")] * 4, 1), (106, [0.0] * 4, 1), (200, [9.0] * 4, 0), (200, [9.0] * 4, 0), (107, [3e38] * 4, 1), (1500, [3e6] * 4, 1),
        (1501, [3e6] * 4, 1), (1502, [2e6, 2e6, 2e6, 2.000001e6], 2), (1600, [1.0, 2.0], 1), (1601, [1.0, 2.0], 1), (1602, [0.5, 1.0], 2), (1700, [], 1),
        (1701, [], 1), (1702, [], 2), (-100, [1.0] * 4, 1), (1800, [0.0] * 4, 3), (1801, [0.0] * 4, 3)]
    assert got(spark, rows) == brute(rows, True)
    assert got(spark, []) == []
    assert got(spark, [(5, [1.0], 1)]) == []


def test_ties_go_by_id(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(100, 112)] + [(i, [0.5, 0.5], 2) for i in range(112, 140)]
    out = got(spark, rows, False)
    assert out == brute(rows, False) and [r[3] for r in out[:10]] == list(range(112, 122))


def test_bounds_hold_and_leave_tiles_out():
    rng = np.random.default_rng(5)
    q = np.floor(rng.standard_normal((300, 3)) * 100)
    refs = H.directions(list(q[:50]))

    def angles(x):
        return np.arccos(np.clip(x @ refs.T / np.linalg.norm(x, axis=1)[:, None], -1, 1))

    block = H.Block(np.arange(300), np.zeros(300), q, np.linalg.norm(q, axis=1), angles(q))
    order = np.lexsort((angles(q).min(axis=1), angles(q).argmin(axis=1)))
    left_out = 0
    for a in range(0, 300, 10):
        t = q[order[a:a + 10]]
        low, high = block.bounds(np.linalg.norm(t, axis=1), angles(t))
        score = q @ t.T
        assert (low <= score.min(axis=1)).all() and (score.max(axis=1) <= high).all()
        left_out += (high < 0.8 * block.norm**2).sum()
    assert left_out > 3000
