import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from candlewick.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_runs string, runs string, row int, period double"


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(w[i:j + q - d] == w[i + d:j + q] for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, plant):
    w = WORD.findall(text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    top = best[0] if best else (None,) * 3
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs),
                                                              " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if best else None, *digest)


def docs_of(spark, docs):
    return spark.createDataFrame([(*d, "x", "y", 1, 2.0) for d in docs], SCHEMA)


def made(seed):
    rng = random.Random(seed)
    docs = []
    for i in range(150):
        words = [rng.choice("abcdefgh" if i % 3 else "ab") for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):
            root = [rng.choice("abcdé") for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (root * 7)[:rng.randrange(6 * len(root) + 1)]
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("plant", [True, False])
def test_matches_brute_force(spark, plant):
    docs = made(1) + [(i, " ".join(f"w{j * i % 97}" for j in range(i % 150))) for i in range(1000, 1200)]
    got = P.periodic_runs(docs_of(spark, docs), plant=plant, full=False)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(brute(*d, plant) for d in docs)
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 60


def test_defined_cases(spark):
    nested = ("a a a a a a b " * 5 + "c ") * 5
    docs = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 50), (None, "y " * 5), (4, nested), (4, nested), (5, "z z " * 6), (6, "ab " * 20000),
            (7, "p q r s " * 300), (7, "p")]
    got = P.report(docs_of(spark, docs)).collect()
    assert sorted(str(tuple(r)) for r in got if r["doc_id"] != 6) == sorted(str(brute(*d, True)) for d in docs if d[0] != 6)
    assert [(r["n_runs"], r["start"], r["length"], r["period"]) for r in got if r["doc_id"] == 6] == [(1, 0, 20000, 1)]
    assert P.report(docs_of(spark, [])).count() == 0


def test_runs_and_collapsed_text(spark):
    r = P.periodic_runs(docs_of(spark, [(1, "x a b a b a b a b y")])).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 8, 2)] and r["collapsed"] == "x a b y"


def test_lyndon_lengths_under_both_orders():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 3, 6):
        for _ in range(60):
            codes = rng.integers(0, kinds, int(rng.integers(1, 40))).tolist()
            if rng.random() < 0.4:
                codes = (codes[:5] * 9)[:40]
            codes[len(codes) // 2:len(codes) // 2] = [-1]
            codes.append(-1)
            for order in (codes, [c if c < 0 else kinds - 1 - c for c in codes]):
                got = P.lyndon_lengths(order, kinds)
                for i, c in enumerate(order):
                    if c >= 0:
                        end = order.index(-1, i)
                        longest = max(j for j in range(i + 1, end + 1) if all(order[i:j] < order[k:j] for k in range(i + 1, j)))
                        assert got[i] == longest - i


def test_common_extensions():
    rng = np.random.default_rng(3)
    codes = np.concatenate([np.tile(rng.integers(0, 2, 6), 9), [90], rng.integers(0, 2, 60), [91]])
    f = P.Factors(codes)
    a = rng.integers(0, len(codes) - 1, 400)
    b = np.minimum(a + rng.integers(1, 30, 400), len(codes) - 1)
    for x, y, fw, bw in zip(a, b, f.forward(a, b), f.backward(a, b)):
        if x == y:
            continue
        k = 0
        while y + k < len(codes) and codes[x + k] == codes[y + k]:
            k += 1
        assert fw == k
        k = 0
        while x - k - 1 >= 0 and codes[x - k - 1] == codes[y - k - 1]:
            k += 1
        assert bw == k
