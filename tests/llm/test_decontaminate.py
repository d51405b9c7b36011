import hashlib
import random
import re

import numpy as np
import pytest

from candlewick.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, spans string, row long, items string"
ITEMS = "item_id long, text string, words string, n int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            grams.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for d, text in docs:
        w = WORD.findall(lower(text))
        hit, ids = set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                g = tuple(w[i:i + size])
                if g in grams:
                    hit.update(range(i, i + size))
                    ids |= {str(x) for x in grams[g] if x is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", "y", 1, "z") for d in docs], DOCS),
            spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS))


def got(spark, docs, items, **kw):
    out = D.report(*rows(spark, docs, items), **kw)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, out.collect()), key=str)


def planted(seed, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Äh", "été", "数", "X9"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 9, 10, 11, 30])))) for i in range(12)]
    items = [(i, t) if len(t.split()) > 3 else (i, t + " only here") for i, t in items]
    docs = []
    for d in range(60):
        w = rng.choices(words, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1].split()
            a = rng.randrange(len(t))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[a:a + rng.randrange(1, 31)]
        docs.append((d, rng.choice([" ", "\n", "--", "\t. "]).join(w)))
    return docs, items


@pytest.mark.parametrize("seed,shard,block", [(1, 1_000_000, 4_000_000), (2, 40, 4_000_000), (3, 25, 60), (4, 300, 20)])
def test_matches_brute_force(spark, seed, shard, block):
    docs, items = planted(seed)
    assert got(spark, docs, items, shard=shard, block_words=block) == brute(docs, items)


def test_defined_cases(spark):
    long = " ".join(f"a{i % 7} b{i % 11}" for i in range(3000))
    item = "One two THREE four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, " .,- "), (None, "zero " + item), (None, item.upper()), (5, long), (5, long), (6, "short item"), (6, "short-item short"),
            (7, "one " * 40), (8, item[:-7] + " x " + item)]
    items = [(1, item), (1, "short item"), (2, "SHORT item"), (None, "zero one"), (3, None), (4, ""), (5, long), (6, "one one one"), (6, "one one one")]
    assert got(spark, docs, items, shard=500) == brute(docs, items)
    assert got(spark, docs, [], shard=500) == brute(docs, [])
    assert got(spark, [], items) == []


def test_spans_are_merged(spark):
    item = " ".join(f"k{i}" for i in range(14))
    docs = [(1, f"a b {item} c {item} {item}")]
    out = D.spans(*rows(spark, docs, [(9, item)])).collect()
    assert [[tuple(s) for s in r["spans"]] for r in out] == [[(2, 16), (17, 45)]] and out[0]["items"] == ["9"]


def test_index_answers_as_the_text_does():
    rng = np.random.default_rng(4)
    counts = np.array([50, 1, 400, 7, 0, 120])
    words = rng.integers(0, 6, counts.sum()).astype(np.uint64)
    words[60:160] = words[200:300]
    parts = D.Index.made(words, counts)
    ends = parts.pop("ends")
    index = D.Index(**parts)
    text = np.full(len(words) + len(counts), 99)
    text[np.setdiff1d(np.arange(len(text)), ends)] = words
    for size in (1, 2, 5, 9):
        phrase = rng.integers(0, 6, (40, size)).astype(np.uint64)
        phrase[:20] = [words[a:a + size] for a in rng.integers(60, 300, 20)]
        lo, hi = index.backward(index.symbols_of(phrase.ravel()).reshape(phrase.shape), np.full(40, size))
        for p, a, b in zip(phrase, lo, hi):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - size + 1) if (text[i:i + size] == p).all()]
