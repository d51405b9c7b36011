import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import piece_sampling as P
from candlewick.llm.words import utf8

ODD = ["", " ", "  a  b\n\n\t x ", "▁▁ literal", "漢字 é 😀 \x00 end", "▁", "no-space" * 300, "x\r\ny", "Ünïcödé tèxt", " lead", "trail "]


@pytest.fixture(scope="module")
def vocab():
    return P.Vocabulary.load()


def encoded(vocab, texts, keys, seed=1):
    data, offsets = utf8(pa.array(texts))
    ids, ends = P.encode_rows(vocab, data, offsets, np.array(keys, np.uint64), seed)
    return ids, ends, data, offsets


def test_round_trip_of_odd_texts(vocab):
    ids, ends, data, offsets = encoded(vocab, ODD, range(len(ODD)))
    body, back = P.decode_rows(vocab, ids, ends)
    assert np.array_equal(body, data) and np.array_equal(back, offsets)


def test_a_row_does_not_depend_on_its_batch(vocab):
    texts = ODD + ["the hat on the mat\nand more of the same"] * 3
    ids, ends, _, _ = encoded(vocab, texts, range(len(texts)))
    for i, t in enumerate(texts):
        alone, _, _, _ = encoded(vocab, [t], [i])
        assert np.array_equal(alone, ids[ends[i]:ends[i + 1]])


def test_samples_follow_the_lattice(vocab):
    n = 6000
    ids, ends, _, _ = encoded(vocab, ["hat trick"] * n, range(n), seed=9)
    got = collections.Counter(tuple(ids[ends[i]:ends[i + 1]]) for i in range(n))
    known = {p: i for i, p in enumerate(vocab.pieces) if not math.isnan(vocab.weights[i])}

    def ways(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest, w in ways(s[k:]):
                    yield (known[s[:k]], *rest), w + vocab.weights[known[s[:k]]]

    want = {k: math.exp(w) for k, w in ways("▁hat▁trick")}
    total = sum(want.values())
    assert set(got) <= set(want)
    for k, w in want.items():
        p = w / total
        assert abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2 / n


def test_byte_pieces_match_the_library(vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    ids, _, _, _ = encoded(vocab, ["a sample of words 漢"], [3])
    assert sp.decode(ids.tolist()) == "a sample of words 漢"


def test_frames_with_nulls_and_clashing_columns(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(ODD)] + [(50, None, "x", 5), (None, "null key", None, None), (0, ODD[0], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")
    out = P.encode(docs)
    got = out.collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    assert next(r for r in got if r["doc_id"] == 50)["token_ids"] is None
    back = {r["doc_id"]: r["text"] for r in P.decode(out).collect()}
    assert back == {i: t for i, t, *_ in rows}
    assert P.encode(docs.limit(0)).count() == 0
