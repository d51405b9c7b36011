import hashlib
import re

import numpy as np
import pytest

from candlewick.llm import substring_dedup as S
from candlewick.llm.words import WORD

SCHEMA = "doc_id long, text string, starts string, n_words string, grp int"


def brute(rows, window=20):
    words = [re.findall(WORD, t or "") for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words):
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            first[key] = min(first.get(key, (k, j)), (k, j))
    out = []
    for (k, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < (k, j):
                gone[j:j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    passages = [[f"p{p}_{j}" for j in range(int(rng.integers(15, 60)))] for p in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(int(rng.integers(0, 5))):
            w += [f"the{rng.integers(3)}" for _ in range(int(rng.integers(0, 25)))]
            p = passages[int(rng.integers(6))]
            a = int(rng.integers(0, 10))
            w += p[a:] if rng.random() < 0.5 else p
            w += [f"u{i}_{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 30)))]
        rows.append((i * 37 % 211, "  ".join(w)))
    return rows


@pytest.mark.parametrize("seed,group", [(1, 3_000_000), (2, 500), (3, 60)])
def test_matches_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(S, "GROUP", group)
    rows = corpus(seed) + [(500, "same " * 45), (501, "same " * 30), (502, None), (503, ""), (504, " ".join(f"z{i % 20}" for i in range(90)))]
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, S.report(docs).collect())) == brute(rows)


def test_repeated_rows_get_equal_results(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "", "", 0), (1, text, "", "", 0), (2, text, "", "", 0), (None, text, "", "", 0)], SCHEMA)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["n_removed"]) for r in S.report(docs).collect()), key=str)
    assert got == [(False, None, 0), (True, 1, 40), (True, 1, 40), (True, 2, 40)]


@pytest.mark.parametrize("group", [1_500_000, 60])
@pytest.mark.parametrize("ident", [None, 9])
def test_different_texts_with_no_id_or_one_id_are_documents_of_their_own(spark, monkeypatch, ident, group):
    monkeypatch.setattr(S, "GROUP", group)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = {k: " ".join(f"{k}{i}" for i in range(70)) for k in "abcd"}
    texts["c"] = " ".join(f"c{i}" for i in range(20)) + " " + passage + " c_end"
    texts["e"] = " ".join(f"e{i}" for i in range(20)) + " " + passage + " e_end"  # at the same start as in c
    texts["f"] = passage + " " + " ".join(f"f{i}" for i in range(40))
    texts["s"] = " ".join([f"s{i}" for i in range(25)] * 2)  # repeats itself
    docs = spark.createDataFrame([(ident, t, "x", "y", 1) for t in texts.values()] + [(20, passage, "x", "y", 1)], SCHEMA).repartition(3)
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"], r["doc_id"]) for r in S.report(docs).collect() if r["doc_id"] == ident)
    kept = {hashlib.sha256(t.replace(passage, "").strip().replace("  ", " ").encode()).hexdigest() for t in texts.values()}
    assert sorted(r[1] for r in got if r[0] in (51, 70)) == [0, 0, 0, 0, 30, 30]
    assert [r[1] for r in got if r[0] == 50] == [25]
    held = [r for r in got if r[1] == 30]
    assert all(r[2] in kept for r in held)  # the passage went, not other words
    assert [r["n_removed"] for r in S.report(docs).collect() if r["doc_id"] == 20] == [30]


def test_equal_rows_without_an_id_and_the_smallest_id(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(None, text, "", "", 0)] * 3 + [(S._NULL_ID, text, "", "", 0), (None, text + " b", "", "", 0)]
    got = S.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    same = [r["n_removed"] for r in got if r["doc_id"] is None and r["n_words"] == 40]
    assert len(same) == 3 and len(set(same)) == 1
    assert sorted([same[0], *(r["n_removed"] for r in got if r["doc_id"] is not None or r["n_words"] == 41)]) == [0, 40, 40]


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefixes_are_extended_on_demand(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 80)
    rows = [(i, " ".join(["a b c d"] * 3 + [f"w{i % 9}_{j}" for j in range(25)] + [f"u{i}"])) for i in range(60)]
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in rows], SCHEMA).repartition(3)
    split = S.prefix_split(S._named(docs).select("text"))
    sizes = [level.size for level in split.levels]
    assert sizes[:3] == [1, 2, 4] and all(level.flags.any() for level in split.levels[:3])
    assert split.words == sum(len(t.split()) - 19 for _, t in rows) and split.groups == -(-split.words // 80)
    assert sorted(map(tuple, S.report(docs).collect())) == brute(rows)


def test_cells_follow_what_is_open_and_counts_merge_in_bounded_steps(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in rows], SCHEMA).repartition(9)
    monkeypatch.setattr(S, "GROUP", 200)
    want = S.prefix_split(docs.select("text"))
    monkeypatch.setattr(S, "MERGED", 2)
    got = S.prefix_split(docs.select("text"))
    assert [(x.size, x.bits, x.flags.tobytes()) for x in got.levels] == [(x.size, x.bits, x.flags.tobytes()) for x in want.levels]
    assert len(want.levels) > 1 and len(S.prefix_split(docs.select("text"), 2).levels) == 1


def test_results_are_packed_by_range_and_merged_to_spans():
    ids, starts = np.array([7, 7, 8, 7, 7, 9]), np.array([5, 6, 0, 40, 5, 3])
    rng, rows = S._packed(ids, np.zeros(6, np.int64), starts, 2)
    assert len(rng) == len(rows) <= 2
    import pandas as pd

    out = [S._spans(20)(pd.DataFrame([r], columns=list(S._RESULTS))) for r in rows]
    spans = {int(r.doc_id): np.frombuffer(r.spans, "<u4").tolist() for o in out for r in o.itertuples()}
    assert spans == {7: [5, 26, 40, 60], 8: [0, 20], 9: [3, 23]}


def test_map_side_resolution_and_group_resolution_agree():
    labels = np.array([1, 1, 1, 2, 3, 3], np.uint64)
    ids = np.array([5, 4, 5, 1, 2, 2])
    starts = np.array([0, 9, 3, 0, 7, 7])
    first, later = S._runs(labels, ids, starts)
    assert later.tolist() == [True, False, True, False, False, False] and first.sum() == 3
