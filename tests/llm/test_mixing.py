import re

import numpy as np
import pytest

from candlewick.llm import mixing as M
from candlewick.llm.words import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, block string"


def count(text):
    return len(re.findall(WORD, text or ""))


def test_targets_share_the_whole_and_stop_at_the_cap():
    t = M.targets([100, 10, 0, 1000], [1.0, 2.0, 3.0, 1.0])
    assert t[1] == 30 and t[2] == 0 and sum(t) == pytest.approx(1110)
    assert t[0] == 300 and t[3] == pytest.approx(780)
    assert M.targets([5], [2.0]) == [5.0] and M.targets([0, 0], [1.0, 2.0]) == [0.0, 0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    p = M.permute(np.arange(n), n, 99)
    assert sorted(p) == list(range(n))
    assert (M.permute(p, n, 99, inverse=True) == np.arange(n)).all()


def test_shards_draw_exactly_the_quotas_and_blocks_in_order():
    words, aim = [1000, 333, 7, 0], [500.0, 999.0, 21.0, 0.0]
    p = M.plan(words, aim, 10, 16, 3)
    shards = [M.shard_slots(p, k) for k in range(p.shards)]
    assert all(len(s) == 16 for s in shards[:-1])
    taken = {s: sum(int(x.loc[x.source_no == s, "take"].sum()) for x in shards) for s in range(4)}
    assert taken == {0: 500, 1: 999, 2: 21, 3: 0}
    uses = {}
    for x in shards:
        for s, b in zip(x.source_no, x.block):
            uses[s, b] = uses.get((s, b), 0) + 1
    assert max(uses.values()) <= 3


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else [None, "a", "é", "z"][i % 4]
        text = " ".join(f"w{i}_{j}" for j in range(int(rng.integers(0, 60))))
        rows.append((i, text, "en", source, len(text), "x", "y"))
    rows += [(7, rows[7][1], "en", rows[7][3], 1, "x", "y"), (1000, None, None, None, None, None, None), (None, "null id words", "en", "a", 3, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_report_keeps_every_row_and_meets_targets(docs):
    rows = M.report(docs, block_words=8, shard_slots_=16).collect()
    assert rows and len(rows) == docs.count()
    texts = docs.collect()
    assert sorted(r["size"] for r in rows) == sorted(count(t["text"]) for t in texts)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    held, aim = {}, {}
    for t in texts:
        held[t["source"]] = held.get(t["source"], 0) + count(t["text"])
    order = sorted(held, key=lambda s: (s is None, s or ""))
    aim = dict(zip(order, M.targets([held[s] for s in order], [float(i % 3 + 1) for i in range(len(order))])))
    where = {(r["doc_id"], count(r["text"])): r["source"] for r in texts}
    taken = {}
    for r in rows:
        s = where[r["doc_id"], r["size"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["source_size"] == held[s] and r["target"] == pytest.approx(aim[s])
    assert all(abs(taken[s] - aim[s]) <= 1 for s in order)
    again = M.report(docs.repartition(5), block_words=8, shard_slots_=16).collect()
    assert sorted(map(tuple, map(lambda r: (str(r["doc_id"]), r["size"], r["taken"]), rows))) == sorted(
        map(lambda r: (str(r["doc_id"]), r["size"], r["taken"]), again))


def test_blocks_hold_what_the_report_counts(docs):
    taken = {}
    for r in M.report(docs, block_words=8, shard_slots_=16).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = M.blocks_of(docs, block_words=8, shard_slots_=16)
    assert out.columns == docs.columns
    got = {}
    full = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        assert r["text"] in full[r["doc_id"]] and r["n_chars"] == len(r["text"]) and count(r["text"]) <= 8
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + count(r["text"])
    assert got == {k: v for k, v in taken.items() if v}


def test_rows_without_an_id_are_taken_like_others(spark):
    rng = np.random.default_rng(11)
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{i}_{j}" for j in range(int(rng.integers(40, 200)))), "en", "ab"[i % 2], 1, "x", "y")
            for i in range(90)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = M.report(docs, block_words=8, shard_slots_=16).collect()
    assert len(got) == len(rows)
    whole = sum(r["taken"] for r in got)
    assert abs(whole - sum({r["source_size"]: r["target"] for r in got}.values())) <= 2
    nulls = sum(r["taken"] for r in got if r["doc_id"] is None)
    assert nulls > whole / 5
    out = M.blocks_of(docs, block_words=8, shard_slots_=16).collect()
    assert sum(count(r["text"]) for r in out) == whole
    assert sum(count(r["text"]) for r in out if r["doc_id"] is None) == nulls
    texts = {r[1].split()[0]: r for r in rows}
    owner = {w: r for r in texts.values() for w in r[1].split()}
    for r in out:
        own = owner[r["text"].split()[0]]
        assert r["text"] in own[1] and (r["doc_id"], r["source"]) == (own[0], own[3])


def test_packing_of_many_rows_without_an_id_has_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_ROWS", 10)
    docs = spark.createDataFrame([(None, f"u{i} v w", "en", "a", 1, "x", "y") for i in range(200)] + [(None, "same words", "en", "a", 1, "x", "y")] * 100, SCHEMA)
    m = M.mix(docs, block_words=8, shard_slots_=16)
    rows = sorted((r["_first"], r["size"]) for r in m.rows.collect())
    assert [a for a, _ in rows] == [sum(s for _, s in rows[:i]) for i in range(len(rows))]
    assert sum(r["taken"] for r in M.report(docs, block_words=8, shard_slots_=16).collect()) == 800


def test_a_null_text_and_a_null_source_are_told_apart(spark):
    docs = spark.createDataFrame([(7, None, "en", "x y z", 1, "x", "y"), (7, "x y z", "en", None, 1, "x", "y")], SCHEMA)
    keys = M._keyed(docs).collect()
    assert len({r["_print"] for r in keys}) == 2
    out = M.report(docs, block_words=8, shard_slots_=16).collect()
    assert sorted((r["size"], r["taken"]) for r in out) == [(0, 0), (3, 3)]
    assert [(r["text"], r["source"]) for r in M.blocks_of(docs, block_words=8, shard_slots_=16).collect()] == [("x y z", None)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.report(empty).count() == 0 and M.blocks_of(empty).count() == 0
