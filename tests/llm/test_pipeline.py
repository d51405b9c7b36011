import re

import pytest

import corpus_pipeline as P
from candlewick.llm import compression_quality, jaccard_join, mixing, piece_sampling, secret_scan
from candlewick.llm.common import DOC_COLUMNS, table
from candlewick.llm.words import WORD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), {"documents": None}
    out["documents"] = docs
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_in_order_with_the_columns_of_documents(steps):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dups", "secrets", "mixture", "tokens"]
    for name, _ in P.STAGES[:-1]:
        assert steps[name].columns == DOC_COLUMNS


def test_decisions_take_effect(spark, steps):
    ids = {k: {r["doc_id"] for r in steps[k].collect()} for k in steps}
    model = compression_quality.train(steps["documents"], table(spark, SF, "labels"))
    scored = compression_quality.score(steps["documents"], model).collect()
    assert ids["quality"] == {r["doc_id"] for r in scored if r["score"] >= compression_quality.THRESHOLD}
    groups = jaccard_join.component_table(steps["quality"]).collect()
    assert ids["near_dups"] == {r["component_id"] for r in groups}
    before = {r["doc_id"]: r["text"] for r in steps["near_dups"].collect()}
    after = {r["doc_id"]: r for r in steps["secrets"].collect()}
    assert set(before) == set(after)
    for k, text in before.items():
        assert after[k]["text"] == secret_scan.masked(text, secret_scan.spans(text)[1])
    taken = sum(r["taken"] for r in mixing.report(steps["secrets"]).collect())
    words = [len(re.findall(WORD, r["text"])) for r in steps["mixture"].collect()]
    assert sum(words) == taken and max(words) <= mixing.BLOCK_WORDS
    tokens = steps["tokens"].collect()
    assert len(tokens) == len(words) and all(r["lossless"] and r["n_tokens"] == len(r["token_ids"]) for r in tokens)


def test_tokens_decode_to_the_blocks(spark, steps):
    back = sorted(r["text"] for r in piece_sampling.decode(steps["tokens"]).collect())
    assert back == sorted(r["text"] for r in steps["mixture"].collect())


def test_run_gives_the_last_stage(spark, steps):
    got, want = P.run(spark, SF), steps["tokens"]
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_near_dups_indexes_only_what_may_link(spark, monkeypatch):
    """More repeated shingles than a bitmap of 2**16 bits tells apart do not bring unrelated documents into the index."""
    monkeypatch.setattr(jaccard_join, "MAX_BITS", 16)
    indexed, stored = [], jaccard_join.stored

    def watched(df):
        out = stored(df)
        if "sig" in out.columns:
            indexed.append(out.select("node").distinct().count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    twice = [" ".join(f"t{g}w{j}" for j in range(500)) for g in range(300)]
    alone = [" ".join(f"a{g}w{j}" for j in range(120)) for g in range(400)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate([*twice, *twice, twice[0].replace("t0w7 ", "other "), *alone])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.near_dups(spark, docs, SF).collect()} == {*range(300), *range(601, 1001)}
    assert indexed and max(indexed) <= 320


def test_entry_module_lists_the_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n == "pipeline" or re.match(r"op\d+_", n)]
    assert len(names) == 14 and {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 14))
