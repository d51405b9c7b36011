import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import compression_quality as C
from candlewick.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = C.quality_report(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert len(rows) > 50 and right > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_held_out_labels_are_not_learnt_from(spark):
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    import zlib

    used = {r["doc_id"] for r in C.training_labels(labels).collect()}
    assert used == {i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2}


@pytest.fixture(scope="module")
def small(spark):
    good, bad = "the river ran past the old mill and the quiet town ", "BUY!!! $$$ NOW!!! ### CHEAP!!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 7), "en", "score", i) for i in range(200)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (1, rows[1][1], "en", "score", 1), (None, good, None, None, None), (902, good * 4000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, quality long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(3, 1, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_frames_with_nulls_repeats_and_clashing_columns(small):
    docs, labels = small
    model = C.train(docs, labels)
    got = C.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] == by[901] and 0 <= by[900] <= 1
    assert np.mean([by[i] for i in range(1, 200, 2)]) > 0.8 > 0.2 > np.mean([by[i] for i in range(0, 200, 2)])
    kept = C.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["score"] >= C.THRESHOLD)


def test_one_class_or_no_labels_give_the_prior(small):
    docs, labels = small
    only = C.score(docs, C.train(docs, labels.where("quality = 1"))).collect()
    assert len({r["score"] for r in only}) == 1 and only[0]["score"] > 0.9
    none = C.score(docs, C.train(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert C.quality_report(docs.limit(0), labels).count() == 0
