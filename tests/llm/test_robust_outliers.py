import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import robust_outliers as R
from candlewick.llm.words import WORD, utf8

SCHEMA = "doc_id long, text string, lang string, source string, kept string, unit string, x0 string"


def plain(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many, cover = Counter(grams), [0] * len(w)
    for i, g in enumerate(grams):
        if many[g] > 1:
            cover[i:i + 5] = [1] * 5
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(cover))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab é\n|#漢😀")), max_size=60)), max_size=6))
def test_statistics_match_the_definitions(texts):
    found = R.text_statistics(*utf8(pa.array(texts, pa.string())))
    got = list(zip(*(found[c].tolist() for c in R.COUNTS[:5])))
    assert got == [plain(t) for t in texts]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "rho", "of", "the", "and", "to", "in", "omega", "sigma"]
    out = []
    for i in range(400):
        n = int(rng.integers(15, 400))
        text = " ".join(str(w) + str(rng.choice(["", "", "", "s", "ing", "."])) + ("" if rng.random() < .9 else chr(97 + int(rng.integers(26)))) for w in rng.choice(words, n))
        out.append((i, text.capitalize(), ["en", None][i % 2], "hot" if i % 3 else None))
    for i in range(400, 420):
        out.append((i, " ".join(f"{rng.choice(words)}{rng.integers(10**6)}###" for _ in range(80)), "en", "hot"))
    return out


def test_clean_documents_stay_and_odd_ones_go(spark, rows):
    docs = spark.createDataFrame([(*r, "c", "u", "x") for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in R.verdicts(docs).collect()}
    clean = [r for k, r in got.items() if k < 400 and not r["base_failed"]]
    assert np.mean([r["kept"] for r in clean]) > 0.99
    assert not any(got[i]["kept"] for i in range(400, 420))
    for k, text, *_ in rows:
        n, chars, symbols, dup, repeat = plain(text)
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_symbols"], got[k]["n_dup_lines"], got[k]["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert got[k]["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
    again = {r["doc_id"]: r["distance"] for r in R.verdicts(docs.repartition(7)).collect()}
    assert again == {k: r["distance"] for k, r in got.items()}  # sums are exact


def test_small_tables_and_nulls(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "a b c d e f g h i j k", "en", "s"), (3, "a b c d e f g h i j k", "en", "s"), (None, "x " * 50_000, None, "s")]
    got = R.verdicts(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in got) == [
        ("1", 0, True, False), ("2", 0, True, False), ("3", 11, False, True), ("3", 11, False, True), ("None", 50_000, True, False)]
    assert R.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_concentration_ignores_a_third_of_outliers(spark):
    """The estimate equals the clean part's, not the mixture's."""
    rng = np.random.default_rng(8)
    clean = rng.normal(0, 0.2, (300, 6))
    bad = rng.normal(0, 0.2, (60, 6)) + 5
    rows = [("u", *map(int, np.round(v * R.SCALE))) for v in np.vstack([clean, bad])]
    found = R.estimates(spark.createDataFrame(rows, "unit string, " + ", ".join(f"{d} long" for d in R.DIMS))).collect()[0]
    assert np.abs(np.array(found["centre"])).max() < 0.1
