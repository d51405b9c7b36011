import pytest

from candlewick.llm import license_scan as L

SCHEMA = "doc_id long, text string, lang string, family string, words string"
PLAIN = ["the quick brown fox jumps over the lazy dog and runs to the river", "a tale of two cities in which the work is long",
         "software people in the office use the same source of coffee", "rain and wind at sea with a chance of sun", "all the days of the year"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "\n".join(PLAIN[(i + j) % len(PLAIN)] + f" n{i}" for j in range(4)), "en", "f", "w") for i in range(150)]
    return L.train(spark.createDataFrame(rows, SCHEMA))


def found(spark, model, texts):
    docs = spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    return {(r["doc_id"], r["paragraph"]): r for r in L.classify(docs, model).collect()}


def test_notices_are_found_and_named(spark, model):
    texts = ["Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", "Released under the MIT License.", "All rights reserved.",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "© 2021 Jane. RELEASED UNDER THE MIT LICENSE. Thanks to all."]
    got = found(spark, model, texts)
    want = {(0, 1): "apache", (1, 0): "mit", (2, 0): "proprietary", (3, 0): "gpl", (4, 0): "cc-by-nc", (5, 0): "mit"}
    assert {k: r["family"] for k, r in got.items()} == want
    assert all(r["confirmed"] for r in got.values())


def test_held_out_notices(spark, model):
    """Forms that were not trained on: a word inserted in the middle."""
    texts, want = [], []
    for family, notices in L.TEMPLATES.items():
        for t in notices:
            w = t.split()
            if len(w) > 5:
                texts.append(" ".join([*w[:len(w) // 2], "indeed", *w[len(w) // 2:]]))
                want.append(family)
    got = found(spark, model, texts)
    right = sum(got[(i, 0)]["guess"] == f for i, f in enumerate(want) if (i, 0) in got)
    assert right >= 0.9 * len(want)


def test_plain_text_nulls_and_long_lines(spark, model):
    assert found(spark, model, [None, "", "\n\n", *PLAIN, "river fox " * 30_000]) == {}
    doubled = found(spark, model, ["x " * 20_000 + "Released under the MIT License.", "Released under the MIT License."])
    assert (1, 0) in doubled


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_has_no_python(spark, model):
    plan = L.classify(spark.createDataFrame([(1, "a", "b", "c", "d")], SCHEMA), model)._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def test_long_lines_are_learnt_whole(spark, monkeypatch):
    fitted, make = [], type(spark).createDataFrame

    def seen(self, data, schema=None, *more, **options):
        if isinstance(schema, str) and "grams" in schema:
            fitted.extend(data)
        return make(self, data, schema, *more, **options)

    monkeypatch.setattr(type(spark), "createDataFrame", seen)
    late = "apache permission"  # two words of the templates, after 600 others
    rows = [(i, PLAIN[i % len(PLAIN)]) for i in range(600)] + [(700, " ".join(f"plain{i}" for i in range(600)) + f" {late} end")]
    L.train(make(spark, rows, "doc_id long, text string"))
    assert any(set(late.split()) <= set(grams) for label, _, grams in fitted if label == 0)
    assert max(len(grams) for label, _, grams in fitted if label == 0) < 100  # only grams that templates hold are sent


# notices of licences that no template has
UNSEEN = ["Licensed under the Eclipse Public License, version 2.0.", "Licensed under the European Union Public Licence, version 1.2.",
          "This program is released under the Artistic License, version 2.0.", "Licensed under the Academic Free License version 3.0"]


def test_unseen_licences_are_unknown(spark, model):
    got = found(spark, model, UNSEEN)
    assert (0, 0) in got and all(r["family"] == "unknown" and not r["confirmed"] for r in got.values())


def test_calibration_holds_out_whole_notices_and_families(model):
    """The threshold comes from rows that no fold's model saw, and is not clamped."""
    assert 0 < model.believed < 1
    assert 0 < model.known_kept < 1 and model.unknown_found >= 0.8
    assert {"mozilla", "the mozilla"} <= set(model.own["mpl"]) and "public license" not in {g for own in model.own.values() for g in own}


def test_left_out_family_is_unknown(spark, monkeypatch):
    """A family that training does not know at all, in its own notices."""
    notices = L.TEMPLATES["mpl"]
    monkeypatch.setattr(L, "TEMPLATES", {f: t for f, t in L.TEMPLATES.items() if f != "mpl"})
    monkeypatch.setattr(L, "FAMILIES", [L.NONE, *L.TEMPLATES])
    rows = [(i, PLAIN[i % len(PLAIN)] + f" n{i}") for i in range(300)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found(spark, model, notices)
    assert not any(r["confirmed"] for r in got.values())


def test_no_telling_word(spark):
    """Where every word of the templates is an ordinary one, no paragraph is a licence."""
    words = sorted({w for texts in L.TEMPLATES.values() for t in texts for w in L._words(t)})
    docs = spark.createDataFrame([(i, "\n".join(words), "en", "f", "w") for i in range(20)], SCHEMA)
    out = L.scan(docs)
    assert out.count() == 0 and {"doc_id", "family", "confirmed"} <= set(out.columns)
