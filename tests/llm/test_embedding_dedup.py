import math

import numpy as np
import pytest

from candlewick.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep string"


def brute(rows):
    ok = [e is not None and lab is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e, lab in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                x, y = (np.array(v, np.float32).astype(float) for v in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    name = {}
    for i, r in enumerate(rows):
        name[find(i)] = min(name.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], name[find(i)], r[0] == name[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("part", [1024, 7])
def test_matches_brute_force(spark, part):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            noise = rng.standard_normal(16) * rng.choice([0, 0.05, 0.15, 0.25])
            rows.append(((len(rows) * 13) % 997, [float(x) for x in np.float32((base + noise) * rng.uniform(0.5, 3))], int(g % 3)))
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1),
             (2004, rows[0][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [float("inf")] * 16, 1), (2008, [2.0, 4.0], 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted(map(tuple, E.near_duplicates(docs, part=part).collect())) == brute(rows)


def test_hot_group_of_copies_and_repeated_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(50)] + [(3, [1.0, 2.0, 3.0], 1), (60, [1.0, 2.0, 3.01], 1)]
    got = E.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert len(got) == 52 and {r["n_links"] for r in got} == {51} and {r["component_id"] for r in got} == {0}


def test_tables_follow_the_wanted_recall():
    bits, tables = E.sizes(50_000, 0.98, 0.9999)
    meet = (1 - math.acos(0.98) / math.pi) ** bits
    assert 1 - (1 - meet) ** tables >= 0.9999


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0001e200, 1e200]), (3, [1e200, -1e200]), (4, [1e-200, 1.0001e-200]), (5, [1e308, 1.7e308])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(docs).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1), 5: (0, 5)}


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
