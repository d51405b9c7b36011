import hashlib

import pytest

from candlewick.llm import warc_fixity as X

SCHEMA = "file string, offset long, record_id long, payload binary, digest string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "n") for r in rows], SCHEMA)


def records(files=4, n=120):
    rows = []
    for f in range(files):
        at = 0
        for i in range(n):
            body = bytes([(f * 31 + i * 7 + k) % 251 for k in range(20 + i % 40)])
            rows.append((f"f{f}", at, f * 1000 + i, body))
            at += len(body)
    return rows


def plain(a, b):
    """Record by record comparison, repeated rows numbered."""
    def keyed(rows):
        out = {}
        for r in sorted(rows, key=lambda r: str(r)):
            k = (r[0], -1 if r[1] is None else r[1], r[2])
            out.setdefault(k, []).append(r[3])
        return {(*k, i): v for k, vs in out.items() for i, v in enumerate(vs)}
    x, y = keyed(a), keyed(b)
    out = []
    for k in {*x, *y}:
        if k not in y:
            out.append((k[0], k[1], k[2], "missing"))
        elif k not in x:
            out.append((k[0], k[1], k[2], "extra"))
        elif x[k] != y[k]:
            out.append((k[0], k[1], k[2], "changed"))
    return sorted(out, key=str)


def audited(spark, a, b, **options):
    out = X.audit(frame(spark, a), frame(spark, b), **options)
    return sorted(((r["file"], r["offset"], r["record_id"], r["status"]) for r in out.collect()), key=str)


def test_damage_is_located(spark):
    a = records()
    b = list(a)
    b[5] = (*b[5][:3], b"changed")
    b[200] = (*b[200][:3], None)
    del b[300]
    b.append(("f9", 0, 1, b"new file"))
    b.append(("f1", 10**6, 77, b"behind the end"))
    got = audited(spark, a, b, leaf_bytes=256, fanout=4)
    assert got == plain(a, b) and len(got) == 5
    assert audited(spark, a, a, leaf_bytes=256, fanout=4) == []


def test_nulls_repeats_and_empty_tables(spark):
    a = [(None, 0, 1, b"x"), (None, None, 2, None), ("f", 0, 3, b"y"), ("f", 0, 3, b"y"), ("f", 5, None, b"")]
    b = [(None, 0, 1, b"x"), (None, None, 2, b""), ("f", 0, 3, b"y"), ("f", 5, None, b"")]
    got = audited(spark, a, b)
    assert got == sorted([(None, -1, 2, "changed"), ("f", 0, 3, "missing")], key=str)
    assert len(audited(spark, a, [])) == len(a) and audited(spark, [], []) == []


def test_records_without_offset_are_spread_and_equal_rows_counted(spark, monkeypatch):
    monkeypatch.setattr(X, "SPREAD", 8)
    a = [("f", None, i, bytes([i])) for i in range(100)] + [("f", 3, 7, b"same")] * 50 + [("g", 0, i, b"z") for i in range(5)]
    b = [r for r in a if r != ("f", None, 40, bytes([40]))]
    b[10] = ("f", None, 10, b"other")
    b.remove(("f", 3, 7, b"same"))
    b.append(("f", None, 500, b"new"))
    assert audited(spark, a, b, fanout=4) == plain(a, b) and len(plain(a, b)) == 4
    assert audited(spark, a, a, fanout=4) == []
    hashed = X.record_hashes(frame(spark, a), spread=13)
    sizes = {r["leaf"]: r["count"] for r in hashed.where("file = 'f' and offset < 0").groupBy("leaf").count().collect()}
    assert min(sizes) >= -13 and len(sizes) > 8 and max(sizes.values()) < 25


def test_a_node_is_the_hash_of_its_children_in_order(spark):
    rows = records(1, 6)
    hashed = X.record_hashes(frame(spark, rows), 1 << 20)
    digests = [r["digest"] for r in hashed.orderBy("offset").collect()]
    assert X.leaves(hashed).collect()[0]["digest"] == hashlib.sha256(",".join(digests).encode()).hexdigest()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_page_replicas_match_the_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(X.ORACLE)
    names = [d[0] for d in want.description]
    out = X.audit(*X.page_records(spark, sf)).select(*names)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)
