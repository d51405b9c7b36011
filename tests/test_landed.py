"""Landed CSV files whose headers differ from file to file."""

import datetime as dt

from candlewick.sources.wide import header_index, read_wide


def land(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_every_file_is_read_under_its_own_header(spark, tmp_path):
    land(tmp_path, "a.csv", "Symbol,Date,Open,High,Low,Close,Volume\nA,2024-01-02,1,2,3,4,5\nA,2024-01-03,1,2,3,,5\n")
    land(tmp_path, "b.csv", "Volume,Adj Close,Date,Low,High,Open,Symbol\n50,40,2024-01-02,30,20,10,B\n")
    land(tmp_path, "c.csv", "Symbol,Date,Close,Close,Adj Close,Open,High,Low,Volume\nC,2024-01-02,7,8,9,1,2,3,4\n")
    land(tmp_path, "d.csv", '﻿"Symbol","Date",Open,High,Low,Close\n"D, Inc",2024-01-02,1,x,3,4\n')
    land(tmp_path, "e.csv", "Symbol,Date,Open,High,Low,Close,Volume\n")
    (tmp_path / "sub").mkdir()
    land(tmp_path / "sub", "f.csv", "\nDate,Symbol,Other,Volume,Open,High,Low,Close,Adj Close\n2024-01-02,F,zz,9,1,2,3,,6\n2024-01-03,F,zz,9,1\n")
    got = [tuple(r) for r in read_wide(spark, str(tmp_path)).select("symbol", "dt", "open", "high", "low", "close", "volume").collect()]
    d, next_day = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    want = {("A", d, 1.0, 2.0, 3.0, 4.0, 5.0), ("A", next_day, 1.0, 2.0, 3.0, None, 5.0), ("B", d, 10.0, 20.0, 30.0, 40.0, 50.0),
            ("C", d, 1.0, 2.0, 3.0, 7.0, 4.0), ("D, Inc", d, 1.0, None, 3.0, 4.0, None), ("F", d, 1.0, 2.0, 3.0, None, 9.0),
            ("F", next_day, 1.0, None, None, None, 9.0)}
    assert len(got) == len(want) and set(got) == want


def test_a_file_in_several_splits_has_one_header(spark, tmp_path):
    rows = "".join(f"A,2020-01-01,{i},2,3,4,5\n" for i in range(4000))
    land(tmp_path, "a.csv", "Symbol,Date,Open,High,Low,Close,Volume\n" + rows)
    land(tmp_path, "b.csv", "Symbol,Date,Low,High,Open,Close,Volume\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert header_index(spark, str(tmp_path)).count() == 2
        bars = read_wide(spark, str(tmp_path))
        assert bars.count() == 8000 and bars.groupBy().sum("open", "low").first()[:] == (7998000.0 + 12000.0, 7998000.0 + 12000.0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
