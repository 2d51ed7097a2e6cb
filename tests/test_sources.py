import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mlscout.functions.text import html_escape, neutralise_formula, number_text, pseudonymise
from mlscout.sources import (
    audit_columns, audit_dimensions, audit_files, audit_target, check_schema, guard_trainable,
    read_stat_files, read_table, resolve_format, sanitize, sniff_delimiter, write_cleaned,
)


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_quoting_and_missing_tokens(spark, tmp_path):
    path = _write(tmp_path / "t.csv", 'x,y\n1,"a, b"\nNA,"say ""hi"""\n3,"two\nlines"\n4,\n')
    rows = read_table(spark, path).orderBy("x").collect()
    assert [r.x for r in rows] == [None, 1, 3, 4]
    assert [r.y for r in rows] == ['say "hi"', "a, b", "two\nlines", None]


def test_formats(spark, tmp_path):
    assert read_table(spark, _write(tmp_path / "t.tsv", "a\tb\n1\tx\n")).columns == ["a", "b"]
    for i, delimiter in enumerate(["\t", ",", ";", "|"]):
        path = _write(tmp_path / f"d{i}.txt", f"a{delimiter}b{delimiter}c\n1{delimiter}2{delimiter}3\n")
        assert sniff_delimiter(spark, path) == delimiter
        assert tuple(read_table(spark, path).first()) == (1, 2, 3)
    blank = _write(tmp_path / "w.txt", "a   b\n 1  x\n2.5   NA\n")
    df = read_table(spark, blank)
    assert dict(df.dtypes) == {"a": "double", "b": "string"}
    assert sorted(tuple(r) for r in df.collect()) == [(1.0, "x"), (2.5, None)]
    with pytest.raises(ValueError, match="empty"):
        sniff_delimiter(spark, _write(tmp_path / "e.txt", ""))


def test_format_dispatch():
    assert resolve_format("a.CSV") == "csv"
    assert resolve_format("a.csv", "b.txt") == "txt"
    for bad in ("a", "a.unknown"):
        with pytest.raises(ValueError):
            resolve_format(bad)


def test_stata_files(spark, tmp_path):
    for i in range(3):
        pd.DataFrame({"x": [1.0 + i, 2.0], "s": ["a", "b"]}).to_stata(tmp_path / f"f{i}.dta", write_index=False)
    df = read_stat_files(spark, str(tmp_path / "*.dta"))
    assert dict(df.dtypes) == {"x": "double", "s": "string"} and df.count() == 6


def test_file_audit(spark, tmp_path):
    _write(tmp_path / "ok.csv", "a,b\n")
    _write(tmp_path / "big.csv", "x" * 3000)
    _write(tmp_path / "bad.exe", "x")
    (tmp_path / "packed.csv").write_bytes(gzip.compress(b"a"))
    (tmp_path / "data.rds").write_bytes(gzip.compress(b"a"))
    (tmp_path / "zip.txt").write_bytes(b"PK\x03\x04")
    (tmp_path / "book.xlsx").write_bytes(b"PK\x03\x04")
    found = {r.path.split("/")[-1]: r.verdict for r in audit_files(spark, str(tmp_path), max_mb=0.002).collect()}
    assert found == {
        "ok.csv": "ok", "big.csv": "too_large", "bad.exe": "bad_format", "packed.csv": "compressed",
        "data.rds": "ok", "zip.txt": "archive", "book.xlsx": "ok",
    }


def test_name_audit(spark):
    def rules(*names):
        df = spark.range(1).select(*[F.lit(1).alias(n) for n in names])
        return [(r["column"], r.rule) for r in audit_columns(df).orderBy("position").collect()]

    assert rules("age", "income_2", "a" * 100) == []
    assert rules("1x", "a b", "a-b") == [("1x", "pattern"), ("a b", "pattern"), ("a-b", "pattern")]
    assert rules("next", "TRUE") == [("next", "reserved"), ("TRUE", "reserved")]
    assert rules("payload") == [("payload", "suspicious")]
    assert rules("a" * 101) == [("a" * 101, "length")]
    with pytest.raises(ValueError, match="suspicious"):
        audit_columns(spark.range(1).select(F.lit(1).alias("eval_x")), strict=True)


def test_target_audit(spark):
    df = spark.createDataFrame([(1, 2, 3)], "age int, income int, `my target` int")
    audit_target(df, "age")
    for bad, message in (
        (None, "single"), (["age", "income"], "single"), ("nope", "not found"), (5, "single|not found"),
        ("my target", "format"),
    ):
        with pytest.raises(ValueError, match=message):
            audit_target(df, bad)


def test_dimension_limits_are_strict(spark):
    df = spark.range(100).select("id", F.lit(1).alias("x"))

    def over(**limits):
        return {r["limit"] for r in audit_dimensions(df, **limits).collect() if r.exceeded}

    assert over(max_rows=100, max_cols=2, max_cells=200) == set()
    assert over(max_rows=99, max_cols=1, max_cells=199) == {"rows", "cols", "cells"}
    assert over() == set()


def test_schema_and_training_guards(spark):
    df = spark.range(20).select("id", F.lit(1).alias("y"))
    guard_trainable(df, "y")
    for bad, target in ((df, "z"), (df.select("y"), "y"), (df.limit(9), "y")):
        with pytest.raises(ValueError):
            guard_trainable(bad, target)
    status = {r["column"]: r.status for r in check_schema(df.schema, df.drop("id").withColumn("w", F.lit(1))).collect()}
    assert status == {"id": "missing", "y": "ok", "w": "extra"}
    with pytest.raises(ValueError, match="lacks"):
        check_schema(df.schema, df.drop("id"), "y", strict=True)


def test_sanitising_round_trip(spark, tmp_path):
    values = ["=1+1", "+x", "-x", "@x", "\tx", "\rx", "a=b", "", None, "plain"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "s string, n int")
    out = [r.s for r in sanitize(df).orderBy("n").collect()]
    assert out == ["'=1+1", "'+x", "'-x", "'@x", "'\tx", "'\rx", "a=b", "", None, "plain"]
    safe = df.filter("n in (0, 1, 9)")
    write_cleaned(safe, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"')
    assert sorted(r.s for r in back.collect()) == ["'+x", "'=1+1", "plain"]


def test_scalars(spark):
    df = spark.createDataFrame([("<a href=\"x\">&'</a>",), (None,), ("",)], "s string")
    escaped = [r[0] for r in df.select(html_escape(F.col("s"))).collect()]
    assert escaped == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;", "", ""]
    tokens = [r[0] for r in df.select(pseudonymise(F.col("s"))).collect()]
    assert tokens[1:] == ["unknown", "unknown"] and len(tokens[0]) == 8
    nums = spark.createDataFrame([(80.0,), (66.666,), (0.0,), (100.0,), (None,)], "x double")
    assert [r[0] for r in nums.select(number_text(F.col("x"), 1)).collect()] == ["80", "66.7", "0", "100", None]
    assert df.select(neutralise_formula(F.col("s"))).count() == 3


def test_blank_separated_rows_equal_to_the_header_stay(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\n1 2\na b\n3 4\n")
    rows = read_table(spark, str(tmp_path / "t.txt"), schema="a string, b string").collect()
    assert sorted((r.a, r.b) for r in rows) == [("1", "2"), ("3", "4"), ("a", "b")]
