import json
import os

import pytest
from pyspark.sql import functions as F

from sieveline.sources import commits, lexicon, readers


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


def test_delimited_reading_keeps_empty_and_nan(spark, tmp_path):
    path = write(f"{tmp_path}/a.csv", 'token,tag\nnan,O\n"a, ""b""\nc",\n,NULL\n')
    got = readers.read_delimited(spark, path, ["token", "tag"]).collect()
    assert [tuple(r) for r in got] == [("nan", "O"), ('a, "b"\nc', ""), ("", "NULL")]


def test_sniffing_and_raw_headers(spark, tmp_path):
    assert readers.sniff_delimiter(spark, write(f"{tmp_path}/x.tsv", "a,b\n")) == "\t"
    assert readers.sniff_delimiter(spark, write(f"{tmp_path}/x.csv", "a;b,c;d\n1;2;3\n")) == ";"
    path = write(f"{tmp_path}/raw.csv", 'text\tlabel\nhe said "hi\tbad\t\nfine\tok\n')
    for _ in range(2):  # with or without its header the file reads alike
        assert [tuple(r) for r in readers.read_raw(spark, path, ["text", "label"]).collect()] == [('he said "hi', "bad"), ("fine", "ok")]
        path = write(f"{tmp_path}/raw2.csv", 'he said "hi\tbad\t\nfine\tok\n')


def test_text_column_lines_and_discovery(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "longer text", "b")], "id int, k string, body string, Message string")
    assert readers.find_text_column(df) == "Message" and readers.find_text_column(df.drop("Message")) == "body"
    assert readers.find_text_column(df, ["K"]) == "k"
    with pytest.raises(ValueError):
        readers.find_text_column(df.select("id"))
    path = write(f"{tmp_path}/deep/er/l.txt", "one\n \t\n \ntwo\n")
    assert [r.text for r in readers.read_lines(spark, path).collect()] == ["one", "two"]
    write(f"{tmp_path}/deep/x.csv", "a\n")
    write(f"{tmp_path}/deep/y.json", "{}")
    found = [r.path for r in readers.discover(spark, f"{tmp_path}/deep").collect()]
    assert sorted(os.path.basename(p) for p in found) == ["l.txt", "x.csv"]
    assert readers.discover(spark, f"{tmp_path}/deep", found[:1]).count() == 1
    lines = spark.createDataFrame([(" a \r\n\r\n\tb\n",)], "t string").select(readers.split_lines(F.col("t")).alias("l")).first().l
    assert lines == ["a", "b"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ('say "x", y', None)], "text string, n int")
    for quoted in (False, True):
        readers.export_csv(df, f"file://{tmp_path}/out{quoted}.csv", quote_all=quoted)
    text = open(f"{tmp_path}/outFalse.csv", encoding="utf-8-sig").read()
    assert text == 'text,n\na,1\n"say ""x"", y",\n'
    raw = open(f"{tmp_path}/outTrue.csv", "rb").read()
    assert raw.startswith(b'\xef\xbb\xbf"text","n"\n"a","1"\n')
    for _ in range(2):
        commits.append_csv(df, f"{tmp_path}/log")
    assert commits.read_appended(spark, f"{tmp_path}/log").count() == 4
    assert readers.markdown(spark.createDataFrame([("a|b\nc", None)], "x string, y string")) == "| x | y |\n|---|---|\n| a\\|b c |  |"
    readers.write_vocabulary(spark, {"அ": 2, "b": 3}, f"{tmp_path}/vocabulary")
    assert readers.read_vocabulary(spark, f"{tmp_path}/vocabulary") == {"அ": 2, "b": 3}
    near = spark.createDataFrame([("q", True, "n", 0.51239), ("z", False, None, None)], "query string, in_vocab boolean, neighbor string, score double")
    readers.write_neighbours(near, f"{tmp_path}/near")
    rows = readers.read_delimited(spark, f"{tmp_path}/near", ["query", "in_vocab", "neighbor", "score"], sep="\t").collect()
    assert sorted(tuple(r) for r in rows) == [("q", "true", "n", "0.5124"), ("z", "false", "<no-vector>", "")]


def test_lexicon_file_round_trip(spark, tmp_path):
    entries = lexicon.from_rows(spark)
    lexicon.write_lexicon(entries, f"{tmp_path}/lex")
    back = lexicon.read_lexicon(spark, f"{tmp_path}/lex")
    key = lambda df: [(r.canon, list(r.variants), r.category, r.severity, r.script) for r in df.orderBy("ord").collect()]
    assert key(back) == key(entries)
    part = next(f for f in os.listdir(f"{tmp_path}/lex") if f.startswith("part"))
    meta = json.load(open(f"{tmp_path}/lex/{part}", encoding="utf-8"))["_meta"]
    assert meta["entries"] == len(lexicon.DEMO) and meta["by_severity"]["medium"] == sum(r[3] == "medium" for r in lexicon.DEMO)
    surfaces = lexicon.exact_surfaces(back).count() + lexicon.phrase_surfaces(back).count()
    assert surfaces == sum(1 + len(r[1]) for r in lexicon.DEMO)


def test_a_lexicon_of_rows_needs_no_python_workers(spark):
    rows = [("a", ("b", "c"), "x", "high"), ("d", (), None, "")]
    entries = lexicon.from_rows(spark, rows)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "RDD" not in plan
    assert [tuple(r) for r in entries.orderBy("ord").collect()] == [(0, "a", ["b", "c"], "x", "high", "LATIN", None), (1, "d", [], None, "", "LATIN", None)]
    assert lexicon.from_rows(spark, ()).count() == 0
