import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import corpus, spans
from sieveline.plans import api
from sieveline.sources import lexicon, readers


def one(spark, column, schema, *values):
    return spark.createDataFrame([tuple(values)], schema).select(column.alias("x")).first().x


def test_intervals_and_highlights(spark):
    df = spark.createDataFrame([(1, "Bad and BAD badly"), (2, "fine")], "k int, text string")
    found = spans.match_intervals(df, "k", "text", ["bad", "badly"])
    merged = sorted((r.k, r.start, r.end) for r in spans.merged_intervals(found, "k").collect())
    assert merged == [(1, 0, 3), (1, 8, 11), (1, 12, 17)]
    both = spark.createDataFrame([("Bad and BAD badly", [(0, 3), (8, 11), (12, 17)]), ("fine", [])], "t string, i array<struct<start:int,end:int>>")
    parts = [[(p.text, p.hit) for p in r.x] for r in both.select(spans.highlighted(F.col("t"), F.col("i")).alias("x")).collect()]
    assert parts == [[("Bad", True), (" and ", False), ("BAD", True), (" ", False), ("badly", True)], [("fine", False)]]


def test_small_text_functions(spark):
    assert one(spark, T.char_ids(F.col("w"), {"a": 2, "b": 3}, most=3), "w string", "abzb") == [2, 3, 1]
    assert one(spark, T.char_ids(F.col("w"), {"a": 2}), "w string", "") == [0]
    assert one(spark, T.remove_words(F.col("t"), ["a.b", "x\\Ey"]), "t string", "1 A.B 2 acb X\\EY 3") == "1  2 acb  3"
    assert one(spark, T.remove_words(F.col("t"), ["bad"], "█"), "t string", "so BAD") == "so ███"
    assert one(spark, T.embedding_tokens(F.col("t")), "t string", "Ab, அ1 я!") == ["ab", "அ", "1"]
    assert one(spark, T.strip(F.col("t")), "t string", " \t x y\r\n") == "x y"


def test_pools(spark):
    df = spark.createDataFrame([(" a ", " x\t"), (None, "x"), ("\t", "x"), ("b", None)], "text string, label string")
    assert [tuple(r) for r in corpus.usable(df).collect()] == [("a", "x")]
    tags = spark.createDataFrame([("\t", "O "), ("B-ABUSE ", "O"), (None, "O")], "c string, w string")
    assert [r.x for r in tags.select(corpus.final_tag(F.col("c"), F.col("w")).alias("x")).collect()] == ["O", "B-ABUSE", "O"]


def test_verdict_files_and_health(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'an idiot, a "loser"'), (2, "fine")], "doc_id long, text string")
    moderator = api.Moderator.load(spark)
    found = moderator.transform(rows)
    api.verdict_csv(found, f"{tmp_path}/verdicts")
    back = readers.read_delimited(spark, f"{tmp_path}/verdicts", ["text", "verdict", "words", "categories"])
    assert sorted(tuple(r) for r in back.collect()) == [('an idiot, a "loser"', "UNSAFE", "idiot; loser", "profanity; threat"), ("fine", "SAFE", "", "")]
    censored = json.loads(api.censored_json(moderator.censor(rows)).first().value)
    assert censored["censored"] == 'an i***t, a "l***r"' and censored["redacted_count"] == 2 and censored["redacted_spans"][0]["mode"] == "partial"
    health = api.health(spark, lexicon.from_rows(spark)).first()
    assert health.status == "ok" and health.entries == len(lexicon.DEMO)
    api.register(spark)
    assert spark.sql("SELECT tokenise_text('a1, b') AS t").first().t == ["a", "1", ",", "b"]
    with pytest.raises(ValueError):
        moderator.transform(rows, text="nothing")


def test_command_line(spark, capsys, tmp_path):
    path = tmp_path / "texts"
    path.write_text("you idiot\n \nfine\n")
    assert api.main(["--file", str(path), "--compact", "--censor", "--censor-mode", "block"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["censored"] for x in lines] == ["you █████", "fine"]
