import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators.tagging import moderate
from sieveline.plans import sql
from sieveline.sources import lexicon

TEXTS = [
    None, "", "   ", "You IDIOT, and of the Idiots!", "caf&eacute; scum &amp; www.x.y/z @name", "it's a back\\slash q'uote", "of the and of the", "முட்டாளா முட்டாள்",
    "İ sooooo stupid " * 40, "idiotsai o'brien", "ﬁ é it's", "it's", "clown",
]


def test_functions_equal_the_columns(spark):
    rows = [("idiot", ("idiots",), "profanity", "high"), ("of the", ("it's a",), "threat", "medium"), ("முட்டாள்", (), "profanity", "high"), ("clown", (), "misogyny", "low"), ("scum", ("brien",), 'a "b\' \\ c', "medium")]
    entries = lexicon.from_rows(spark, rows)
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(TEXTS + TEXTS[3:5])], "id long, text string, safe string")
    sql.register(spark, entries)
    made = spark.sql("SELECT id, m.* FROM (SELECT id, moderate(text) AS v FROM {docs}) LATERAL VIEW explode(array(v)) AS m", docs=docs)
    want = moderate(docs, entries, "id").select(*made.columns)
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    assert made.where("NOT safe").count() >= 6
    both = spark.sql("SELECT id, normalize_text(text) AS n, tokenize(text) AS t FROM {docs}", docs=docs).collect()
    have = docs.select("id", T.normalize(F.col("text")).alias("n"), T.tag_tokens(F.col("text")).alias("t")).collect()
    assert sorted(map(str, both)) == sorted(map(str, have))
    assert spark.sql("SELECT moderate(text) AS m FROM {docs}", docs=docs.limit(0)).collect() == []


def test_only_what_stands_like_a_function_is_quoted(spark):
    text = sql.text_of((F.col("a") + 1 > 2) & F.col("b").isin("or(", "it's -(") & ~F.col("c"))
    assert "'or('" in text and "-(" in text and "`or`" not in text and "`and`(" in text and "`+`(" in text
    df = spark.createDataFrame([(2, "it's -(", False), (2, "or(", True)], "a int, b string, c boolean")
    assert [r[0] for r in df.select(F.expr(text)).collect()] == [True, False]


def test_a_lexicon_too_large_for_an_expression_is_refused(spark):
    many = spark.range(9000).select(F.col("id").alias("ord"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("canon"), F.array().cast("array<string>").alias("variants"), F.lit("x").alias("category"), F.lit("high").alias("severity"))
    with pytest.raises(ValueError, match="too large"):
        sql.verdict(F.col("text"), many)
