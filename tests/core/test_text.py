import html
import random
import re
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import redact


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "given", "want"),
    [
        (T.normalize, None, ""),
        (T.collapse_repeats, "sooooo nice!!!!!", "soo nice!!"),
        (T.unescape_html, "Love &lt;3 &amp; x", "Love <3 & x"),
        (T.nfc, "éa", "éa"),
        (T.strip_mentions, "see @bob x@y.com", "see  x@y.com"),
        (T.strip_urls, "a HTTP://x.y/z b www.q c", "a  b  c"),
        (T.destuff, "l*o*o*s*u", "loosu"),
        (T.destuff, "l o o s u", "loosu"),
        (T.leet, "m0vie b4d", "movie bad"),
        (T.leet, "2024", "2024"),
        (T.leet, "1000", "iooo"),
        (T.leet, "nice! !!", "nicei ii"),
        (T.mask_partial, "no", "**"),
        (T.mask_partial, "bad", "b*d"),
        (T.mask_partial, "loser", "l***r"),
        (T.mask_partial, "pathetic", "pa****ic"),
        (T.mask_block, "scum", "████"),
        (T.dedup_key, "Thalaaaaa!!", "thalaa"),
    ],
)
def test_golden_rows(spark, column, given, want):
    assert one(spark, column, given) == want


def test_tokens_and_graphemes(spark):
    got = one(spark, T.tag_tokens, "தமிழ்123 nice!!")
    assert [(r.text, r.script) for r in got] == [("தமிழ்", "TAMIL"), ("123", "DIGIT"), ("nice", "LATIN"), ("!!", "SYMBOL")]
    assert len(one(spark, T.graphemes, "தேவிடியா")) == 4


def test_random_texts_against_plain_rules(spark):
    rng = random.Random(1)
    pool = list("aab  \n\t!é*0") + ["க", "ி", "́", "&amp;", "@x", "…"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.clean(F.col("t")).alias("c"), T.collapse_repeats(F.col("t")).alias("r"), F.array_join(T.pieces(F.col("t")), "").alias("p"), T.graphemes(F.col("t")).alias("g")).collect()
    for r in rows:
        assert r.c == unicodedata.normalize("NFC", html.unescape(r.t))
        assert r.r == re.sub(r"(.)\1{2,}", r"\1\1", r.t)
        assert r.p == r.t and "".join(r.g) == r.t


def test_tags_and_polite(spark):
    tag = lambda a, b: T.mask_tag(a, b)
    assert [one(spark, tag, *x) for x in (("threat", ""), ("", "high"), ("", " "))] == ["[REDACTED: THREAT]", "[REDACTED: HIGH]", "[REDACTED: ABUSE]"]
    polite = lambda a, b: T.polite(a, b, redact.POLITE, "?")
    assert [one(spark, polite, *x) for x in (("IDIOT", ""), ("x", "loser"), ("idiotic", ""), ("x", None))] == ["thoughtless person", "person", "thoughtless person", "?"]


def test_runs_of_ascii_change_no_token(spark):
    rng = random.Random(3)
    signs = "aZé0٣9 \t\n\x1c\x1f\x7f_-.!{~\x85\xa0αжமதி்́ªßﬁ中𝐀😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for spaces in (False, True):
        plain = r"(?U)\p{IsTamil}+|\p{IsLatin}+|\p{Nd}+|\p{L}+|" + (r"\s+|" if spaces else "") + r"[^\s\p{L}\p{Nd}]+"
        made = df.select(T.token_texts(F.col("t"), spaces).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b"))
        assert made.where("a != b").count() == 0


def test_texts_are_cleaned_a_few_at_a_time():
    """A batch of long texts is not held as Python objects, and rows that need nothing are not looked at."""
    texts = pa.array(["é中" * 3_000 + str(i) for i in range(1_000)] + [None])
    yes = pa.array([True] * len(texts))
    tracemalloc.start()
    found = T._clean.func(texts, yes, yes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == ["é中" * 3_000 + str(i) for i in range(1_000)] + [None]
    assert peak < 6_000_000  # all as Python objects: 12 MB
    assert T._clean.func(pa.nulls(3, pa.string()), yes[:3], yes[:3]).to_pylist() == [None] * 3
    assert T._clean.func(pa.array([], pa.string()), yes[:0], yes[:0]).to_pylist() == []
