"""The engine's functions for SQL: temporary functions of the session, whose bodies are expressions that Spark inlines.

``register`` makes ``normalize_text(text)``, ``tokenize(text)`` and ``moderate(text)``.  A body is the SQL text of the same column
that the DataFrame functions build, so that a query in SQL has the same plan: no function hides its work from the optimizer, and
only texts with an entity or letters beyond Latin-1 travel to Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import tagging
from sieveline.operators.matching import enumerable_matches, phrase_rows, phrase_starts

CLEAN = "sieveline_clean"
TOKENS = "array<struct<text:string,script:string>>"
FLAGGED = "array<struct<token:string,source:string,canon:string,category:string,severity:string,match_type:string>>"
VERDICT = f"struct<clean:string,safe:boolean,flagged_words:array<string>,categories:array<string>,flagged_spans:{FLAGGED}>"


#: A literal, which stays as it is, or an operator that a column's text writes like a function, under no quotes.
_CALLS = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(<=>|<=|>=|[-+*/%=<>!]|or|and|in|not)(?=\()", re.S)


def text_of(body: Column) -> str:
    """A column as SQL: its own text, operators that stand where functions do being quoted names of functions."""
    return _CALLS.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], body._jc.toString())


def create(spark: SparkSession, name: str, body: Column, returns: str) -> None:
    """A temporary function of ``text`` whose body is a column of the same name."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {returns} RETURN CAST({text_of(body)} AS {returns})")


def normalized(text: Column) -> Column:
    """``normalize`` with its Python step under the name that SQL knows."""
    cleaned = T.clean(F.coalesce(text, F.lit("")), by=lambda *c: F.call_function(CLEAN, *c))
    return T.normalize(cleaned, T.NormalizeOptions(nfc=False, decode_html=False))


def _bound(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def verdict(clean: Column, entries: DataFrame) -> Column:
    """What ``moderate`` says in the standard sensitivity of a text that is normalised, as one struct.

    The lexicon becomes a literal; one that is too large for it is an error, since a join is then needed: use ``moderate`` of the
    DataFrame API.
    """
    found, known = enumerable_matches(entries), phrase_rows(entries)
    if found is None:
        raise ValueError("the lexicon is too large for an expression; moderate the table by the DataFrame function")
    fields = ("canon", "category", "severity", "match_type")
    allowed = tagging.GATES["serving"]
    table = tagging.WordTable({w: m for w, m in found.items() if (m["severity"] or "") in allowed})
    phrases = tagging.WordTable({r.surface: {f: r[f] for f in fields[:3]} for r in known})
    tamil = any(w > "஀" for w in table.words)
    made = F.array().cast(f"array<{tagging.SPAN}>")

    def spans_of(x: Column) -> Column:
        single = tagging.single_spans(x["tokens"], x["starts"] if known else None, table, tamil).cast(f"array<{tagging.SPAN}>")
        return _bound(single, lambda s: tagging.with_phrases(s, x["tokens"], x["starts"], phrases)) if known else single

    def judged(spans: Column, text: Column) -> Column:
        field = lambda s, c: F.coalesce(s[c], F.lit("")).alias(c)
        flagged = F.transform(spans, lambda s: F.struct(s["token"].alias("token"), F.lit("lexicon").alias("source"), *[field(s, c) for c in fields]))
        words = F.array_distinct(F.transform(spans, lambda s: s["token"]))
        categories = F.filter(F.array_distinct(F.transform(spans, lambda s: F.coalesce(s["category"], F.lit("")))), lambda c: c != "")
        return F.struct(text.alias("clean"), (F.size(spans) == 0).alias("safe"), words.alias("flagged_words"), categories.alias("categories"), flagged.alias("flagged_spans"))

    def of_tokens(text: Column, tokens: Column) -> Column:
        pair = F.struct(tokens.alias("tokens"), phrase_starts(tokens, [r.surface for r in known]).alias("starts"))
        return _bound(F.coalesce(_bound(pair, spans_of), made), lambda s: judged(s, text))

    return _bound(clean, lambda t: _bound(T.token_texts(t), lambda k: of_tokens(t, k)))


def register(spark: SparkSession, entries: DataFrame | None = None) -> None:
    """``normalize_text``, ``tokenize`` (tokens with scripts) and, with a lexicon, ``moderate`` for SQL of this session.

    A null text is an empty one.  Spark takes such functions in a select list, not in a lateral view: a row a token comes of
    ``FROM (SELECT tokenize(text) AS t FROM docs) LATERAL VIEW posexplode(t) AS pos, x``.
    """
    spark.udf.register(CLEAN, T._clean)
    text = F.col("text")
    create(spark, "normalize_text", normalized(text), "string")
    create(spark, "tokenize", T.tag_tokens(text), TOKENS)
    if entries is not None:
        create(spark, "moderate", verdict(normalized(text), entries), VERDICT)
