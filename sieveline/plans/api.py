"""The surface that users call: a moderator, a redactor, SQL functions, a command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sieveline
from sieveline.functions.text import normalize, strip, tag_tokens
from sieveline.operators import redact as _redact
from sieveline.operators.matching import SENSITIVITIES
from sieveline.operators.tagging import moderate
from sieveline.scratch import numbered
from sieveline.sources import lexicon, readers

SHORT = ("text", "safe", "flagged_words", "categories", "flagged_spans")
FULL = (*SHORT, "clean", "tokens", "model_tags", "lexicon_tags", "merged_tags")


class Moderator:
    """A lexicon, and optionally a model's tags, over columns of text."""

    def __init__(self, entries: DataFrame, sensitivity: str = "standard") -> None:
        self.entries, self.sensitivity = entries, sensitivity

    @classmethod
    def load(cls, spark: SparkSession, lexicon_path: str | None = None, sensitivity: str = "standard") -> Moderator:
        return cls(lexicon.read_lexicon(spark, lexicon_path) if lexicon_path else lexicon.from_rows(spark), sensitivity)

    def transform(self, docs: DataFrame, key: str = "doc_id", text: str = "text", model: DataFrame | None = None) -> DataFrame:
        for c in (key, text):
            if c not in docs.columns:
                raise ValueError(f"the rows have no column {c!r}")
        return moderate(docs, self.entries, key, text, self.sensitivity, model)

    def censor(self, docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
        return _redact.redact(self.transform(docs, key, text), text, **options)


def to_json(rows: DataFrame, full: bool = False, *beside: str) -> DataFrame:
    """One JSON document a row, in ``value``, and the columns that are asked for beside it."""
    return rows.select(*beside, F.to_json(F.struct(*[c for c in (FULL if full else SHORT) if c in rows.columns])).alias("value"))


def censored_json(rows: DataFrame, *beside: str) -> DataFrame:
    fields = ("original", "text", "censored", "safe", "redacted_count", "redacted_spans", "polite_suggestion", "categories")
    return rows.select(*beside, F.to_json(F.struct(*[c for c in fields if c in rows.columns])).alias("value"))


def verdict_csv(rows: DataFrame, path: str) -> None:
    """Verdicts for a spreadsheet."""
    out = rows.select("text", F.when(F.col("safe"), "SAFE").otherwise("UNSAFE").alias("verdict"), F.array_join("flagged_words", "; ").alias("flagged_words"), F.array_join("categories", "; ").alias("categories"))
    readers.write_csv(out, path)


REQUEST = "text string, texts array<string>, sensitivity string, mode string, mask_char string, severity_threshold string, allowed_categories array<string>"


def respond(requests: DataFrame, entries: DataFrame, full: bool = False) -> DataFrame:
    """``requests`` (id, path, body) with status and response, as a service would answer them, a batch of requests at once.

    Paths are /predict, /predict_batch, /censor and /health; a body without its text, or whose texts are no list, is answered
    by 400 and a message, an unknown path by 404.  What a request asks for (mode, mark, threshold, categories) are columns of one
    plan; only the three sensitivities are branches, however many kinds of requests there are.
    """
    whole = F.from_json("body", "map<string,string>")
    rows, row = numbered(requests.select("id", "path", whole.alias("whole"), F.from_json("body", REQUEST).alias("r")))
    at = F.regexp_replace("path", "[?].*$", "")
    has = lambda c: F.coalesce(F.map_contains_key("whole", F.lit(c)), F.lit(False))
    no_list = ~F.coalesce(F.startswith(F.try_element_at("whole", F.lit("texts")), F.lit("[")), F.lit(False))
    # the service's messages (fixed values)
    error = (
        F.when(at.isin("/predict", "/censor") & ~has("text"), "body must be JSON with a 'text' field")
        .when((at == "/predict_batch") & ~has("texts"), "body must be JSON with a 'texts' list")
        .when((at == "/predict_batch") & no_list, "'texts' must be a list of strings")
    )
    rows = rows.withColumn("at", at).withColumn("error", error)
    status = F.when(F.col("error").isNotNull(), 400).when(~F.col("at").isin("/predict", "/predict_batch", "/censor", "/health"), 404).otherwise(200)
    rows = rows.withColumn("status", status)
    text = F.when(F.col("at") == "/predict_batch", F.col("r.texts")).otherwise(F.array(F.col("r.text")))
    asked = rows.where("status = 200 AND at != '/health'").select(F.col(row).alias("n"), "at", F.coalesce(F.lower("r.sensitivity"), F.lit("standard")).alias("sensitivity"), F.coalesce(F.lower("r.mode"), F.lit("partial")).alias("mode"), F.col("r.mask_char").alias("mask"), F.coalesce(F.lower("r.severity_threshold"), F.lit("all")).alias("threshold"), F.col("r.allowed_categories").alias("allowed"), F.posexplode_outer(text).alias("k", "text"))
    blank = F.to_json(F.struct(F.lit(True).alias("safe"), F.array().cast("array<string>").alias("flagged_words")))
    answers = None
    for sensitivity in SENSITIVITIES:
        own = F.when(F.col("sensitivity").isin("strict", "maximum"), F.col("sensitivity")).otherwise("standard") == sensitivity
        found = moderate(asked.where(own), entries, "n", sensitivity=sensitivity)
        masked = _redact.redact(found, mode=F.col("mode"), mask=F.col("mask"), threshold=F.col("threshold"), categories=F.col("allowed"))
        censored = censored_json(masked.where("at = '/censor'").withColumnRenamed("text", "original"), "n", "k")
        plain = to_json(found.where("at != '/censor'"), full, "n", "k", "at", "text")
        is_blank = (F.col("at") == "/predict_batch") & (F.coalesce(strip(F.col("text")), F.lit("")) == "")
        plain = plain.select("n", "k", F.when(is_blank, blank).otherwise(F.col("value")).alias("value"))
        answers = censored.unionByName(plain) if answers is None else answers.unionByName(censored).unionByName(plain)
    health_ = F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(sieveline.__version__).alias("version")))
    fixed = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).when(F.col("status") == 404, F.lit('{"error":"no such path"}')).otherwise(health_)
    by = answers.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("values"))
    out = rows.join(by, F.col(row) == F.col("n"), "left")
    batch = F.concat(F.lit('{"results":['), F.array_join(F.coalesce("values", F.array().cast("array<string>")), ","), F.lit("]}"))
    empty = (F.col("at") == "/predict_batch") & (F.size("r.texts") == 0)
    answer = F.when(empty, F.lit('{"results":[]}')).when(F.col("at") == "/predict_batch", batch).when(F.col("at").isin("/predict", "/censor"), F.element_at("values", 1))
    return out.select("id", "status", F.when((F.col("status") == 200) & (F.col("at") != "/health"), answer).otherwise(fixed).alias("response"))


def register(spark: SparkSession) -> None:
    """SQL functions that need no Python: tokenise_text(text)."""
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION tokenise_text(t STRING) RETURNS ARRAY<STRING>
        RETURN regexp_extract_all(t, r'(?U)\p{IsTamil}+|\p{IsLatin}+|\p{Nd}+|\p{L}+|[^\s\p{L}\p{Nd}]+', 0)""")


def health(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """Version and configuration in one row."""
    return entries.agg(F.count("*").alias("entries"), F.sum(F.size("variants")).alias("variants")).select(F.lit("ok").alias("status"), F.lit(sieveline.__version__).alias("version"), F.lit(spark.version).alias("spark"), "entries", "variants")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sieveline")
    p.add_argument("text", nargs="*")
    p.add_argument("--file", help="a file with a text on each line")
    p.add_argument("--stdin", action="store_true")
    p.add_argument("--lexicon")
    p.add_argument("--full", action="store_true")
    p.add_argument("--compact", action="store_true")
    p.add_argument("--censor", action="store_true")
    p.add_argument("--censor-mode", choices=_redact.MODES, default="partial")
    p.add_argument("--mask-char")
    p.add_argument("--sensitivity", choices=("standard", "strict", "maximum"), default="standard")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    if o.file:
        rows = readers.read_lines(spark, o.file)
    else:
        texts = [x.rstrip("\n") for x in sys.stdin if x.strip()] if o.stdin else o.text
        if not texts:
            p.error("give a text, --file or --stdin")
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = rows.withColumn("doc_id", F.monotonically_increasing_id())
    moderator = Moderator.load(spark, o.lexicon, o.sensitivity)
    found = moderator.censor(rows, mode=o.censor_mode, mask=o.mask_char) if o.censor else moderator.transform(rows)
    out = (censored_json(found) if o.censor else to_json(found, o.full)).toLocalIterator()
    for r in out:
        print(r.value if o.compact else json.dumps(json.loads(r.value), ensure_ascii=False, indent=2))
    return 0


__all__ = ["Moderator", "censored_json", "health", "main", "normalize", "register", "respond", "tag_tokens", "to_json", "verdict_csv"]

if __name__ == "__main__":
    sys.exit(main())
