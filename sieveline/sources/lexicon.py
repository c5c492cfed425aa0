"""The lexicon of abusive surfaces: reading, surfaces in dictionary order, and a small demonstration lexicon."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import nfc, normalize

#: Places of surfaces: the entry's place in the upper half of a long, the variant's in the lower, so that neither has a limit.
PLACES = 1 << 32
RECORD = "struct<variants:array<string>,category:string,severity:string,script:string,meaning_en:string,cross_ref:string>"

#: The columns of an entry and their Arrow types.
ENTRY = {"ord": pa.int32(), "canon": pa.string(), "variants": pa.list_(pa.string()), "category": pa.string(), "severity": pa.string(), "script": pa.string(), "cross_ref": pa.string()}

#: A demonstration lexicon for the driver's tables: canon, variants, category, severity.
DEMO = (
    ("trash", ("trashy",), "profanity", "low"),
    ("pathetic", (), "profanity", "medium"),
    ("idiot", ("idiots", "idiotic"), "profanity", "high"),
    ("disgusting", (), "profanity", "medium"),
    ("worthless", (), "threat", "medium"),
    ("stupid", ("stupidly",), "profanity", "medium"),
    ("clown", (), "misogyny", "low"),
    ("scum", ("scumbag",), "profanity", "high"),
    ("loser", ("losers",), "threat", "medium"),
    ("moron", (), "profanity", "high"),
    ("the and", ("of the",), "threat", "medium"),
)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(ord, canon, variants, category, severity, script, cross_ref) of a lexicon file, in the file's order."""
    rows = spark.read.schema(f"entries map<string,{RECORD}>").option("multiLine", True).json(path)
    out = rows.select(F.posexplode("entries").alias("ord", "canon", "r"))
    return out.select("ord", "canon", F.coalesce("r.variants", F.array().cast("array<string>")).alias("variants"), "r.category", "r.severity", "r.script", "r.cross_ref")


def from_rows(spark: SparkSession, rows=DEMO) -> DataFrame:
    data = [(i, c, list(v), k, s, "LATIN", None) for i, (c, v, k, s) in enumerate(rows)]
    # an Arrow table stays in the driver; rows of Python objects would go to the executors through Python workers
    columns = [pa.array(c, t) for c, t in zip(zip(*data) if data else [()] * 7, ENTRY.values(), strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, list(ENTRY)), "ord int, canon string, variants array<string>, category string, severity string, script string, cross_ref string")


def write_lexicon(entries: DataFrame, path: str, version: str = "1") -> None:
    """The file with its counts by category and severity.  A lexicon is small by nature; its JSON is built in one row."""
    by = lambda c: {r[0] or "": r[1] for r in entries.groupBy(c).count().orderBy(F.desc("count"), c).collect()}
    record = F.struct("variants", "category", "severity", "script", F.lit("").alias("meaning_en"), "cross_ref")
    ordered = entries.groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", "canon", record.alias("r")))).alias("l"))
    meta = entries.agg(F.count("*"), F.sum(F.size("variants"))).first()
    to_map = lambda d: F.from_json(F.lit(__import__("json").dumps(d)), "map<string,long>")
    out = ordered.select(
        F.struct(F.lit(version).alias("version"), F.lit(meta[0]).alias("entries"), F.lit(meta[1]).alias("variants"), to_map(by("category")).alias("by_category"), to_map(by("severity")).alias("by_severity")).alias("_meta"),
        F.map_from_arrays(F.transform("l", lambda x: x["canon"]), F.transform("l", lambda x: x["r"])).alias("entries"),
    )
    out.coalesce(1).write.mode("overwrite").json(path)


def surface_rows(entries: DataFrame) -> DataFrame:
    """(ord, surface, kind, canon, category, severity): every canonical form and variant, keyed, in dictionary order."""
    rows = entries.select("ord", "canon", "category", "severity", F.posexplode(F.concat(F.array("canon"), "variants")).alias("k", "surface"))
    rows = rows.withColumn("surface", nfc(F.lower("surface")))
    return rows.select((F.col("ord").cast("long") * PLACES + F.col("k")).alias("ord"), "surface", F.when(F.col("k") == 0, "canonical").otherwise("variant").alias("kind"), "canon", "category", "severity")


def _one_each(rows: DataFrame, pick) -> DataFrame:
    """A row of each surface, found by partial aggregation: a surface may have a third of all entries."""
    rest = ("ord", "surface", "kind", "canon", "category", "severity")
    return rows.groupBy(F.col("surface").alias("key")).agg(pick(F.struct(*rest)).alias("x")).select("x.*")


def exact_surfaces(entries: DataFrame) -> DataFrame:
    """Surfaces of one token: of equal keys the first entry wins."""
    return _one_each(surface_rows(entries).where(~F.contains("surface", F.lit(" "))), F.min)


def phrase_surfaces(entries: DataFrame) -> DataFrame:
    """Surfaces with a space: of equal keys the last entry wins."""
    return _one_each(surface_rows(entries).where(F.contains("surface", F.lit(" "))), F.max)


def surface_lookup(entries: DataFrame) -> DataFrame:
    """surface to canon and kind for evaluation: the last entry wins."""
    return surface_rows(entries).groupBy("surface").agg(F.max_by(F.struct("canon", "kind", "category", "severity"), "ord").alias("x")).select("surface", "x.*")


def sql_values(rows=DEMO) -> str:
    """The surfaces of a lexicon as SQL rows (ord, surface, kind, canon, category, severity)."""
    out = []
    for i, (canon, variants, category, severity) in enumerate(rows):
        for k, s in enumerate((canon, *variants)):
            out.append(f"({i * PLACES + k}::BIGINT, '{s}', '{'variant' if k else 'canonical'}', '{canon}', '{category}', '{severity}')")
    return "(VALUES " + ", ".join(out) + ") AS lex(ord, surface, kind, canon, category, severity)"


def siblings(entries: DataFrame) -> DataFrame:
    """(canon, script, sibling, sibling_script): entries and those of the other script that they refer to, null if there is none.

    Entries that repeat a canonical form in one script are one sibling, so that a form that many repeat is not multiplied.
    """
    other = entries.select(F.col("canon").alias("sibling"), F.col("script").alias("sibling_script")).distinct()
    return entries.select("canon", "script", "cross_ref").join(other, F.col("cross_ref") == F.col("sibling"), "left").drop("cross_ref")


def query_words(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(ord, word): single-word surfaces, normalised and in lower case, each once at its first place; at most ``limit``."""
    clean = surface_rows(entries).withColumn("word", F.lower(normalize(F.col("surface")))).where("word != ''").where(~F.contains("word", F.lit(" ")))
    first = clean.groupBy("word").agg(F.min("ord").alias("ord")).select("ord", "word")
    return first.orderBy("ord").limit(limit) if limit is not None else first
