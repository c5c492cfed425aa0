"""Discovery of spelling variants of lexicon entries in a labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import common_prefix, dominant_script, edit_threshold, vocabulary_words
from sieveline.operators.matching import near_pairs
from sieveline.scratch import small

#: The most edits that ``edit_threshold`` allows.
MOST_EDITS = 3


def term_frequencies(rows: DataFrame, text: str, offensive: str) -> DataFrame:
    """(token, off, safe): counts of each word in offensive and in other rows."""
    each = rows.select(F.explode(vocabulary_words(F.coalesce(F.col(text), F.lit("")))).alias("token"), F.col(offensive).alias("bad"))
    return each.groupBy("token").agg(F.count_if("bad").alias("off"), F.count_if(~F.col("bad")).alias("safe"))


def corpus_variants(seeds: DataFrame, frequencies: DataFrame, least: int = 5) -> DataFrame:
    """(seed_ord, canon, variant, off, dist): words near a seed (ord, canon, script) that are mostly offensive.

    Frequency filters come first; what is left meets the seeds by the keys of ``matching.near_pairs``, for each number of edits that
    a seed's length allows.
    """
    words = frequencies.where((F.col("off") >= least) & (F.col("off") >= 2 * F.col("safe") + 2) & (F.length("token") >= 4)).withColumn("word_script", dominant_script(F.col("token")))
    s = seeds.select(F.col("ord").alias("seed_ord"), "canon", "script").withColumn("key", F.lower("canon")).withColumn("len", F.length("key")).withColumn("most", edit_threshold(F.col("len")))
    pairs = None
    for most in range(1, MOST_EDITS + 1):
        found = near_pairs(words, "token", s.where(F.col("most") == most), "key", most).where(F.col("word_script") == F.col("script"))
        pairs = found if pairs is None else pairs.unionByName(found)
    pairs = pairs.withColumn("dist", F.levenshtein("key", "token"))
    good = pairs.where((F.col("dist") > 0) & (1 - F.col("dist") / F.greatest(F.col("len"), F.length("token")) >= 0.65))
    prefix = F.greatest(F.lit(3), F.floor(F.col("len") * 0.5))
    good = good.where((F.col("dist") != 2) | (common_prefix(F.col("key"), F.col("token")) >= prefix))
    return good.select("seed_ord", "canon", F.col("token").alias("variant"), "off", "dist")


def claimed(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(canon, variant): each variant goes to the first seed that wants it; canonical forms are never variants."""
    manual = seeds.select(F.col("ord").alias("seed_ord"), "canon", F.posexplode("variants").alias("k", "variant"))
    found = candidates.select("seed_ord", "canon", (-F.col("off")).alias("k"), "variant").withColumn("late", F.lit(1))
    all_ = manual.withColumn("late", F.lit(0)).unionByName(found).withColumn("key", F.lower("variant"))
    all_ = all_.join(small(seeds.select(F.lower("canon").alias("key"))), "key", "left_anti")
    first = Window.partitionBy("key").orderBy("seed_ord", "late", "k", "variant")
    return all_.withColumn("n", F.row_number().over(first)).where("n = 1").select("canon", "variant")


def merged_seeds(found: DataFrame, manual: DataFrame) -> DataFrame:
    """Found seeds whose canonical form is not a manual one, then all manual seeds."""
    return found.join(small(manual.select("canon")), "canon", "left_anti").withColumn("part", F.lit(0)).unionByName(manual.withColumn("part", F.lit(1)))
