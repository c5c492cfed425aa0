"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import byte_pairs
from sieveline.llm.common import table
from sieveline.llm.exact_dedup import exact_dedup
from sieveline.llm.knn_join import knn_join
from sieveline.llm.license_scan import license_scan
from sieveline.llm.mixture import mix
from sieveline.llm.rolling import rolling_features
from sieveline.llm.secret_scan import digest, scan
from sieveline.llm.simhash_dedup import simhash_dedup
from sieveline.llm.spelling import variants
from sieveline.llm.suffix_tree import score
from sieveline.llm.tokenise import encode, token_counts
from sieveline.llm.toxicity import toxicity


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, found once for each distinct text.

    The documents come in two increments, as commits do: the second meets the ledger that the first has left in the shared
    folder, so that texts which both hold are scanned in the first alone.
    """
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    late = F.coalesce(F.crc32(F.col("id").cast("string")) % 2 == 1, F.lit(False))
    early, ledger = scan(versions.where(~late))
    rest, _ = scan(versions.where(late), ledger)
    return digest(early.unionByName(rest)).withColumnRenamed("id", "doc_id")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash of every document and the least document that near-duplicates lead to."""
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to it."""
    return encode(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that are not held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each vector whose id is divisible by 50."""
    return knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or that of its nearest directory.

    The tables have no paths, so that they are made from source, language and id: /source/lang/<hundred>/<id>.  Every tenth
    document is a file named LICENSE of its hundred, every hundredth of its language, every thousandth of its source.
    """
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    number = F.col("doc_id").cast("long")
    hundred, every = F.coalesce(F.floor(number / 100).cast("string"), F.lit("none")), lambda n: F.coalesce(number % n == 0, F.lit(False))
    file = F.when(every(10), F.concat(F.lit("LICENSE-"), number.cast("string"))).otherwise(part("doc_id"))
    folder = F.when(every(1000), F.concat_ws("/", F.lit(""), part("source"))).when(every(100), F.concat_ws("/", F.lit(""), part("source"), part("lang")))
    folder = folder.otherwise(F.concat_ws("/", F.lit(""), part("source"), part("lang"), hundred))
    files = docs.select("doc_id", F.concat_ws("/", folder, file).alias("path"), "text")
    found = license_scan(files, F.col("path").rlike("/LICENSE-[^/]*$"), keep=("doc_id",))
    return found.select("doc_id", "path", "license", F.round("score", 6).alias("score"), "how", "source_path")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under a suffix tree, and under its base."""
    return score(table(spark, sf_dir, "documents"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-pair ids of every document, and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_pairs.decode(byte_pairs.encode(docs, path, public_tokenizers.PATTERN), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums, languages and ranks of lengths in the hour and the six hours before each document, by source."""
    place = F.col("doc_id") + F.crc32(F.col("doc_id").cast("string")) % 4000
    length = F.char_length("text").cast("bigint")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", length.alias("length"), (60 * F.floor(place / 6)).alias("event_s"))
    found = rolling_features(docs, F.col("source"), F.col("event_s"), F.col("length"), F.col("lang"), [3600, 21600])
    return found.select("doc_id", "event_s", F.inline("features")).select("doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the more frequent forms that they are variants of."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")
