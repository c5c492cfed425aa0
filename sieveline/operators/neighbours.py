"""Nearest neighbours by cosine, and embedding training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of a part, and queries whose scores are in memory at once.
ROUND, PART, TOGETHER = 2048, 16_384, 64


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _block_rows(k: int):
    """The k nearest vectors to each query of a part, by one matrix product."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("id", kind="stable")
            ids, x = vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()).astype(float)
            q = np.stack(queries["v"].to_numpy()).astype(float)
            lengths, own = np.sqrt((x**2).sum(1)), np.sqrt((q**2).sum(1))
            names = queries["id"].to_numpy()
            for at in range(0, len(q), TOGETHER):
                norms = own[at : at + TOGETHER, None] * lengths[None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.where(norms > 0, q[at : at + TOGETHER] @ x.T / norms, np.nan)
                for name, row in zip(names[at : at + TOGETHER], scores, strict=True):
                    good = np.flatnonzero((ids != name) & ~np.isnan(row))
                    found = row[good]
                    if len(good) > k:  # all that reach the k-th score, so that its ties are still in order
                        some = found >= np.partition(found, len(found) - k)[len(found) - k]
                        good, found = good[some], found[some]
                    best = good[np.argsort(-found, kind="stable")[:k]]
                    out += [(name, ids[i], row[i]) for i in best]
        return pd.DataFrame(out, columns=["query", "neighbor", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, neighbor, score, rank) of each query's k nearest.

    Queries and vectors are dealt in parts; each pair of parts is one matrix product, of which the k best of each query go on.
    """
    kind = dict(vectors.dtypes)[id_]
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((queries, ROUND), (vectors, PART)))
    mine = lambda n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(id_).alias("id"), F.col(vector).alias("v"), mine(blocks).alias("block"), every(parts).alias("part"))
    v = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v"), mine(parts).alias("part"), every(blocks).alias("block"))
    q, v = (df.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").alias("id"), "v", F.col("block").alias("b"), F.col("part").alias("p")) for df in (q, v))
    out = q.groupBy("b", "p").cogroup(v.groupBy("b", "p")).applyInPandas(_block_rows(k), f"query {kind}, neighbor {kind}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "neighbor")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_words(words: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query, in_vocab, neighbor, score, rank) of words, looked up among the vectors (word, vector) first; unknown ones have one row."""
    known = words.join(vectors.select(F.col("word").alias("w"), "vector"), F.col("word") == F.col("w"), "left")
    found = nearest(known.where("vector IS NOT NULL").select("word", "vector"), vectors, k, "word", "vector")
    flags = known.select(F.col("word").alias("query_word"), F.col("w").isNotNull().alias("in_vocab")).distinct()
    return flags.join(found, F.col("query_word") == F.col("query"), "left").select(F.col("query_word").alias("query"), "in_vocab", "neighbor", "score", "rank")


def train_embeddings(tokens: DataFrame, column: str = "tokens", size: int = 200, window: int = 5, least: int = 1, rounds: int = 20, seed: int = 13):
    """A skip-gram model of arrays of tokens."""
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol=column, outputCol="vector").fit(tokens)
