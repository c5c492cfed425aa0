"""The neural tagger's forward pass from given weights: characters, words, both directions, emissions, decoding.

Weights are plain arrays by name, read from an ``.npz`` file or made by any trainer.  An Arrow function runs all sentences of a
batch together, step by step over those that are still long enough, so that nothing is padded but the characters of a word.

Names: ``word`` [words, d], ``char`` [chars, c], ``conv{k}.w`` [out, c, k] and ``conv{k}.b`` [out] for each kernel width k,
``lstm{n}.{fw|bw}.{wx|wh|b}`` with gates in the order input, forget, cell, output, ``emission.w`` [tags, 2h], ``emission.b``,
``crf.start``, ``crf.transitions`` [from, to], ``crf.end``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.crf import decoded
from sieveline.operators.evaluate import TAGS

PAD, UNKNOWN = 0, 1
MOST_CHARS = 32
#: Sentences that are run together.
TOGETHER = 256


def save_weights(weights: dict[str, np.ndarray], spark: SparkSession, path: str) -> None:
    """One binary row, so that any file system that Spark writes to will do; a model's size is bounded by its making."""
    out = io.BytesIO()
    np.savez(out, **weights)
    spark.createDataFrame([(bytearray(out.getvalue()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(spark.read.parquet(path).first().weights))) as found:
        return {k: found[k] for k in found.files}


def embedding_matrix(vocabulary: dict[str, int], vectors: DataFrame, size: int, seed: int = 13) -> np.ndarray:
    """Rows aligned to a vocabulary: its words' vectors (word, vector), zeros for padding, seeded noise for words without one.

    Only the vocabulary's vectors come to the driver; a vocabulary is bounded by its making.
    """
    out = np.random.default_rng(seed).normal(0, 0.05, (max(vocabulary.values(), default=UNKNOWN) + 1, size))
    out[PAD] = 0
    spark = vectors.sparkSession
    wanted = spark.createDataFrame(list(vocabulary.items()), "known string, id int")
    for r in vectors.join(wanted, F.col("word") == F.col("known")).select("id", "vector").toLocalIterator():
        out[r.id] = r.vector
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def char_features(w: dict[str, np.ndarray], chars: np.ndarray) -> np.ndarray:
    """For words [n, length] of character ids: each kernel's greatest rectified response along the word."""
    emb = w["char"][chars]  # n, length, c
    out = []
    for name in sorted((k for k in w if k.startswith("conv") and k.endswith(".w")), key=lambda k: int(k[4:-2])):
        kernel, bias = w[name], w[name[:-1] + "b"]
        width = kernel.shape[2]
        pad = width // 2
        line = np.pad(emb, ((0, 0), (pad, pad), (0, 0)))
        steps = line.shape[1] - width + 1
        response = sum(line[:, k : k + steps] @ kernel[:, :, k].T for k in range(width)) + bias
        out.append(np.maximum(response, 0).max(axis=1))
    return np.concatenate(out, axis=1)


def _direction(w: dict[str, np.ndarray], name: str, x: np.ndarray, sizes: np.ndarray, backward: bool) -> np.ndarray:
    """Hidden states of sequences that lie one after another in x, longest first at each step."""
    wx, wh, b = (w[f"{name}.{k}"] for k in ("wx", "wh", "b"))
    hidden = wh.shape[1]
    out = np.zeros((len(x), hidden))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    h, c = np.zeros((len(order), hidden)), np.zeros((len(order), hidden))
    gates_x = x @ wx.T + b
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))
        at = begin[:n] + (length[:n] - 1 - t if backward else t)
        i, f, g, o = np.split(gates_x[at] + h[:n] @ wh.T, 4, axis=1)
        c[:n] = _sigmoid(f) * c[:n] + _sigmoid(i) * np.tanh(g)
        h[:n] = _sigmoid(o) * np.tanh(c[:n])
        out[at] = h[:n]
    return out


def emissions(w: dict[str, np.ndarray], word_ids: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores [tokens, tags] of sentences that lie one after another."""
    x = np.concatenate([w["word"][word_ids], char_features(w, chars)], axis=1)
    layer = 0
    while f"lstm{layer}.fw.wx" in w:
        x = np.concatenate([_direction(w, f"lstm{layer}.fw", x, sizes, False), _direction(w, f"lstm{layer}.bw", x, sizes, True)], axis=1)
        layer += 1
    return x @ w["emission.w"].T + w["emission.b"]


def char_matrix(tokens: list[str], ids: dict[str, int], most: int = MOST_CHARS) -> np.ndarray:
    """Character ids of words, filled up to the longest of them; an empty word is one pad."""
    rows = [[ids.get(c, UNKNOWN) for c in t[:most]] or [PAD] for t in tokens]
    out = np.full((len(rows), max(map(len, rows), default=1)), PAD, dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def class_weighted(em: np.ndarray, weights: list[float]) -> np.ndarray:
    """Emissions as the training loss sees them: with the logs of the classes' weights."""
    return em + np.log(np.maximum(np.asarray(weights, float), 1e-6))


def tag_sentences(rows: DataFrame, weights: dict[str, np.ndarray], words: dict[str, int], chars: dict[str, int], key: str = "doc_id", tokens: str = "tokens", tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(key, tags): one tag for each token, by the network's emissions and the chain's best path.  What ``moderate`` takes as model."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, TOGETHER) for x in batches for at in range(0, x.num_rows, TOGETHER)):
            sentences = [[(t or "").strip().lower() for t in s or []] for s in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sentences], dtype=np.int64)
            flat = [t for s in sentences for t in s]
            path = np.empty(0, dtype=np.int32)
            if flat:
                em = emissions(weights, np.array([words.get(t, UNKNOWN) for t in flat]), char_matrix(flat, chars), sizes)
                path = decoded(weights["crf.start"], weights["crf.transitions"], weights["crf.end"], sizes, em)
            names = pa.array([tags[k] for k in path], pa.string())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, names)], names=[key, "tags"])

    return rows.select(key, tokens).mapInArrow(run, f"`{key}` {kind}, tags array<string>")


def transition_counts(sequences: DataFrame, tags: tuple[str, ...] = TAGS, smooth: float = 1.0) -> dict[str, np.ndarray]:
    """Start, transition and end scores of a chain as smoothed log frequencies of tagged sentences: one small aggregate."""
    index = {t: k for k, t in enumerate(tags)}
    line = F.concat(F.array(F.lit("")), F.col("tags"), F.array(F.lit("")))
    pairs = sequences.where(F.size("tags") > 0).select(F.explode(F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    n = np.full((len(tags) + 1, len(tags) + 1), smooth)
    n[-1, -1] = 0
    for r in pairs.groupBy("p.a", "p.b").count().where(F.col("a").isin("", *tags) & F.col("b").isin("", *tags)).collect():
        n[index.get(r.a, -1), index.get(r.b, -1)] += r["count"]
    share = np.log(np.maximum(n, 1e-300) / n.sum(axis=1, keepdims=True))
    return {"crf.start": share[-1, :-1], "crf.transitions": share[:-1, :-1], "crf.end": share[:-1, -1]}


def window_features(sequences: DataFrame, size: int = 1 << 14) -> DataFrame:
    """(sent_id, pos, tag, features): hashed words, ends of words and shapes of each token and its neighbours."""
    from pyspark.ml.feature import HashingTF

    at = lambda t, i: F.coalesce(F.try_element_at(t, i), F.lit("<none>"))
    t = F.col("tokens")

    def of(token, i):
        near = [F.concat(F.lit(f"{k}:"), at(t, i + 1 + k) if k >= 0 else F.when(i + k >= 0, at(t, F.greatest(i + 1 + k, F.lit(1)))).otherwise("<none>")) for k in (-1, 0, 1)]
        ends = [F.concat(F.lit(f"e{k}:"), F.right(token, F.lit(k))) for k in (2, 3)] + [F.concat(F.lit(f"b{k}:"), F.left(token, F.lit(k))) for k in (2, 3)]
        return F.array(*near, *ends)

    each = F.transform(t, lambda x, i: F.struct(i.alias("pos"), x.alias("token"), F.element_at("tags", i + 1).alias("tag"), of(x, i).alias("parts")))
    rows = sequences.select("sent_id", F.explode(each).alias("x")).select("sent_id", "x.*")
    return HashingTF(numFeatures=size, inputCol="parts", outputCol="features").transform(rows)


def fit_emissions(sequences: DataFrame, tags: tuple[str, ...] = TAGS, weights: dict[str, float] | None = None, rounds: int = 30):
    """A trained stand-in for the network: a multinomial logistic model of windows, with class weights, for the chain to decode."""
    from pyspark.ml.classification import LogisticRegression

    index, weight = F.lit(None).cast("double"), F.lit(1.0)
    for k, tag in enumerate(tags):
        index = F.when(F.col("tag") == tag, float(k)).otherwise(index)
        weight = F.when(F.col("tag") == tag, (weights or {}).get(tag, 1.0)).otherwise(weight)
    rows = window_features(sequences).withColumn("label", index).withColumn("weight", weight).where("label IS NOT NULL")
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", maxIter=rounds, regParam=1e-4).fit(rows)


def logistic_emissions(model, sequences: DataFrame) -> DataFrame:
    """(doc_id, em): log probabilities of the tags, token by token, for ``crf.paths``."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(window_features(sequences)).select("sent_id", "pos", F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-12)))).alias("e"))
    by = scored.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("x"))
    return by.select(F.col("sent_id").alias("doc_id"), F.transform("x", lambda s: s["e"]).alias("em"))
