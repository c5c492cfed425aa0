"""Skip-gram embeddings with subwords, and vectors for words that were never seen.

A word's vector is the mean of its own and those of its hashed character n-grams, so that a misspelt word lies near the word it
stands for.  A round is one job: each task goes over its sentences by stochastic gradient descent from the model of the round
(windows of random width, frequent words left out at random, negative samples by count^0.75; the pairs of a word stand together, so
that its n-grams are read and changed once for all of them), and gives the rows that it has changed;
of each row the changes are averaged by the number of updates behind them, dealt by row, so that no task holds all of them.  The model
has BUCKETS + 2 x words rows, which the parameters bound, whatever the corpus; sentences stay where they are.

Null sentences and words count for nothing; words that are too rare are left out of training only; an empty corpus gives vectors of
hashed noise.  The same data in the same parts give the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.scratch import cut

#: Buckets of n-grams; words of the vocabulary at most; n-grams from and to these lengths.
BUCKETS, MOST_WORDS, SHORT, LONG = 1 << 15, 50_000, 3, 6
#: The range that rows start in.  It is wide enough for a word's n-grams to tell it apart before it has been seen often.
START = 0.8
#: Pairs that are learned from at once.
TOGETHER = 256


def gram_rows(word: str, buckets: int = BUCKETS) -> list[int]:
    """The buckets of a word's n-grams, its ends marked."""
    marked = f"<{word}>"
    return [xxhash.xxh64_intdigest(marked[i : i + n]) % buckets for n in range(SHORT, LONG + 1) for i in range(len(marked) - n + 1)]


@dataclass
class Embedding:
    """Input rows (n-grams, then words) and output rows (words)."""

    words: dict[str, int]
    counts: np.ndarray
    rows: np.ndarray
    outputs: np.ndarray
    buckets: int = BUCKETS

    def vector(self, word: str) -> np.ndarray:
        """Of any word: without its own row if it is unknown; zeros if it has no n-gram either."""
        at = gram_rows(word, self.buckets)
        if word in self.words:
            at.append(self.buckets + self.words[word])
        return self.rows[at].mean(axis=0) if at else np.zeros(self.rows.shape[1], np.float32)


def vocabulary(sentences: DataFrame, tokens: str = "tokens", least: int = 2, most: int = MOST_WORDS) -> dict[str, int]:
    """The most frequent words with their counts: as many as the model has rows for."""
    words = sentences.select(F.explode(tokens).alias("word")).where("word IS NOT NULL").groupBy("word").count().where(F.col("count") >= least)
    return {r.word: r["count"] for r in words.orderBy(F.desc("count"), "word").limit(most).collect()}


def _pairs(ids: np.ndarray, sentence: np.ndarray, window: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of centres, the centres, and contexts within a random width of each, in the same sentence.

    Centres come in random order, each with all its contexts.
    """
    width, places, contexts = rng.integers(1, window + 1, len(ids)), [], []
    for k in range(1, window + 1):
        near = sentence[k:] == sentence[:-k]
        for here, b, own in ((np.arange(len(near)), ids[k:], width[:-k]), (np.arange(k, k + len(near)), ids[:-k], width[k:])):
            good = near & (k <= own)
            places.append(here[good])
            contexts.append(b[good])
    place, b = np.concatenate(places), np.concatenate(contexts)
    order = np.argsort(rng.permutation(len(ids))[place], kind="stable")
    return place[order], ids[place[order]], b[order]


def _added(table: np.ndarray, at: np.ndarray, values: np.ndarray, counts: np.ndarray, of: np.ndarray | None = None, times: np.ndarray | None = None) -> None:
    """``table[at] += values``, and how often each row was changed; ``of``: the row of ``values``; ``times``: the changes behind it.

    The changes of a row that repeats are added up and divided by the root of their number: all were computed from the same row, and
    the sum of hundreds for a common n-gram would overshoot.
    """
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rows, n = ordered[first], np.diff(np.append(first, len(at)))
    source = order if of is None else of[order]
    sums, several = np.take(values, source[first], axis=0), n > 1
    if several.any():  # a sum of one takes as long as one of many
        size = n[several]
        sums[several] = np.add.reduceat(np.take(values, source[np.repeat(several, n)], axis=0), np.cumsum(size) - size, axis=0)
    if times is not None:
        n = np.add.reduceat(times[order], first)
    sums /= np.sqrt(n)[:, None].astype(sums.dtype)
    table[rows] += sums
    counts[rows] += n


class _Learner:
    """Stochastic gradient descent of one task on its own copy of the model."""

    def __init__(self, model: Embedding, window: int, negatives: int, sample: float, rate: float, rng: np.random.Generator) -> None:
        self.words, self.window, self.negatives, self.rate, self.rng = model.words, window, negatives, rate, rng
        self.rows, self.outputs = model.rows.copy(), model.outputs.copy()
        self.row_counts, self.output_counts = np.zeros(len(self.rows), np.int64), np.zeros(len(self.outputs), np.int64)
        share = model.counts / model.counts.sum()
        self.kept = np.minimum(1, np.sqrt(sample / share) + sample / share)
        self.drawn = np.cumsum(model.counts**0.75)
        made = [[*gram_rows(w, model.buckets), model.buckets + i] for w, i in model.words.items()]
        self.sizes = np.array([len(x) for x in made])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.parts = np.concatenate([np.array(x) for x in made])

    def learn(self, sentences: list[list[str] | None]) -> None:
        found = [[self.words[w] for w in s or [] if w in self.words] for s in sentences]
        ids = np.array([i for s in found for i in s], dtype=np.int64)
        sentence = np.repeat(np.arange(len(found)), [len(s) for s in found])
        keep = self.rng.random(len(ids)) < self.kept[ids] if len(ids) else np.zeros(0, bool)
        if keep.sum() < 2:
            return
        places, centres, contexts = _pairs(ids[keep], sentence[keep], self.window, self.rng)
        for at in range(0, len(centres), TOGETHER):
            self.step(*(x[at : at + TOGETHER] for x in (centres, contexts, places)))

    def step(self, centre: np.ndarray, context: np.ndarray, place: np.ndarray | None = None) -> None:
        """Learn from pairs; those of one ``place``, which stand together, are one change of the centre's rows."""
        words, of = np.unique(centre, return_inverse=True)
        if place is None:
            times = np.bincount(of)
        else:
            times = np.bincount(of[np.concatenate([[True], place[1:] != place[:-1]])], minlength=len(words))
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        flat = self.parts[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[words], sizes)]
        own = (np.add.reduceat(np.take(self.rows, flat, axis=0), ends - sizes, axis=0) / sizes[:, None].astype(np.float32))[of]
        others = np.searchsorted(self.drawn, self.rng.random((len(centre), self.negatives)) * self.drawn[-1])
        target = np.concatenate([context[:, None], others], axis=1)
        wanted = np.zeros(target.shape, np.float32)
        wanted[:, 0] = 1
        vectors = np.take(self.outputs, target, axis=0)
        error = (wanted - 1 / (1 + np.exp(-np.matmul(vectors, own[:, :, None])[:, :, 0]))) * np.float32(self.rate)
        error[:, 1:][others == context[:, None]] = 0
        same = (of == np.arange(len(words))[:, None]).astype(np.float32)
        back = same @ np.matmul(error[:, None, :], vectors)[:, 0, :]
        _added(self.outputs, target.ravel(), (error[:, :, None] * own[:, None, :]).reshape(-1, own.shape[1]), self.output_counts)
        _added(self.rows, flat, back, self.row_counts, np.repeat(np.arange(len(words)), sizes), np.repeat(times, sizes))


def _round_rows(shared, options: dict, number: int, seed: int):
    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("change", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Embedding = shared.value
        learner = _Learner(model, rng=np.random.default_rng([seed, number, TaskContext.get().partitionId()]), **options)
        for batch in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            learner.learn(batch.column(0).to_pylist())
        for before, after, counts, offset in ((model.rows, learner.rows, learner.row_counts, 0), (model.outputs, learner.outputs, learner.output_counts, len(model.rows))):
            some = np.flatnonzero(counts)
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                change = (after[part] - before[part]) * counts[part][:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * change.shape[1]), pa.array(change.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(part + offset), pa.array(counts[part]), lists], schema=schema)

    return run


def _mean_rows(size: int):
    """Over rows (row, n, change) dealt by row: their means, weighed by n."""
    schema = pa.schema([("row", pa.int64()), ("change", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(-1, size)
            for row, n, change in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                made = np.concatenate([change, [n]])
                sums[row] = sums[row] + made if row in sums else made
        if sums:
            every = np.stack(list(sums.values()))
            means = (every[:, :-1] / every[:, -1:]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(means) + 1, dtype=np.int32) * size), pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), lists], schema=schema)

    return run


def train(sentences: DataFrame, tokens: str = "tokens", size: int = 64, rounds: int = 5, window: int = 5, negatives: int = 10, sample: float = 1e-4, least: int = 2, rate: float = 0.05, seed: int = 13, buckets: int = BUCKETS, most: int = MOST_WORDS) -> Embedding:
    """An embedding of the words of ``sentences``, arrays of words."""
    # each round goes over the sentences again, so they are dealt evenly once
    parts = sentences.sparkSession.sparkContext.defaultParallelism
    rows = cut(sentences.select(F.col(tokens).cast("array<string>").alias("tokens")).repartition(parts), "sentences")
    counts = vocabulary(rows, "tokens", least, most)
    rng = np.random.default_rng(seed)
    first = ((rng.random((buckets + len(counts), size)) - 0.5) * START).astype(np.float32)
    model = Embedding({w: i for i, w in enumerate(counts)}, np.array(list(counts.values()), float), first, np.zeros((len(counts), size), np.float32), buckets)
    if not counts:
        return model
    context = rows.sparkSession.sparkContext
    for number in range(rounds):
        shared = context.broadcast(model)
        options = {"window": window, "negatives": negatives, "sample": sample, "rate": rate * (1 - number / (rounds + 1))}
        changed = rows.mapInArrow(_round_rows(shared, options, number, seed), "row long, n long, change array<float>")
        found = changed.repartition("row").mapInArrow(_mean_rows(size), "row long, change array<float>").toArrow()
        shared.destroy()
        at, change = found.column(0).to_numpy(), found.column(1).combine_chunks().flatten().to_numpy().reshape(-1, size)
        inner = at < len(model.rows)
        new_rows, new_outputs = model.rows.copy(), model.outputs.copy()
        new_rows[at[inner]] += change[inner]
        new_outputs[at[~inner] - len(model.rows)] += change[~inner]
        model = Embedding(model.words, model.counts, new_rows, new_outputs, buckets)
    return model


def word_vectors(words: DataFrame, model: Embedding, word: str = "word", to: str = "vector") -> DataFrame:
    """``words`` with a vector each, known or not, and ``in_vocab``."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<vector:array<float>,known:boolean>")
    def made(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own: Embedding = shared.value
        for values in column:
            texts = [w or "" for w in values.to_pylist()]
            vectors = pa.array([own.vector(w).tolist() for w in texts], pa.list_(pa.float32()))
            yield pa.StructArray.from_arrays([vectors, pa.array([w in own.words for w in texts], pa.bool_())], ["vector", "known"])

    found = made(F.col(word))
    return words.withColumn(to, F.explode(F.array(found))).withColumn("in_vocab", F.col(to)["known"]).withColumn(to, F.col(to)["vector"])
