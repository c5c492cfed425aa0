"""Linear-chain CRF: Viterbi decoding and log-likelihood as folds over arrays of emissions, without a UDF.

A fold copies its back-pointers at each step, so its time is quadratic in the length; ``paths`` decodes long sequences linearly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(em: Column) -> Column:
    return F.when(F.size(em) > 1, F.slice(em, F.lit(2), F.greatest(F.size(em) - 1, F.lit(1)))).otherwise(F.array().cast("array<array<double>>"))


def viterbi(start: Column, transitions: Column, end: Column, emissions: Column) -> Column:
    """The best tag of each step (array<int>); of equal scores the first tag.  Sequences are as long as they are: no padding."""
    first = F.struct(F.zip_with(start, F.element_at(emissions, 1), lambda a, b: a + b).alias("sc"), F.array().cast("array<array<int>>").alias("bp"))

    def step(acc: Column, e: Column) -> Column:
        per = F.transform(e, lambda x, j: F.transform(acc["sc"], lambda s, i: s + F.element_at(F.element_at(transitions, i + 1), j + 1)))
        best = F.transform(per, F.array_max)
        sc = F.zip_with(best, e, lambda a, b: a + b)
        back = F.zip_with(per, best, lambda c, m: (F.array_position(c, m) - 1).cast("int"))
        return F.struct(sc.alias("sc"), F.concat(acc["bp"], F.array(back)).alias("bp"))

    def finish(acc: Column) -> Column:
        whole = F.zip_with(acc["sc"], end, lambda a, b: a + b)
        last = (F.array_position(whole, F.array_max(whole)) - 1).cast("int")
        return F.aggregate(F.reverse(acc["bp"]), F.array(last), lambda path, b: F.concat(F.array(F.element_at(b, F.element_at(path, 1) + 1)), path))

    return F.when(F.coalesce(F.size(emissions), F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(_steps(emissions), first, step, finish))


def decoded(start: np.ndarray, transitions: np.ndarray, end: np.ndarray, sizes: np.ndarray, em: np.ndarray) -> np.ndarray:
    """The tags of sequences that lie one after another in ``em``, step by step over all that are still long enough."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    path = np.empty(len(em), dtype=np.int32)
    if not len(order):
        return path
    lasting = [int(np.searchsorted(-length, -t, side="left")) for t in range(length[0])]
    back = np.zeros(em.shape, dtype=np.int32)
    score = start + em[begin]
    final = score.copy()
    for t in range(1, length[0]):
        at = begin[: lasting[t]] + t
        per = score[: lasting[t], :, None] + transitions
        back[at] = per.argmax(1)
        score = per.max(1) + em[at]
        final[: lasting[t]] = score
    tag = (final + end).argmax(1)
    for t in range(length[0] - 1, -1, -1):
        at = begin[: lasting[t]] + t
        path[at] = tag[: lasting[t]]
        tag[: lasting[t]] = back[at, tag[: lasting[t]]]
    return path


def paths(rows: DataFrame, start: Sequence[float], transitions: Sequence[Sequence[float]], end: Sequence[float]) -> DataFrame:
    """doc_id and path of each row of ``rows`` (doc_id, em), as ``viterbi`` has it, in time linear in the length."""
    fixed = [np.array(x, dtype=float) for x in (start, transitions, end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            em = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(start))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            found = pa.ListArray.from_arrays(offsets, pa.array(decoded(*fixed, sizes, em), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "path"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "em").mapInArrow(run, f"doc_id {kind}, path array<int>")


def _logsumexp(xs: Column) -> Column:
    m = F.array_max(xs)
    return m + F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - m)))


def log_normaliser(start: Column, transitions: Column, end: Column, emissions: Column) -> Column:
    first = F.zip_with(start, F.element_at(emissions, 1), lambda a, b: a + b)

    def step(acc: Column, e: Column) -> Column:
        return F.transform(e, lambda x, j: x + _logsumexp(F.transform(acc, lambda s, i: s + F.element_at(F.element_at(transitions, i + 1), j + 1))))

    return F.aggregate(_steps(emissions), first, step, lambda acc: _logsumexp(F.zip_with(acc, end, lambda a, b: a + b)))


def path_score(start: Column, transitions: Column, end: Column, emissions: Column, tags: Column) -> Column:
    """The score of a given path of tags."""
    own = F.aggregate(F.zip_with(emissions, tags, lambda e, t: F.element_at(e, t + 1)), F.lit(0.0), lambda s, x: s + x)
    n = F.size(tags)
    moves = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.element_at(F.element_at(transitions, F.element_at(tags, i) + 1), F.element_at(tags, i + 1) + 1))).otherwise(F.array().cast("array<double>"))
    return own + F.aggregate(moves, F.lit(0.0), lambda s, x: s + x) + F.element_at(start, F.element_at(tags, 1) + 1) + F.element_at(end, F.element_at(tags, -1) + 1)


def log_likelihood(start: Column, transitions: Column, end: Column, emissions: Column, tags: Column) -> Column:
    return path_score(start, transitions, end, emissions, tags) - log_normaliser(start, transitions, end, emissions)
