"""Exact top-k search by inner product as a Voronoi kNN join.

Maximal inner products are least distances once each vector gets one more component: ``sqrt(M - |x|^2)`` for the data, 0 for the
queries, M being the greatest ``|x|^2``; then ``|q - x|^2 = |q|^2 + M - 2 q.x``.  Data and queries go to the cell of their nearest
pivot; there are about as many pivots as the square root of the vectors.  The cells are gathered to groups of queries around
leading pivots.  From the summaries (the radius of a group's queries, the least distances in each cell) follows a bound on the
distance of a query's k-th neighbour; a vector is replicated only to the groups whose bound its distance, by the triangle
inequality, may meet.  What each group gets is counted first, so that groups are solved in parts of about PART vectors and
QUERIES queries, and a vector travels only to as many parts as its own group has.  Parts are merged.

Components are integers, ``floor(scale * x)``; products are summed in 64-bit floats while those are exact, else in Python's
integers.  Pivots are chosen from SAMPLE vectors, a documented bound; they only steer the grouping, the result is exact.  Vectors
of the commonest length are joined so; those of any other length, and all vectors if some are too large for sums of squares, meet
the queries of their length in parts without pivots.

Defined results: vectors that are null, or hold a component that is null or not finite (as ``scale * x``), and rows without a
vec_id take no part; rows with a query's vec_id are its own and no candidates; of rows that repeat a query's vec_id the least
vector asks; vectors meet only those of the same length; ties go to the smaller vec_id; a score beyond 64 bits ranks by its exact
value and shows as the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import cut

SAMPLE = 4096
#: The most pivots and groups of queries that summaries are held for.
MOST_PIVOTS, MOST_GROUPS = 2048, 256
#: Vectors and queries of a part, on average.
PART, QUERIES = 16_384, 1024
#: Sums of squares above this leave the range in which distances are any guide.
LARGE = 1e30
_SLACK = 1e-6
_WIDE = 1 << 2200


def _pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the farthest from those before it."""
    chosen = [int(np.argmax((rows**2).sum(1)))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(rows)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    at, far = np.empty(len(rows), np.int64), np.empty(len(rows))
    for a in range(0, len(rows), 4096):
        d = _distances(rows[a : a + 4096], pivots)
        at[a : a + 4096], far[a : a + 4096] = d.argmin(1), d.min(1)
    return at, far


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def _matrix(batch: pa.RecordBatch, k: int, width: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _raised(x: np.ndarray, query: bool, most: float) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x**2).sum(1), 0))
    return np.concatenate([x, extra[:, None]], axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The best k candidates of each row of scores; ids ascend."""
    wide = min(len(ids), k)
    for row in range(len(scores)):
        s, other = scores[row], ids != own[row]
        if not other.all():
            s = s[other]
        place = np.flatnonzero(other)
        if not len(s):
            continue
        least = np.partition(s, len(s) - wide)[max(0, len(s) - wide)]
        top = np.flatnonzero(s >= least)
        top = top[np.argsort(-s[top], kind="stable")][:k]
        yield row, place[top]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return q @ x.T
    whole = lambda m: np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object)
    return whole(q).dot(whole(x).T)


def _solve(k: int):
    """The best k of each query of a part: query_id, vec_id, score, and ``big``, the exact score in order, if a long is too short."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, bytes | None]] = []
        if len(queries) and len(data):
            data = data.sort_values("vec_id", kind="stable")
            ids, x = data["vec_id"].to_numpy(), np.stack(data["v"].to_numpy())
            asked = queries["vec_id"].to_numpy()
            q = np.stack(queries["v"].to_numpy())
            wide = queries["wide"].iloc[0]
            for a in range(0, len(q), 256):
                scores = products(q[a : a + 256], x)
                for row, top in _best(scores, ids, asked[a : a + 256], k):
                    for i in top:
                        s = int(scores[row, i])
                        big = (s + _WIDE).to_bytes(276, "big") if wide else None
                        out.append((int(asked[a + row]), int(ids[i]), max(-(1 << 63), min((1 << 63) - 1, s)), big))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "big"])

    return run


def _whole(vector: Column, scale: int) -> Column:
    """The components as integral floats; beyond 2^52 every float is integral as it is."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))


def knn_join(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, part: int = PART, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row that ``asks`` (a condition on vec_id) names."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(F.lit(float(scale)) * x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    rows = cut(rows.select("vec_id", _whole(v, scale).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).withColumn("width", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    known = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.max(norm).alias("most"))
    top = known.orderBy(F.desc("n"), "width").first()
    if top is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    by_pivots = top.most < LARGE and top.width > 0 and top.asked > 0
    others = rows.where(F.col("width") != top.width) if by_pivots else rows
    out = _compared(others, known, k, part, queries)
    if by_pivots:
        out = out.unionByName(_joined(rows.where(F.col("width") == top.width), top.width, top.n, top.asked, top.most, k, part, queries))
    order = Window.partitionBy("query_id").orderBy(F.desc("big"), F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _asking(rows: DataFrame) -> DataFrame:
    """One query for each vec_id and width."""
    return rows.where("asks").groupBy("vec_id", "width").agg(F.min("v").alias("v"))


def _met(queries: DataFrame, data: DataFrame, by: list[str], k: int) -> DataFrame:
    kind = "query_id long, vec_id long, score long, big binary"
    return queries.groupBy(*by).cogroup(data.groupBy(*by)).applyInPandas(_solve(k), kind)


def _compared(rows: DataFrame, known: DataFrame, k: int, part: int, queries: int) -> DataFrame:
    """All queries against all vectors of their width, dealt in parts by the counts of each width."""
    plan = known.where("asked > 0").select(F.col("width").alias("w"), F.ceil(F.col("n") / part).cast("int").alias("parts"), F.ceil(F.col("asked") / queries).cast("int").alias("turns"), (F.col("most") >= 2.0**62).alias("wide"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    data = rows.join(plan, F.col("width") == F.col("w")).select("vec_id", "v", F.col("width").alias("group"), mine("parts").alias("salt"), spread("turns").alias("turn"))
    asked = _asking(rows).join(plan, F.col("width") == F.col("w")).select(F.col("vec_id").alias("asked"), F.col("v").alias("asked_v"), F.col("width").alias("group"), "wide", mine("turns").alias("turn"), spread("parts").alias("salt"))
    return _met(asked.withColumnsRenamed({"asked": "vec_id", "asked_v": "v"}), data, ["group", "salt", "turn"], k)


def _joined(rows: DataFrame, width: int, n: int, asked: int, most: float, k: int, part: int, queries: int) -> DataFrame:
    sample = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    wanted = min(MOST_PIVOTS, math.ceil(n**0.5))
    pivots = _pivots(_raised(np.stack(sample["v"].to_numpy()).reshape(len(sample), width), False, most), wanted)
    # the first pivots lie far apart: they lead the groups, and each cell belongs to the nearest of them
    leaders = pivots[: min(MOST_GROUPS, max(1, -(-asked // queries)))]
    apart = _distances(leaders, pivots)
    group_of = apart.argmin(0)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group the radius of its queries around the leader and their number; per cell its data's least k + 1 distances."""
        radius, number, near = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64), [np.empty(0)] * len(pivots)
        for batch in batches:
            x, asks = _matrix(batch, 0, width), batch.column(1).to_numpy(zero_copy_only=False)
            q = _raised(x[asks], True, most)
            group = group_of[_nearest(q, pivots)[0]]
            np.maximum.at(radius, group, np.sqrt(((q - leaders[group]) ** 2).sum(1)))
            np.add.at(number, group, 1)
            at, far = _nearest(_raised(x, False, most), pivots)
            for j in np.unique(at):
                near[j] = np.sort(np.concatenate([near[j], far[at == j]]))[: k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pivots)), pa.int32()), pa.array(radius), pa.array(number), pa.array([x.tolist() for x in near], pa.list_(pa.float64()))], names=["at", "radius", "asked", "near"])

    parts = rows.select("v", "asks").mapInArrow(summary, "at int, radius double, asked long, near array<double>")
    found = parts.groupBy("at").agg(F.max("radius").alias("radius"), F.sum("asked").alias("asked"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).toPandas().sort_values("at")
    radius, number, near = found["radius"].to_numpy()[: len(leaders)], found["asked"].to_numpy()[: len(leaders)], found["near"].tolist()
    slack = _SLACK * (1 + float(most) ** 0.5)
    bound = np.full(len(leaders), np.inf)
    for i in range(len(leaders)):
        far = np.sort(np.concatenate([radius[i] + apart[i, j] + np.asarray(near[j], float) for j in range(len(pivots))]))
        if len(far) > k:
            bound[i] = far[k] + slack  # one more than k, since a query's own row may be among them

    def needed(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Which of the vectors each group with queries may need."""
        at, far = _nearest(_raised(x, False, most), pivots)
        for i in np.flatnonzero(radius >= 0):
            gap = np.abs(apart[i, at] - far) - radius[i]
            yield int(i), np.flatnonzero(gap <= bound[i])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(leaders), np.int64)
        for batch in batches:
            for i, here in needed(_matrix(batch, 0, width)):
                sums[i] += len(here)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(leaders)), pa.int32()), pa.array(sums)], names=["at", "n"])

    dealt = rows.select("v").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")["n"].to_numpy()
    salts, turns = np.maximum(1, -(-dealt // part)), np.maximum(1, -(-number // queries))
    schema = pa.schema([("group", pa.int32()), ("salt", pa.int32()), ("turn", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def deal(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, hashed, x = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch, 2, width)
                if query:
                    group = group_of[_nearest(_raised(x, True, most), pivots)[0]]
                    given = [(int(i), np.flatnonzero(group == i)) for i in np.unique(group)]
                else:
                    given = needed(x)
                for i, here in given:
                    own = hashed[here] % (turns[i] if query else salts[i])
                    for other in range(salts[i] if query else turns[i]):
                        salt, turn = (np.full(len(here), other), own) if query else (own, np.full(len(here), other))
                        if len(here):
                            take = pa.array(here)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), i), pa.int32()), pa.array(salt, pa.int32()), pa.array(turn, pa.int32()), ids.take(take), batch.column(2).take(take)], schema=schema)

        return run

    kind = "group int, salt int, turn int, vec_id long, v array<double>"
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)).alias("h")
    data = rows.select("vec_id", hashed, "v").mapInArrow(deal(False), kind)
    asking = _asking(rows).select("vec_id", hashed, "v").mapInArrow(deal(True), kind).withColumn("wide", F.lit(bool(most >= 2.0**62)))
    return _met(asking, data, ["group", "salt", "turn"], k)
