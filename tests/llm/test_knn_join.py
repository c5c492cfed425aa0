import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.llm.knn_join import knn_join

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k=5):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    data = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out, seen = [], set()
    for q, v in sorted(data):
        if q % 50 or q in seen:
            continue
        seen.add(q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, d, seed=1):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 4
    return [(i, np.float32(centres[i % 6] + rng.normal(size=d) * 0.2).tolist()) for i in range(n)]


@pytest.mark.parametrize(("part", "queries"), [(16384, 1024), (300, 7)])
def test_against_brute_force(spark, part, queries):
    rows = vectors(1200, 5) + [(5000 + i, [1.0] * 5) for i in range(60)] + [(None, [9.0] * 5), (6000, None), (6001, [None] * 5), (6002, [float("nan")] * 5), (6003, [float("inf")] * 5), (6050, [1.0, 2.0]), (6051, [3.0, 1.0]), (6100, []), (7, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    got = knn_join(df, F.col("vec_id") % 50 == 0, part=part, queries=queries).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**19 for _ in range(3)]) for i in range(60)]
    import numpy as np

    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn_join(df, F.col("vec_id") % 50 == 0).collect()) == brute(rows)


def test_scores_beyond_a_long_rank_by_their_exact_value(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1, -1]) * 10.0 ** rng.choice([0, 20, 21, 300]) * rng.random() for _ in range(2)]) for i in range(80)] + [(80, [1e308, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA.replace("float", "double"))
    got = knn_join(df, F.col("vec_id") % 50 == 0).collect()
    fit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = [(q, r, i, fit(s)) for q, r, i, s in brute([x for x in rows if x[0] != 80])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_vectors_far_from_all_queries_are_not_dealt(spark):
    """Two far clusters: the bounds keep the second one's vectors out, whatever the parts."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, (np.array([100.0, 0, 0]) * (1 if i % 50 == 0 or i % 3 else -1) + rng.normal(size=3)).tolist()) for i in range(2000)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = knn_join(df, F.col("vec_id") % 50 == 0, queries=5, part=100).collect()
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [0.5, 0.5], 1, "x")], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in knn_join(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    none = knn_join(df.limit(0), F.col("vec_id") % 50 == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
