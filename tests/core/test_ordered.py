import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import evaluate, spans
from sieveline.operators.ordered import Ordered
from sieveline.sources import commits


def test_before_over_parts_with_a_hot_key(spark):
    """One key has most rows and lies in many parts; null keys, null values and negative ones."""
    rng = random.Random(5)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", i, None if i % 5 == 0 else rng.randint(-50, 50)) for i in range(900)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = Ordered(spark.createDataFrame(rows, "key string, at int, value int").repartition(3), ["key"], ["at"])
        parts = made.rows.where("key = 'hot'").select(F.shiftright(made.place, 33)).distinct().count()
        assert parts > 1
        got = made.with_before("most", F.col("value")).with_before("n", F.lit(1), "sum").with_before("total", F.col("value"), "sum").result()
        found = {(r.key, r.at): (r.most, r.n, r.total) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.columns == ["key", "at", "value", "most", "n", "total"]
    seen, want = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        old = seen.setdefault(k, [])
        known = [x for x in old if x is not None]
        want[k, at] = (max(known, default=None), len(old), sum(known))
        old.append(v)
    assert found == want


def test_intervals_of_one_hot_document(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 4 else f"d{i % 5}", a := rng.randint(0, 6000), a + rng.randint(1, 9)) for i in range(1500)]
    rows += rows[:100] + [("hot", None, 4), ("hot", 4, None), (None, 1, 2), (None, 2, 5)]
    got = sorted((r.doc or "", r.start, r.end) for r in spans.merged_intervals(spark.createDataFrame(rows, "doc string, start int, end int"), "doc").collect())
    want = []
    for k, a, b in sorted(((k or "", a, b) for k, a, b in rows if a is not None and b is not None)):
        if want and want[-1][0] == k and a <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(b, want[-1][2]))
        else:
            want.append((k, a, b))
    assert got == want


def test_batches_and_stale_epochs_keep_columns_of_the_same_names(spark):
    df = spark.createDataFrame([("x", i, "a", "b") for i in range(120)] + [("y", 3, "a", "b")], "key string, number int, place string, part string")
    got = spans.batches(df, "key", ["number"])
    assert got.columns == [*df.columns, "batch"]
    assert all(r.batch == (r.number // 50 if r.key == "x" else 0) and r.place == "a" for r in got.collect())
    log = spark.createDataFrame([(e, v, "at") for e, v in enumerate([None, 0.4, 0.3, 0.6])], "epoch int, f1 double, at string")
    rows = evaluate.with_best_so_far(log, "epoch", "f1").orderBy("epoch").collect()
    assert [r.best for r in rows] == [None, 0.4, 0.4, 0.6] and [r.stale for r in rows][1:] == [0, 1, 0]
    assert {r["at"] for r in rows} == {"at"}
    assert spans.batches(df.limit(0), "key", ["number"]).collect() == []


def test_appends_are_whole_or_absent(spark, tmp_path):
    folder = f"{tmp_path}/log"
    df = spark.createDataFrame([('a,"b"\nc', 1), ("", None), (None, 3)], "text string, n int")
    assert [commits.append_csv(df, folder) for _ in range(2)] == [1, 2]
    fails = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("text"), F.when(F.col("id") < 39, 1).otherwise(F.raise_error(F.lit("lost")).cast("int")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        commits.append_csv(fails, folder)
    with pytest.raises(ValueError, match="columns"):
        commits.append_csv(df.select("n", "text"), folder)
    got = commits.read_appended(spark, folder, "text string, n int").collect()
    key = lambda r: (r[0] is None, r[0] or "", r[1] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, df.collect() * 2), key=key)
    assert commits.read_appended(spark, folder).columns == ["text", "n"]
    heads = [f for f in tmp_path.rglob("*.csv") if '"text","n"' in f.read_text()]
    assert len(heads) == 1 and not list((tmp_path / "log" / "_staged").iterdir())
    commits.sweep(spark, folder)
    assert commits.read_appended(spark, f"{tmp_path}/none", "n int").collect() == []


def test_checkpoints_best_last_and_by_epoch(spark, tmp_path):
    folder = f"{tmp_path}/model"
    scores = [0.2, 0.5, 0.4, float("nan")]
    assert [commits.save_checkpoint(spark, folder, i, {"w": np.array([float(i)])}, s) for i, s in enumerate(scores)] == [True, True, False, False]
    assert [commits.load_checkpoint(spark, folder, k)["w"][0] for k in ("best", "last", "epoch_0")] == [1.0, 3.0, 0.0]
    with pytest.raises(ValueError):
        commits.save_checkpoint(spark, folder, 2, {"w": np.array([9.0])}, 1.0)
    with pytest.raises(ValueError):
        commits.load_checkpoint(spark, f"{tmp_path}/empty")
