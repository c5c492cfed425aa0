import random

from pyspark.sql import functions as F

from sieveline.llm.rolling import rolling_features

SCHEMA = "id long, k string, s long, len long, lang string, key int, features string"
WIDTHS = [180, 600]


def brute(rows):
    out = {}
    for i, k, s, *_ in rows:
        for w in WIDTHS:
            held = [r for r in rows if s is not None and r[2] is not None and r[1] == k and s - w <= r[2] < s]
            lengths = sorted(r[3] for r in held if r[3] is not None)
            at = lambda p, q: lengths[-(-p * len(lengths) // q) - 1] if lengths else None  # noqa: E731, B023
            out[i, w] = (len(held), sum(lengths), len({r[4] for r in held if r[4] is not None}), at(1, 2), at(75, 100))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    made = rolling_features(df.withColumnRenamed("features", "label"), F.col("k"), F.col("s"), F.col("len"), F.col("lang"), WIDTHS)
    assert made.columns == ["id", "k", "s", "len", "lang", "key", "label", "features"]
    rows = made.select("id", F.inline("features")).collect()
    return {(r.id, r.window_s): (r.n_events, r.sum_chars, r.n_langs, r.median_chars, r.high_chars) for r in rows}


def test_against_brute_force(spark):
    """A hot key and minute, null keys, times, lengths and languages, repeated rows, times before zero."""
    rng = random.Random(7)
    rows = []
    for i in range(500):
        key = rng.choice(["a", "a", "a", "b", "", None])
        seconds = None if i % 60 == 0 else 60 * rng.randrange(-20, 40)
        rows.append((i, key, seconds, rng.choice([None, 0, 5, 5, rng.randrange(1000)]), rng.choice([None, "x", "y", "z"]), 1, "f"))
    rows += [(1000 + i, "a", 600, rng.randrange(50), "x", 1, "f") for i in range(1500)]
    assert found(spark, rows) == brute(rows)


def test_an_empty_table(spark):
    assert found(spark, []) == {}


def test_rows_without_any_length_or_time(spark):
    rows = [(1, "a", 0, None, None, 1, "f"), (2, "a", 60, None, None, 1, "f"), (3, "a", None, 9, "x", 1, "f")]
    assert found(spark, rows) == brute(rows)
