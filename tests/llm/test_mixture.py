import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sieveline.llm.mixture import apportion, mix, mixed, targets


def slow_apportion(votes, seats, caps=None):
    out = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if votes[i] > 0 and (caps is None or out[i] < caps[i])]
        if not free:
            break
        out[max(free, key=lambda i: (Fraction(votes[i]) / (2 * out[i] + 1), -i))] += 1
    return out


def test_apportionment_against_one_seat_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        votes = rng.integers(0, 30, n).tolist()
        seats = int(rng.integers(0, 40))
        caps = rng.integers(0, 15, n).tolist() if rng.random() < 0.5 else None
        assert apportion(votes, seats, caps).tolist() == slow_apportion(votes, seats, caps)


def test_targets_stop_at_twice_the_size():
    got = targets([10, 1000, 1000], [3, 1, 2])
    assert got[0] == 20 and sum(got) == Fraction(3, 2) * 2010 and got[1:] == [Fraction(2995, 3), Fraction(5990, 3)]
    assert targets([], []) == [] and targets([0, 0], [3, 1]) == [0, 0]


SCHEMA = "doc_id long, text string, source string, n_chars long, size int, row int, `of_row` int, whole int, parts int, __words int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 0, 1, 2, 3, 4, 5, 6) for d, t, s in rows], SCHEMA)


def rows():
    out = [(i, "w" + " x" * (i * 7 % 900), ["a", "b", None, "c"][i % 4 if i % 5 else 0]) for i in range(400)]
    return [*out, (None, None, None), (900, "", "d"), (7, "one two", "a"), (7, "one two", "a")]


def goals(rows):
    """Targets by water level: an independent reading of the contract."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, low, high = 1.5 * sum(sizes.values()), 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(min(2 * sizes[s], weight[s] * mid) for s in names) >= total else (mid, high)
    return {s: min(2 * sizes[s], weight[s] * high) for s in names}, sizes


def test_mix(spark):
    df = frame(spark, rows())
    got = mix(df).collect()
    again = mix(df.repartition(5)).collect()
    key = lambda r: str((r.doc_id, r.source, r["size"], r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows())
    want, sizes = goals(rows())
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and abs(r.target - want[r.source]) < 1e-3 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 250])
def test_small_tables(spark, n):
    """Sources of a few words are mixed like large ones."""
    rows = [(i, " ".join(["x"] * (1 + i * 3 % 7)), f"s{i % 4}") for i in range(n)]
    got, (want, _) = mix(frame(spark, rows)).collect(), goals(rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_words_of_a_shard_against_a_walk(spark):
    """Blocks of a shard are taken in a seeded order, word by word, until the quota is met."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"t{i}_{k}" for k in range(rng.randrange(1, 40))), "a") for i in range(60)]
    out = [r.text.split() for r in mixed(frame(spark, rows), block=8).collect()]
    times = Counter(w for x in out for w in x)
    total = sum(len(t.split()) for _, t, _ in rows)
    assert sum(times.values()) == round(1.5 * total) and set(times.values()) <= {1, 2} and len(times) == total
    more = mix(frame(spark, rows), block=8).collect()
    assert {r.doc_id: r.taken for r in more} == {d: sum(times[w] for w in t.split()) for d, t, _ in rows}
    # what is taken twice lies in whole blocks of eight neighbouring words of the shard's order, but for one block's head
    twice = {d: [times[w] == 2 for w in t.split()] for d, t, _ in rows}
    changes = sum(a != b for x in twice.values() for a, b in zip(x, x[1:]))
    assert changes <= 2 * (total // 8 + 1)


def test_mixed_rows_hold_what_is_taken(spark):
    df = frame(spark, rows())
    out = mixed(df)
    assert out.columns == df.columns
    texts = out.collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r.taken for r in mix(df).collect())
    assert sorted(r.text for r in texts) == sorted(r.text for r in mixed(df.repartition(3)).collect())


def test_repeated_ids_keep_their_texts_on_reruns(spark):
    rng = random.Random(2)
    rows = [(i % 3, " ".join(rng.choice("abc") for _ in range(20)), "s") for i in range(60)]
    runs = [sorted(r.text for r in mixed(frame(spark, rng.sample(rows, 60)).repartition(k)).collect()) for k in (1, 4)]
    assert runs[0] == runs[1]


def test_empty(spark):
    df = frame(spark, [])
    assert mix(df).count() == 0 and mixed(df).count() == 0
    assert mix(frame(spark, [(1, None, None), (2, "", "a")])).toPandas().taken.tolist() == [0, 0]
