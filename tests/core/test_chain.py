import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import chain as C
from sieveline.operators.crf import decoded


def rows(spark, sentences, **columns):
    return C.encoded(spark.createDataFrame(sentences, "sent_id long, tokens array<string>, tags array<string>"), size=64)


def sentences(n, rng):
    """A tag follows from the word, and I only from a B before it."""
    out = []
    for i in range(n):
        tokens, tags = [], []
        for _ in range(rng.randrange(1, 9)):
            w = rng.choice(["fine", "good", "day", "bad", "vile", "thing"])
            tokens.append(w)
            tags.append("B-ABUSE" if w in ("bad", "vile") else "I-ABUSE" if w == "thing" and tags and tags[-1] == "B-ABUSE" else "O")
        out.append((i, tokens, tags))
    return out


def test_expectations_against_all_paths():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 0, 1, 4])
    em, gold = rng.normal(size=(8, 3)), rng.integers(0, 3, 8)
    start, moves, end = rng.normal(size=3), rng.normal(size=(3, 3)), rng.normal(size=3)
    at = want = 0
    for n in sizes:
        if not n:
            continue
        score = lambda p, at=at, n=n: start[p[0]] + end[p[-1]] + sum(em[at + i, p[i]] for i in range(n)) + sum(moves[p[i - 1], p[i]] for i in range(1, n))
        want += score(gold[at : at + n]) - math.log(sum(math.exp(score(p)) for p in itertools.product(range(3), repeat=int(n))))
        at += n
    assert C.expectations(em, sizes, gold, start, moves, end)[0] == pytest.approx(want)


def test_gradient_against_finite_differences(spark):
    """With class weights, tags that are unknown, an empty sentence and one whose tags are too few."""
    some = [*sentences(20, random.Random(1)), (90, [], []), (91, ["a", "b"], ["O"]), (92, None, None), (93, ["bad", None], ["B-ABUSE", "X"])]
    data = rows(spark, some).cache()
    rng = np.random.default_rng(1)
    model = C.Chain.empty(64)
    x = rng.normal(size=len(model.flat())) / 3
    weights = [0.5, 4.0, 2.0]
    loss, gradient = C.loss_and_gradient(data, model.with_flat(x), weights)
    assert loss > 0
    for k in [*np.argsort(-np.abs(gradient))[:4], len(x) - 1, len(x) - 5, len(x) - 14]:
        step = np.zeros(len(x))
        step[k] = 1e-5
        up, down = (C.loss_and_gradient(data, model.with_flat(x + d), weights)[0] for d in (step, -step))
        assert gradient[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_training_learns_and_stops(spark):
    rng = random.Random(2)
    data, held = rows(spark, sentences(300, rng)), rows(spark, sentences(100, rng))
    made = C.train(data, held, C.Chain.empty(64), rounds=24, every=4)
    losses = [loss for _, loss, _ in made.log]
    assert all(b < a for a, b in itertools.pairwise(losses)) and losses[-1] < losses[0] / 10
    seen = [f for *_, f in made.log if f is not None]
    assert max(seen) > 0.99 and len(seen) <= seen.index(max(seen)) + 3  # it stops two looks after the best
    assert C.evaluated(held, made).first().abuse_macro_f1 == pytest.approx(max(seen))
    found = C.tagged(rows(spark, [(1, ["good", "bad", "thing"], None), (2, [], None), (3, ["thing"], None)]), made).collect()
    assert {r.sent_id: r.found for r in found} == {1: [0, 1, 2], 2: [], 3: [0]}


def test_nothing_to_learn_from(spark):
    empty = rows(spark, [(1, [], [])])
    assert C.train(empty, chain=C.Chain.empty(64), rounds=3).flat().sum() == 0
    assert C.token_rows(empty, C.Chain.empty(64)).count() == 0


@pytest.mark.parametrize("width", [1, 30, 900])
def test_steps_of_blocks_against_logs(width):
    """Sentences packed by falling length, scaled: the same as logs, also where probabilities vanish."""
    rng = np.random.default_rng(4)
    sizes = np.array([700, 9, 9, 4, 1, 1])
    em, gold = rng.normal(size=(sizes.sum(), 3)) * width, rng.integers(0, 3, sizes.sum())
    model = C.Chain(np.zeros((8, 3)), rng.normal(size=3) * width, rng.normal(size=(3, 3)) * width, rng.normal(size=3) * width)
    at = C._by_step(np.cumsum(sizes) - sizes, sizes, C._steps(sizes))
    want = C.expectations(em, sizes, gold, model.start, model.moves, model.end)
    got = C.scaled_expectations(em[at].T, sizes, gold[at], model.start, model.moves, model.end)
    assert got[0] == pytest.approx(want[0])
    for a, b in zip(got[1:], (want[1][at].T, *want[2:]), strict=True):
        assert np.allclose(a, b, atol=1e-6)
    assert (C.best_paths(model, sizes, em[at].T) == decoded(model.start, model.moves, model.end, sizes, em)[at]).all()


def test_long_sentences_are_not_run_again_for_each_few_others(spark):
    """Every 500 sentences hold one of 4,000 tokens: a task's sentences go by length, so that the long ones are run together."""
    some = [(i, ["bad", "thing"] * (2000 if i % 500 == 0 else 1), ["B-ABUSE", "I-ABUSE"] * (2000 if i % 500 == 0 else 1)) for i in range(4000)]
    data = rows(spark, some).coalesce(1)
    blocks = C.packed(data)
    assert blocks.count() == 1 and blocks.first().sizes[:9] == [4000] * 8 + [2]
    assert sum(r.n for r in C.confusion(blocks, C.Chain.empty(64)).collect()) == 8 * 4000 + 3992 * 2
    assert C.loss_and_gradient(blocks, C.Chain.empty(64))[0] == pytest.approx(math.log(3))


def test_files_of_blocks_hold_few(spark, monkeypatch):
    """A reader takes all rows of a file at once, and a block has megabytes: files hold a bounded number of them."""
    monkeypatch.setattr(C, "BLOCKS", 1)
    n = C.TOKENS // 2 + 1  # two of such sentences do not go into a block
    rows = spark.range(8).selectExpr(f"array_repeat(1, {C.FEATURES * n}) AS features", f"array_repeat(0, {n}) AS tags")
    blocks = C.blocks_of(rows, "blocks")
    assert [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()] == [1] * 8
    assert C.loss_and_gradient(blocks, C.Chain.empty(64))[0] == pytest.approx(math.log(3))
