import random

import numpy as np
import pytest

from sieveline.operators import subwords as S


def cosine(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def corpus(rng):
    letters = "abcdefghijklmnopqrstuvwxyz"
    topics = [["".join(rng.choice(letters) for _ in range(rng.randrange(7, 11))) for _ in range(12)] for _ in range(3)]
    return topics, [[*rng.choices(topics[k % 3], k=12)] for k in range(600)]


@pytest.fixture(scope="module")
def made(spark):
    topics, sentences = corpus(random.Random(5))
    df = spark.createDataFrame([(s,) for s in [*sentences, None, [], [None, "once"]]], "tokens array<string>").repartition(3)
    return topics, S.train(df, size=32, rounds=4, sample=1.0, negatives=5, buckets=1 << 12)


def test_words_of_a_topic_are_near_each_other(made):
    topics, model = made
    assert set(model.words) == {w for t in topics for w in t}  # what occurs once is left out
    v = {w: model.vector(w) for w in model.words}
    same = [cosine(v[a], v[b]) for t in topics for a in t for b in t if a < b]
    other = [cosine(v[a], v[b]) for i, t in enumerate(topics) for u in topics[i + 1 :] for a in t for b in u]
    assert np.mean(same) > np.mean(other) + 0.2


def test_misspelt_words_find_the_word(spark, made):
    topics, model = made
    words = sorted(model.words)
    rows = spark.createDataFrame([(w[:3] + w[4:], w) for w in words] + [("", None), (None, None)], "word string, own string")
    found = S.word_vectors(rows, model).collect()
    assert not any(r.in_vocab for r in found) and len(found) == len(words) + 2
    every = np.stack([model.vector(w) for w in words])
    hits = [words[int(np.argmax([cosine(np.array(r.vector), x) for x in every]))] == r.own for r in found if r.own]
    assert np.mean(hits) >= 0.6  # 0.75 of 36 words as measured: the words of a topic, which always stand together, come close; chance is 0.03
    assert S.word_vectors(rows.selectExpr("own AS word").where("word IS NOT NULL"), model).where("NOT in_vocab").count() == 0


def test_gradient_against_finite_differences():
    """One step changes a word's vector along the gradient of the negative-sampling likelihood."""
    rng = np.random.default_rng(2)
    model = S.Embedding({"abcd": 0, "efgh": 1}, np.array([3.0, 3.0]), rng.normal(size=(64 + 2, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), 64)
    learner = S._Learner(model, 2, 3, 1.0, 1e-3, np.random.default_rng(0))
    drawn = np.searchsorted(learner.drawn, np.random.default_rng(0).random((1, 3)) * learner.drawn[-1])[0]
    own = model.vector("abcd").astype(float)

    def likelihood(x):
        score = lambda k: 1 / (1 + np.exp(-x @ model.outputs[k]))
        return np.log(score(1)) + sum(np.log(1 - score(k)) for k in drawn if k != 1)

    want = [(likelihood(own + d) - likelihood(own - d)) / 2e-4 for d in np.eye(4) * 1e-4]
    learner.step(np.array([0]), np.array([1]))
    at = 64 + 0
    assert (learner.rows[at] - model.rows[at]) / 1e-3 == pytest.approx(want, rel=0.02, abs=0.02)


def test_nothing_to_learn_from(spark):
    model = S.train(spark.createDataFrame([(None,), (["a"],)], "tokens array<string>"), size=8, buckets=64)
    assert not model.words and S.word_vectors(spark.createDataFrame([("word",)], "word string"), model).first().in_vocab is False


def test_pairs_of_a_place_are_one_change():
    """A word's n-grams are read and changed once for all its pairs of a place, by the sum of what each pair alone gives."""
    rng = np.random.default_rng(2)
    words = {"abcd": 0, "efgh": 1, "abcx": 2}
    model = S.Embedding(words, np.array([3.0, 3.0, 3.0]), rng.normal(size=(64 + 3, 4)).astype(np.float32), rng.normal(size=(3, 4)).astype(np.float32), 64)
    learner = lambda: S._Learner(model, 2, 0, 1.0, 1e-3, np.random.default_rng(0))
    both, one, other = learner(), learner(), learner()
    both.step(np.array([0, 0]), np.array([1, 2]), np.array([5, 5]))
    one.step(np.array([0]), np.array([1]))
    other.step(np.array([0]), np.array([2]))
    assert both.rows - model.rows == pytest.approx(one.rows + other.rows - 2 * model.rows, abs=1e-6)
    assert (both.row_counts == one.row_counts).all()
    place, centre, context = S._pairs(np.arange(40), np.repeat([0, 1], 20), 3, rng)
    assert len(set(place)) == 40 == 1 + (place[1:] != place[:-1]).sum() and (place == centre).all()
    assert (abs(centre - context) <= 3).all() and (centre // 20 == context // 20).all()


def test_rows_that_repeat_are_damped():
    table, counts = np.zeros((4, 2)), np.zeros(4, np.int64)
    S._added(table, np.array([2, 0, 2, 3]), np.array([[1.0, 2], [3, 4], [5, 6], [7, 8]]), counts)
    assert table == pytest.approx(np.array([[3, 4], [0, 0], np.array([6, 8]) / 2**0.5, [7, 8]])) and counts.tolist() == [1, 0, 2, 1]
