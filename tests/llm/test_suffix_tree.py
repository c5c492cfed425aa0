import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import suffix_tree
from sieveline.llm.suffix_tree import score

SCHEMA = "doc_id long, text string, score double, key int"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [""]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    after = {}
    out = [(None, "A b\tc"), (5000, None), (5001, ""), (5002, "É x unseen-word"), (7, "twice twice"), (7, "twice twice")]
    for i in range(900):
        words, w = [], "w0"
        for _ in range(rng.randrange(5, 80)):
            nexts = after.setdefault(w, [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(3)])
            w = rng.choice(nexts) if rng.random() < 0.8 else f"w{rng.randrange(3000)}"
            words.append(w)
        out.append((i, " ".join(words)))
    return out


def test_base_against_brute_force(spark, rows):
    df = spark.createDataFrame([(d, t, 0.0, 1) for d, t in rows], SCHEMA).repartition(3)
    got = score(df).collect()
    train = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(train.values()), len(train)
    want = []
    for d, t in rows:
        x = tokens(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x)
        want.append((str(d), held(d), len(x), sum(train[w] > 0 for w in x), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)


class Slow:
    """The model of the module's description, with dictionaries and one token at a time."""

    def __init__(self, docs, depth=3):
        train = [tokens(t) for d, t in docs if not held(d)]
        self.count = Counter(w for x in train for w in x)
        self.n, often = sum(self.count.values()), max(2, math.ceil(sum(self.count.values()) * suffix_tree.LEAST_WORD))
        self.frequent = {w for w, c in self.count.items() if c >= often and w}
        self.rare_n = sum(c for w, c in self.count.items() if w and w not in self.frequent)
        self.rare_v = sum(1 for w in self.count if w and w not in self.frequent)
        lines = [self.symbols(x) for x in train]
        context_least, pair_least = (max(2, math.ceil(c * (self.n / 2**26) ** (2 / 3))) for c in (1300, 32))
        self.states = {}
        allowed = {s for s, c in Counter(s for x in lines for s in x[1:]).items() if c + (s == "rare") >= context_least and s != "end"} | {"begin"}
        allowed = {(s,) for s in allowed}
        for length in range(1, depth + 1):
            pairs = {}
            for x in lines:
                for i in range(length, len(x)):
                    if x[i - length : i] in allowed:
                        pairs.setdefault(x[i - length : i], Counter())[x[i]] += 1
            new = {c: s for c, f in pairs.items() if (s := self.tested(f, pair_least, lambda x, c=c: self.p(c, x))) is not None}
            allowed = {c + (x,) for c, f in pairs.items() for x, k in f.items() if k >= context_least and x != "end"}
            self.states |= new
        self.rare = {}
        by_word = {}
        for x, line in zip(train, lines):
            for i, w in enumerate(x[:-1]):
                if line[i + 1] == "rare":
                    by_word.setdefault(w, []).append((line[i + 2], self.p(line[: i + 2], line[i + 2])))
        for w, follow in by_word.items():
            f, p = Counter(x for x, _ in follow), {}
            for x, q in follow:
                p.setdefault(x, []).append(q)
            s = self.tested(f, 2, lambda x: sum(p[x]) / len(p[x]))
            if s is not None:
                self.rare[w] = s

    def symbols(self, words):
        return ("begin", *("end" if w == "" else w if w in self.frequent else "rare" for w in words))

    def tested(self, f, least, expected):
        """Shares and the mass that is left, if the divergence pays."""
        total, kept = sum(f.values()), {x: c for x, c in f.items() if c >= least}
        if not kept:
            return None
        gain = sum(c * math.log(c / total / expected(x)) for x, c in kept.items())
        rest = total - sum(kept.values())
        if rest:
            gain += rest * math.log(rest / total / max(1 - sum(map(expected, kept)), 1e-12))
        if gain <= 0.5 * len(kept) * math.log(max(total, 2)):
            return None
        shares = {x: (c - 0.5) / total for x, c in kept.items()}
        return shares, 1 - sum(shares.values())

    def root(self, x):
        if x == "rare":
            return (self.rare_n + 1) / (self.n + 2)
        return (self.count[""] + 1) / (self.n + 2) if x == "end" else self.count[x] / (self.n + 2)

    def p(self, before, x):
        """In the longest retained suffix of what goes before, proper for a context that is not retained yet."""
        for k in range(min(3, len(before)), 0, -1):
            if before[-k:] in self.states:
                shares, left = self.states[before[-k:]]
                return shares.get(x, 0) + left * self.p(before[-k + 1 :] if k > 1 else (), x)
        return self.root(x)

    def score(self, text):
        words = tokens(text)
        line, out = self.symbols(words), 0.0
        for i, w in enumerate(words):
            x, before = line[i + 1], line[: i + 1]
            p = self.p(before, x)
            if before[-1] == "rare" and words[i - 1] in self.rare:
                shares, left = self.rare[words[i - 1]]
                p = shares.get(x, 0) + left * p
            if x == "rare":
                p *= (self.count[w] + 1) / (self.rare_n + self.rare_v + 1)
            out += math.log10(p)
        return out


@pytest.mark.parametrize("least_word", [1e-6, 4e-4])
def test_score_against_brute_force(spark, rows, monkeypatch, least_word):
    monkeypatch.setattr(suffix_tree, "LEAST_WORD", least_word)
    monkeypatch.setattr(suffix_tree, "HELD", 50)
    copied = [*rows, *((2000 + i, f"sole{i} " + " ".join(f"only{i}x{k} {'abc'[k % 3]}" for k in range(20))) for i in range(4)), *((2100 + i, f"sole{i} " + " ".join(f"only{i}x{k} {'abc'[k % 3]}" for k in range(20))) for i in range(4))]
    slow = Slow(copied)
    got = score(spark.createDataFrame([(d, t, 0.0, 1) for d, t in copied], SCHEMA).repartition(3)).collect()
    assert len(slow.states) > 20 and (least_word == 1e-6 or len(slow.rare) > 5)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(d), round(slow.score(t), 6)) for d, t in copied)


def test_more_tokens_give_a_richer_tree():
    sizes = [10**k for k in range(5, 15)]
    bounds = [n / suffix_tree.least(n, suffix_tree.LEAST_PAIR) for n in sizes]
    assert all(b > 1.9 * a for a, b in zip(bounds, bounds[1:])) and bounds[-1] < 10**9


def test_contexts_help_on_held_out_texts(spark):
    rng = random.Random(8)
    step = {i: rng.randrange(50) for i in range(2500)}  # two words decide the next
    docs = []
    for d in range(400):
        x, y, words = rng.randrange(50), rng.randrange(50), []
        for _ in range(60):
            x, y = y, step[x * 50 + y] if rng.random() < 0.9 else rng.randrange(50)
            words.append(f"w{y}")
        docs.append((d, " ".join(words), 0.0, 1))
    got = [r for r in score(spark.createDataFrame(docs, SCHEMA)).collect() if r.held_out]
    assert len(got) > 30
    one, two = (sum(r.score - r.base_score for r in x) / sum(r.n_tokens for r in x) for x in (got, [r for r in score(spark.createDataFrame(docs, SCHEMA), depth=1).collect() if r.held_out]))
    assert one > two + 0.2 and one > 0.5  # log10 a token


def test_probabilities_sum_to_one(spark):
    symbols = [[suffix_tree.FIRST + (i * j) % 7 for j in range(1, 40)] + [suffix_tree.END] for i in range(200)]
    df = spark.createDataFrame([(x,) for x in symbols], "ids array<int>")
    counts = np.bincount(np.concatenate(symbols), minlength=10).astype(float)
    n = int(counts.sum())
    root = counts / (n + 2)
    root[0], root[1] = 1 / (n + 2), (counts[1] + 1) / (n + 2)
    tree = suffix_tree.grow(df, root, n)
    assert len(tree.parent) > 5
    for state in range(len(tree.parent)):
        p = tree.probability(np.full(10, state), np.arange(10))
        assert abs(p.sum() - 1) < 1e-9 and (p[[0, 1, 3]] > 0).all()


def test_refined_distributions_sum_to_one():
    """Under a rare word's own context the next symbols' probabilities are a distribution like the tree's."""
    rng = random.Random(1)
    seen = [rng.choice([3, 3, 3, 4, 5]) for _ in range(30)]
    p = np.array([0.1, 0.2, 0.05, 0.4, 0.25])  # the tree's, of symbols 3 to 7
    follow = np.array(sorted(seen + [3, 4, 5, 6, 7]))
    train = np.array([True] * len(follow))
    for x in range(3, 8):  # one row of each symbol is only asked
        train[np.flatnonzero(follow == x)[0]] = False
    pair = np.flatnonzero(np.concatenate([[True], follow[1:] != follow[:-1]]))
    got = suffix_tree._refined(np.full(len(follow), 30), np.array([0]), pair, train, p[follow - 3])
    assert abs(got[pair].sum() - 1) < 1e-12 and got[pair][0] > 0.4


def test_depth_is_honoured(spark):
    with pytest.raises(ValueError):
        score(spark.createDataFrame([(1, "a b", 0.0, 1)], SCHEMA), depth=4)


def test_longest_suffix_state(spark):
    t = suffix_tree
    key = lambda *s: sum(x << t.BITS * (len(s) - 1 - i) for i, x in enumerate(s))
    tree = t.Tree(np.ones(9) / 9, [np.array([4, 5]), np.array([key(4, 5)]), np.array([], np.int64)], [np.array([1, 2]), np.array([3]), np.array([], np.int64)], np.array([0, 0, 0, 2]), np.ones(4), np.empty(0, np.int64), np.empty(0))
    line, sizes = np.array([t.BEGIN, 4, 5, 6, 1, t.BEGIN, 5, 1]), np.array([5, 3])
    assert tree.state(line, sizes).tolist() == [0, 0, 1, 3, 0, 0, 0, 2]


def test_empty(spark):
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0
