import random

import xxhash
import pytest
from pyspark.sql import functions as F

from sieveline.llm.components import components
from sieveline.llm.simhash_dedup import BKTree, keep_one, links, masks, simhash, simhash_dedup

SCHEMA = "doc_id long, text string, print string, root int"


def slow_hash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {x: find(x) for x in keys}


def rows():
    rng = random.Random(4)
    out = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one two"), (6, "ONE\ttwo"), (7, "É x y z"), (None, "one two"), (None, "alone here now"), (7, "É x y z")]
    base = [rng.choice(["the", "of", "an", "x"]) + str(rng.randrange(30)) for _ in range(400)]
    for i in range(80):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = "z"
        out.append((100 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("most", [1024, 3])
def test_against_brute_force(spark, most):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows()], SCHEMA).repartition(3)
    got = simhash_dedup(df, most=most).collect()
    of = classes([slow_hash(t) for _, t in rows()])
    least = {}
    for d, t in rows():
        if d is not None:
            c = of[slow_hash(t)]
            least[c] = min(d, least.get(c, d))
    want = [(str(d), slow_hash(t), str(least.get(of[slow_hash(t)]))) for d, t in rows()]
    assert sorted((str(r.doc_id), r.print % 2**64, str(r.component_id)) for r in got) == sorted(want)


def test_shingle_hash_is_the_engines(spark):
    text = "ça va très bien"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)
    long = " ".join(str(i * i) for i in range(70000))
    assert simhash(long.encode()) == slow_hash(long)


@pytest.mark.parametrize("most", [1024, 2])
def test_links_join_what_all_pairs_join(spark, most):
    rng = random.Random(9)
    keys = {0, 2**64 - 1}
    for _ in range(30):
        k = rng.getrandbits(64)
        for _ in range(5):
            keys.add(k)
            k ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    df = spark.createDataFrame([(k - 2**64 if k >> 63 else k,) for k in keys], "print long")
    roots = {r.node % 2**64: r.root % 2**64 for r in components(links(df, most=most)).collect()}
    got, want = {}, {}
    for k in keys:
        got.setdefault(roots.get(k, k), set()).add(k)
    for k, r in classes(keys).items():
        want.setdefault(r, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_tree_follows_edges_within_the_radius():
    rng = random.Random(2)
    keys = [rng.getrandbits(10) for _ in range(200)]
    tree = BKTree()
    for k in keys:
        tree.add(k)
    for k in range(0, 1024, 37):
        assert sorted(tree.within(k, 2)) == sorted({x for x in keys if (x ^ k).bit_count() <= 2})


def test_long_chain_and_empty(spark):
    chain = spark.range(200).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert simhash_dedup(none).count() == 0 and keep_one(none).columns == none.columns


def test_keep_one(spark):
    df = spark.createDataFrame([(2, "a b c d", "x", 1), (1, "A b  c d", "y", 1), (1, "A b  c d", "y", 1), (3, "other words are here", "x", 1), (None, "a b c d", "x", 1)], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in keep_one(df).collect()) == [(1, "A b  c d"), (3, "other words are here")]


def test_keep_one_without_ids_and_with_clashing_names(spark):
    rows = [(None, "a b c d e"), (None, "A b c  d e"), (None, "quite other words are here"), (4, "x y z"), (4, "something else again now")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, row int, stays int")
    assert sorted(r.text.lower()[:3] for r in keep_one(df).collect()) == ["a b", "qui", "som", "x y"]


@pytest.mark.parametrize("n", [10, 10**4, 10**7, 10**10])
@pytest.mark.parametrize("radius", [2, 4])
def test_masks_share_one_for_keys_within_the_radius(n, radius):
    rng = random.Random(n)
    found = masks(n, radius, 1024)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not flips & m for m in found)
    assert n / 2 ** min(m.bit_count() for m in found) <= 2 * 256
