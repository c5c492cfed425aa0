import hashlib
import random
import re

import pytest

from sieveline.llm import exact_dedup as exact_dedup_module
from sieveline.llm.exact_dedup import PRIMES, combine, exact_dedup, fingerprint, keep_first

SCHEMA = "doc_id long, text string, row string, bytes int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        known = [x for x in g if x is not None]
        keep = min(known) if known else None
        out.append((d, keep, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a  b"), (2, "a\tb"), (3, "a\u00a0b"), (4, None), (5, ""), (6, "   "), (7, " "), (None, "a b"), (9, "é" * 300), (8, "é" * 300), (10, "x y\n" * 4000), (11, "x y " * 4000), (12, "x y " * 4000 + "z")]


@pytest.mark.parametrize("huge", [8 << 20, 100])
@pytest.mark.parametrize("primes", [PRIMES, (3, 5, 7)])
def test_against_brute_force(spark, huge, primes):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, "".join(rng.choice("ab \n") for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = exact_dedup(df, primes, huge).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id is not None)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "x", 1)] * 3 + [(2, "a", "y", 1), (None, None, None, None)], SCHEMA)
    got = exact_dedup(df).collect()
    assert sorted(r.kept for r in got) == [False, False, False, True, True]
    assert sorted((r.doc_id or 0, r.text) for r in keep_first(df).collect()) == [(0, None), (1, "a")]
    assert exact_dedup(df.limit(0)).count() == 0
    assert keep_first(df).columns == df.columns


def test_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, "a b"), (None, "a  b"), (5, "c d"), (5, "c  d"), (5, "other"), (None, None), (None, "")]
    df = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], "doc_id long, text string, __d string, __n int, stays int, row string")
    out = keep_first(df)
    assert out.columns == df.columns
    assert sorted(" ".join((r.text or "").split()) for r in out.collect()) == ["", "a b", "c d", "other"]
    got = exact_dedup(df).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(1, True), (2, False), (2, False), (2, False), (2, True), (2, True), (2, True)]


def test_large_groups_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "GROUP_PART", 16)
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i % 30}") for i in range(120)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = exact_dedup(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)


def test_fingerprints_compose():
    text = random.Random(2).randbytes(5000)
    whole = fingerprint(text, chunk=10**9)
    assert whole == fingerprint(text, chunk=7)
    left, right = fingerprint(text[:1234]), fingerprint(text[1234:])
    assert [combine(a, b, p) for a, b, p in zip(left, right, PRIMES)] == whole
