import hashlib
import random
import re

from sieveline.llm.secret_scan import RULES, Rule, digest, scan

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def texts():
    rng = random.Random(5)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", '"', "' ", "é😀", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4, "abc", "x y", "\n", "ſecret", "toKen", "abcdef0", "-", "passwd = "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "token=abcdefgh"), (9000, None), (9001, ""), (9002, "token = token: abcdefgh"), (9003, "é " * 30000 + "AKIA" + "X" * 20), (7, "token=abcdefgh"), (7, "token=abcdefgh")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, blob string")
    got = digest(scan(df)[0]).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.id), r.spans) for r in got) == sorted((str(i), brute(t)) for i, t in rows)
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert all(r.n_assign + r.n_access + r.n_hex == len([x for x in r.spans.split(",") if x]) for r in got)


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean")], "id long, text string")
    _, ledger = scan(first)
    assert ledger.count() == 2 * len(RULES)
    both = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean"), (3, "token=abcdefgh"), (4, "AKIA" + "Z" * 16)], "id long, text string")
    found, fresh = scan(both, ledger)
    assert fresh.count() == len(RULES)
    assert {r.id: len(r.spans) for r in found.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
    newer = (*RULES[:2], Rule("hex", r"[0-9a-f]{6,}", 0, 6, version=2))
    found, fresh = scan(both, ledger.unionByName(fresh), newer)
    assert {(r.kind, r.version) for r in fresh.collect()} == {("hex", 2)} and fresh.count() == 3


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "id long, text string"))[0].count() == 0


def test_masses_of_equal_rows_without_ids(spark):
    """Their text is taken from one copy a task; rows of other texts and ids are found as ever."""
    mass = spark.range(0, 100_000, 1, 8).selectExpr("CAST(NULL AS long) AS id", "'token=abcdefgh, and so on' AS text")
    some = spark.createDataFrame([(1, "token=abcdefgh, and so on"), (2, "AKIA" + "Z" * 16), (None, "clean")], "id long, text string")
    found = digest(scan(mass.unionByName(some))[0])
    counts = {(r.id, r.n_assign, r.n_access): r["count"] for r in found.groupBy("id", "n_assign", "n_access").count().collect()}
    assert counts == {(None, 1, 0): 100_000, (1, 1, 0): 1, (2, 0, 1): 1, (None, 0, 0): 1}
