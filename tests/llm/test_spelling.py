import random
import zlib
from collections import Counter

from sieveline.llm.spelling import LETTERS, near_pairs, occurrences, variants

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    """Exactly one letter added, removed or exchanged."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_pairs_against_brute_force(spark):
    """Few letters, so that many words have equal keys and only their order tells them apart."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(3, 9))) for _ in range(700)} | {"a" * n for n in range(1, 9)} | {"x" * 5000, "x" * 5001}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = Counter(tuple(sorted((r.a, r.b))) for r in near_pairs(df).collect())
    every = sorted(words)
    assert got == Counter((a, b) for i, a in enumerate(every) for b in every[i + 1 :] if abs(len(a) - len(b)) < 2 and near(a, b))


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        run = ""
        for c in (text or "") + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                word = small(run)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                if h % 31 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                if len(word) >= 7:
                    counts[word] += 1
            run = ""
    words = {w: n for w, n in counts.items() if n >= 2}
    out = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(v, w))
        form = close[0][1] if close and -close[0][0] >= 10 * n else None
        out[w] = (n, len(close), form, words[form] if form else None)
    roots = {}
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return {w: (*found, roots[w]) for w, found in out.items()}


def rows_of(rng):
    base = ["".join(rng.choice("abcdeinréÉ÷") for _ in range(rng.randrange(7, 11))) for _ in range(25)]
    rows = []
    for i in range(260):
        words = rng.choices(base, [2**-k for k in range(len(base))], k=25)
        for k in range(2):
            at = rng.randrange(len(words[k]))
            words[k] = rng.choice([words[k][:at] + words[k][at + 1 :], words[k][:at] + "z" + words[k][at:], words[k][:at].upper() + words[k][at:]])
        rows.append((i, ("-" if i % 2 else " ").join(words), "x", 1))
    return rows


def test_variants_against_brute_force(spark):
    rows = rows_of(random.Random(1))
    chain = ["correctly"] * 500 + ["corectly"] * 40 + ["corecty"] * 3  # forms that lead on to others
    rows += [(None, None, None, None), (None, "", "x", 1), (5, "short words", "x", 1), (5, "short words", "x", 1), (None, " ".join(chain), "x", 1)]
    want = brute(rows)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert want["corecty"][2] == "corectly" and want["corecty"][4] == "correctly"


def test_empty_and_without_words(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1), (2, None, None, None)], SCHEMA)
    assert variants(df).count() == 0 and variants(df.limit(0)).count() == 0


def test_runs_that_are_long_enough(spark):
    df = spark.createDataFrame([(1, "abcdefg abcdef xabcdefg-abcdefgh× ABCDEFG", "x", 1)], SCHEMA)
    assert {r.word for r in occurrences(df, noise=10**9).collect()} == {"abcdefg", "xabcdefg", "abcdefgh×"}
    assert LETTERS.startswith("[")
