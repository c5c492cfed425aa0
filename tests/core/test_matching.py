import random

from pyspark.sql import functions as F

from sieveline.operators import matching
from sieveline.sources import lexicon


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_near_pairs_against_all_pairs(spark):
    """Few letters, so that most pairs are close to the limit; words of one letter, and one very long one."""
    rng = random.Random(4)
    some = lambda n, most: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, most))) for _ in range(n)}
    words, surfaces = some(250, 12) | {"ab" * 2000}, some(60, 12) | {"ab" * 1999 + "b"}
    left = spark.createDataFrame([(w, 1) for w in words], "token string, word_key int")
    right = spark.createDataFrame([(w,) for w in surfaces], "surface string")
    short = [(a, b, distance(a, b)) for a in words for b in surfaces if max(len(a), len(b)) < 100]
    for most, least in ((1, 1), (2, 4), (3, 1)):
        got = sorted((r.token, r.surface) for r in matching.near_pairs(left, "token", right, "surface", most, least).collect())
        want = [(a, b) for a, b, d in short if d <= most and len(b) >= least] + [("ab" * 2000, "ab" * 1999 + "b")]
        assert got == sorted(want)


def plain(word, script, surfaces, sensitivity):
    """The first match by stage, rank and place of the surface."""
    found = [(0, 0, i, s, "exact") for i, s, _ in surfaces if s == word]
    if script == "LATIN":
        found += [(1, k, i, s, "suffix_strip") for k, x in enumerate(matching.LATIN_SUFFIXES) if word.endswith(x) and len(word) - len(x) >= 4 for i, s, _ in surfaces if s == word[: len(word) - len(x)]]
    if sensitivity != "standard" and word not in matching.INNOCENT:
        most, least = (1, 5) if sensitivity == "strict" else (1, 4) if len(word) < 6 else (2, 4)
        found += [(2, 0, i, s, "fuzzy_levenshtein") for i, s, _ in surfaces if min(len(s), len(word)) >= least and distance(s, word) <= most]
    if sensitivity == "maximum" and len(word) >= 5:
        found += [(3, 0, i, s, "substring_containment") for i, s, severity in surfaces if len(s) >= 4 and s in word and severity in ("high", "medium")]
    return min(found)[3:] if found else None


def test_all_stages_against_plain_rules(spark):
    rng = random.Random(9)
    letters = "abdeglnru"
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(120)} | {"padamx", "gala", "nalla"})
    entries = lexicon.from_rows(spark, [(n, (), "c", rng.choice(["high", "medium", "low"])) for n in names])
    surfaces = [(i, r.surface, r.severity) for i, r in enumerate(lexicon.exact_surfaces(entries).orderBy("ord").collect())]
    words = set(matching.INNOCENT)
    for n in names:
        at = rng.randrange(len(n))
        words |= {n, n + rng.choice(matching.LATIN_SUFFIXES), n[:at] + n[at + 1 :], n[:at] + "z" + n[at:], "zz" + n + "q", n[:at] + "zz" + n[at:] + "a"}
    rows = [(w, "LATIN") for w in sorted(words)]
    df = spark.createDataFrame([*rows, ("a", "LATIN"), ("12345", "OTHER")], "word string, script string")
    for sensitivity in matching.SENSITIVITIES:
        got = {r.word: (r.match.canon, r.match.match_type) for r in matching.match_words(df, entries, sensitivity).collect()}
        assert got == {w: m for w, s in rows if len(w) >= 2 and (m := plain(w, s, surfaces, sensitivity))}


def test_no_word_meets_the_whole_lexicon(spark):
    """Plans of equi-joins; stages one by one give what they give together."""
    entries = lexicon.from_rows(spark, [("gruck", (), "c", "high"), ("vilemonger", ("vile",), "c", "medium")])
    exact = lexicon.exact_surfaces(entries)
    words = spark.createDataFrame([(w, "LATIN") for w in ("gruk", "grucks", "devilement", "vilemnger", "fine")], "word string, script string")
    for found in (matching.fuzzy_matches(words, exact, 1, 4), matching.contained_matches(words, exact), matching.match_words(words, entries, "maximum")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.word for r in matching.fuzzy_matches(words, exact, 1, 4).collect()} == {"gruk", "grucks", "vilemnger"}
    assert {(r.word, r.canon) for r in matching.contained_matches(words, exact).collect()} == {("grucks", "gruck"), ("devilement", "vilemonger"), ("vilemnger", "vilemonger")}


def test_a_lexicon_of_many_surfaces(spark):
    """30,000 entries, one with more variants than the next entry's place would allow: places stay in order."""
    rows = [(f"word{i}x", (), "c", "high") for i in range(30_000)]
    df = lexicon.from_rows(spark, rows)
    many = df.where("ord = 5").withColumn("variants", F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda i: F.concat(F.lit("v"), i.cast("string"))))
    found = lexicon.surface_rows(df.where("ord != 5").unionByName(many))
    assert found.agg(F.max("ord")).first()[0] == 29_999 << 32
    assert found.where("canon = 'word5x'").agg(F.max("ord")).first()[0] < found.where("canon = 'word6x'").agg(F.min("ord")).first()[0]
    words = spark.createDataFrame([("word29999x", "LATIN"), ("v120000", "LATIN"), ("word17y", "LATIN")], "word string, script string")
    got = {r.word: (r.match.canon, r.match.match_type) for r in matching.match_words(words, df, "strict").collect()}
    assert got["word29999x"] == ("word29999x", "exact") and got["word17y"] == ("word17x", "fuzzy_levenshtein")
