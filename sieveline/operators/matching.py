"""Matching words against the lexicon, always on the distinct vocabulary, never on tokens.

Stages in order of precedence: exact, suffix strip, bounded edit distance, containment.  Each is an equi-join of keys: a word gives a
bounded number of them, which meet the keys of the surfaces, and what meets is verified.

* exact and suffix strip: the word, and its stems;
* edit distance of at most k: a surface is cut into k + 1 parts, of which one is in the word untouched, moved by no more places than
  the difference in length allows.  So a surface has k + 1 keys, (its length, the part's number, the part), and a word has 10 keys
  for one edit and 39 for two, however long it is; keys of all strings with letters left out would grow with its square;
* containment: a surface has one key, that of its four-letter parts which fewest surfaces share; a word gives its four-letter parts.

So a word never meets the whole lexicon, and the keys of a lexicon of any size are joined as Spark chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import surface_script
from sieveline.scratch import BROADCAST, cut, fresh, small
from sieveline.sources.lexicon import exact_surfaces, phrase_surfaces

#: Romanised suffixes in the order in which they are tried (fixed values).
LATIN_SUFFIXES = (
    "ingala", "unga", "kinga", "inga",
    "kulla", "kulla",
    "gala",
    "ukku", "kku",
    "oda",
    "ula", "la",
    "nga",
    "dra", "tra",
    "ya", "ai",
    "ra",
    "da",
    "ku",
)
MIN_STEM, MAX_STRIP = 4, 5
#: Letters of the parts by which containment is looked for: the shortest surface that counts.
GRAM = 4
#: Words that are never taken for misspellings (fixed values).
INNOCENT = (
    "naan", "avan", "aval", "pola", "pottu", "enna", "illa", "irukku",
    "aana", "vara", "romba", "nalla", "super", "mass", "oru", "padam",
    "trailer", "video", "tamil", "ungal", "engal", "naanga", "neenga",
)
SENSITIVITIES = ("standard", "strict", "maximum")
_MATCH = "canon", "category", "severity"


def _found(df: DataFrame, stage: int, kind: str, rank="0") -> DataFrame:
    return df.select("word", "script", F.lit(stage).alias("stage"), F.expr(rank).cast("int").alias("rank"), "ord", *_MATCH, F.lit(kind).alias("match_type"))


def exact_matches(words: DataFrame, exact: DataFrame) -> DataFrame:
    return _found(words.join(exact, F.col("word") == F.col("surface")), 0, "exact")


def suffix_matches(words: DataFrame, exact: DataFrame) -> DataFrame:
    """Latin words less a listed suffix, Tamil words less up to five characters; the first that is a surface wins."""
    latin = F.array(*[F.struct(F.lit(i).alias("rank"), F.when(F.endswith("word", F.lit(s)), F.expr(f"substring(word, 1, length(word) - {len(s)})")).alias("stem")) for i, s in enumerate(LATIN_SUFFIXES)])
    tamil = F.array(*[F.struct(F.lit(n).alias("rank"), F.expr(f"substring(word, 1, length(word) - {n})").alias("stem")) for n in range(1, MAX_STRIP + 1)])
    stems = words.withColumn("s", F.explode(F.when(F.col("script") == "LATIN", latin).otherwise(tamil)))
    stems = stems.where(F.length("s.stem") >= MIN_STEM).select("word", "script", "s.rank", "s.stem")
    return _found(stems.join(exact, F.col("stem") == F.col("surface")), 1, "suffix_strip", "rank")


def part_keys(surface: Column, most: int) -> Column:
    """The keys of a surface for ``most`` edits: of each of its most + 1 parts."""
    n = F.length(surface)
    return F.array(*[_part_key(surface, n, most, i, F.lit(0)) for i in range(most + 1)])


def _part_key(text: Column, length: Column, most: int, i: int, moved: Column) -> Column:
    """The key of what stands in a text where part i of a surface of some length would, moved by some places."""
    at, to = (F.floor(length * k / (most + 1)).cast("int") for k in (i, i + 1))
    return F.xxhash64(F.lit(most), length, F.lit(i), F.substring(text, at + moved + 1, to - at))


def near_keys(word: Column, most: int, least: int = 1) -> list[Column]:
    """The keys of a word for surfaces within ``most`` edits of ``least`` characters; null where the word is too short for one."""
    n, out = F.length(word), []
    for longer in range(-most, most + 1):  # by how much the word is longer than the surface
        length = n - longer
        for i in range(most + 1):
            at, to = (F.floor(length * k / (most + 1)).cast("int") for k in (i, i + 1))
            for moved in range(-most, most + 1):
                if abs(moved) + abs(longer - moved) <= most:
                    inside = (length >= least) & (at + moved >= 0) & (to + moved <= n)
                    out.append(F.when(inside, _part_key(word, length, most, i, F.lit(moved))))
    return out


def near_pairs(words: DataFrame, word: str, surfaces: DataFrame, surface: str, most: int, least: int = 1) -> DataFrame:
    """Distinct pairs of rows of both within ``most`` edits of each other, surfaces of ``least`` characters."""
    of_word, of_surface = fresh(words, "word_key"), fresh(surfaces, "surface_key")
    left = words.withColumn(of_word, F.explode(F.array(*near_keys(F.col(word), most, least)))).where(F.col(of_word).isNotNull())
    right = surfaces.where(F.length(surface) >= least).withColumn(of_surface, F.explode(part_keys(F.col(surface), most)))
    met = left.join(right, F.col(of_word) == F.col(of_surface)).where(F.levenshtein(F.col(word), F.col(surface), most) >= 0)
    return met.select(*words.columns, *surfaces.columns).distinct()


def fuzzy_matches(words: DataFrame, exact: DataFrame, most: int, least: int) -> DataFrame:
    """Within ``most`` edits, both of ``least`` characters."""
    guarded = words.where((F.length("word") >= least) & ~F.col("word").isin(*INNOCENT))
    return _found(near_pairs(guarded, "word", exact, "surface", most, least), 2, "fuzzy_levenshtein")


def _grams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def rarest_grams(surfaces: DataFrame) -> DataFrame:
    """``surfaces`` with ``gram``, that of the surface's parts of GRAM letters which fewest surfaces have."""
    each = surfaces.withColumn("gram", F.explode(F.array_distinct(_grams(F.col("surface")))))
    each = each.withColumn("shared", F.count("*").over(Window.partitionBy("gram")))
    best = F.min_by(F.struct(*surfaces.columns, "gram"), F.struct("shared", "gram")).alias("x")
    return each.groupBy("surface").agg(best).select("x.*")


def contained_matches(words: DataFrame, exact: DataFrame) -> DataFrame:
    """Words of five characters that contain a surface of four, of high or medium severity."""
    keys = rarest_grams(exact.where((F.length("surface") >= GRAM) & F.col("severity").isin("high", "medium")))
    parts = words.where(F.length("word") >= 5).withColumn("part", F.explode(F.array_distinct(_grams(F.col("word")))))
    return _found(parts.join(keys, F.col("part") == F.col("gram")).where(F.contains("word", "surface")), 3, "substring_containment")


def _keyed(words: DataFrame, stage: int, most: int, keys: list[tuple[int, Column, Column]]) -> DataFrame:
    """Words under keys (rank, key, text), text being what an exact surface has to be."""
    rows = [F.struct(F.lit(rank).alias("rank"), key.alias("key"), text.alias("text")) for rank, key, text in keys]
    each = words.select("word", "script", F.lit(stage).alias("stage"), F.lit(most).alias("most"), F.inline(F.array(*rows)))
    return each.where("key IS NOT NULL")


def _whole_keys(words: DataFrame) -> DataFrame:
    """Words under themselves, and under their stems."""
    word, script, n = F.col("word"), F.col("script"), F.length("word")
    out = [(-1, F.xxhash64("word"), word)]
    for i, suffix in enumerate(LATIN_SUFFIXES):
        stem = F.substring(word, F.lit(1), n - len(suffix))
        out.append((i, F.when((script == "LATIN") & F.endswith(word, F.lit(suffix)) & (n - len(suffix) >= MIN_STEM), F.xxhash64(stem)), stem))
    for i in range(1, MAX_STRIP + 1):
        stem = F.substring(word, F.lit(1), n - i)
        out.append((i, F.when((script == "TAMIL") & (n - i >= MIN_STEM), F.xxhash64(stem)), stem))
    return _keyed(words, 1, 0, out)


def match_words(words: DataFrame, entries: DataFrame, sensitivity: str = "standard") -> DataFrame:
    """(word, script, match) of the distinct (word, script) rows that match; the first stage, rank and surface win.

    The stages are equi-joins of one vocabulary, which is written once, so that no stage makes it anew.
    """
    if sensitivity not in SENSITIVITIES:
        raise ValueError(f"sensitivity is one of {SENSITIVITIES}")
    exact = small(exact_surfaces(entries))
    words = words.where(F.col("script").isin("TAMIL", "LATIN") & (F.length("word") >= 2)).distinct()
    # a vocabulary is small for what is made of it, so it is dealt to all tasks before it is written
    words = cut(words.repartition(words.sparkSession.sparkContext.defaultParallelism), "vocabulary")
    word, n, columns = F.col("word"), F.length("word"), ["surface", "ord", *_MATCH]
    wide = exact.select(F.xxhash64("surface").alias("surface_key"), *columns)
    met = _whole_keys(words).join(wide, F.col("key") == F.col("surface_key")).where(F.col("text") == F.col("surface"))
    met = met.withColumn("stage", F.when(F.col("rank") < 0, 0).otherwise(1))
    fuzzy = {"standard": [], "strict": [(1, 5, F.lit(True))], "maximum": [(1, 4, n < 6), (2, 4, n >= 6)]}[sensitivity]
    for most, least, when in fuzzy:
        asked = when & (n >= least) & ~word.isin(*INNOCENT)
        keyed = _keyed(words, 2, most, [(0, F.when(asked, key), word) for key in near_keys(word, most, least)])
        near = exact.where(F.length("surface") >= least).select(F.explode(part_keys(F.col("surface"), most)).alias("surface_key"), *columns)
        met = met.unionByName(keyed.join(near, F.col("key") == F.col("surface_key")).where(F.levenshtein("word", "surface", most) >= 0))
    if sensitivity == "maximum":
        grams = F.when(n >= 5, F.array_distinct(_grams(word)))
        parts = words.select("word", "script", F.lit(3).alias("stage"), F.lit(0).alias("most"), F.lit(0).alias("rank"), F.explode(grams).alias("part"), word.alias("text"))
        keys = rarest_grams(exact.where((F.length("surface") >= GRAM) & F.col("severity").isin("high", "medium")).select(*columns))
        keys = keys.select(F.xxhash64("gram").alias("surface_key"), *columns)
        held = parts.withColumn("key", F.xxhash64("part")).drop("part").join(keys, F.col("key") == F.col("surface_key"))
        met = met.unionByName(held.where(F.contains("word", "surface")))
    kinds = F.array(*map(F.lit, ("exact", "suffix_strip", "fuzzy_levenshtein", "substring_containment")))
    best = F.min_by(F.struct(*_MATCH, F.get(kinds, F.col("stage")).alias("match_type")), F.struct("stage", "rank", "ord"))
    return met.groupBy("word", "script").agg(best.alias("match"))


def enumerable_matches(entries: DataFrame, most: int = BROADCAST) -> dict[str, dict] | None:
    """All Latin words and Tamil surfaces that match exactly or by a Latin suffix; none if they are more than ``most``.

    What Tamil suffixes are stripped from is not listed: such words are cut where they are met.
    """
    rows = exact_surfaces(entries).withColumn("script", surface_script(F.col("surface"))).orderBy("ord").limit(most + 1).collect()
    if len(rows) * (1 + len(LATIN_SUFFIXES)) > most:
        return None
    out: dict[str, dict] = {}
    own = [(r.surface, {c: r[c] for c in _MATCH}, r.script) for r in rows if r.script in ("TAMIL", "LATIN") and len(r.surface) >= 2]
    for surface, match, _ in own:
        out.setdefault(surface, match | {"match_type": "exact"})
    for suffix in LATIN_SUFFIXES:  # of several ways to strip a word the first suffix counts
        for surface, match, script in own:
            if script == "LATIN" and len(surface) >= MIN_STEM:
                out.setdefault(surface + suffix, match | {"match_type": "suffix_strip"})
    return out


def phrase_starts(tokens, phrases: list[str]):
    """Where two-token phrases start, left to right without overlap, in an array of tokens: no shuffle, no window."""
    if not phrases:
        return F.array().cast("array<int>")
    # neighbours are zipped once; a lambda that looked tokens up by place would compute them anew for each
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.lower(F.concat(a, F.lit(" "), b)))
    hits = F.filter(F.transform(pairs, lambda p, i: F.when(p.isin(*phrases), i + 1)), lambda i: i.isNotNull())
    return F.aggregate(hits, F.array().cast("array<int>"), lambda out, i: F.when(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(-1)) == i - 1, out).otherwise(F.concat(out, F.array(i))))


def phrase_rows(entries: DataFrame) -> list:
    """The phrases of a lexicon, which become literals: BROADCAST of them at most, or the call fails."""
    rows = phrase_surfaces(entries).select("surface", "canon", "category", "severity").limit(BROADCAST + 1).collect()
    if len(rows) > BROADCAST:
        raise ValueError(f"a lexicon has {BROADCAST} phrases at most")
    return rows


def phrase_table(entries: DataFrame) -> list[str]:
    return [r.surface for r in phrase_rows(entries)]
