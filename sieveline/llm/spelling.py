"""Grouping of spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters' numbers, so that it does not depend on their order.  Two words that differ
by one added, removed or exchanged letter have keys that differ by the value of a letter, or by that of an exchange: key(v) + f(c) =
key(w), or key(v) - f(c) = key(w) - f(d).  Each word therefore gives its key and its keys less each of its distinct letters, and an
equi-join on those finds every such pair; no list of letters is needed, and no word is held against all.

Letters in another order have the same key, so that the join also asks for half of the order: of the letters that both words share,
the first half stands before the edit, or the last half behind it, unchanged.  Each key is given twice, with a hash of either half.
The order of all letters is then verified: the edit distance is 1.  A pair that both halves find is kept where the first one does.

Keys that many words share are pieces of words that are near each other (at most one for each letter and place), so that groups stay
small; nothing depends on how often a word occurs, since only distinct words are joined.

Defined results: null and empty texts give no words; rows that repeat, or have no id, count as often as they come (a null id is an
empty one in the hash); ties go to the smaller word in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import cut

#: Letters of a word, and the capitals that are lowered.
LETTERS, CAPITALS, SMALL = r"[A-Za-z\x{C0}-\x{FF}]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word has this many letters and occurrences, at least; a form is so many times as frequent.
SHORTEST, LEAST, RATIO = 7, 2, 10
#: The power of a letter's number.  With four, sums of 2^31 letters of this alphabet stay below 2^63.
POWER = 4


def occurrences(docs: DataFrame, shortest: int = SHORTEST, noise: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts with their numbers of occurrences: runs of letters, of which some lose a letter by a hash.

    Runs that are too short before they lose a letter are never made into rows.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, SMALL)).otherwise(F.col("run")).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("id", F.lit(":"), F.col("run"))).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))


def _value(letter: Column) -> Column:
    number = F.ascii(letter).cast("bigint")
    square = number * number
    return square * square


def keyed(words: DataFrame) -> DataFrame:
    """Each of ``words`` (word, n, total) under its keys: key, shared (letters that a partner has too), end (which half), half, less."""
    letters = F.split("word", "")
    size = F.char_length("word")
    own = F.array(F.struct(F.lit(0).cast("bigint").alias("value"), size.alias("shared")))
    less = F.transform(F.array_distinct(letters), lambda c: F.struct(_value(c).alias("value"), (size - 1).alias("shared")))
    each = words.select("word", "n", "total", F.explode(F.concat(own, less)).alias("k"))
    shared = F.col("k.shared")
    first, last = F.floor(shared / 2).cast("int"), F.ceil(shared / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("end"), F.xxhash64(F.substring(F.col("word"), F.lit(1), first)).alias("half")),
        F.struct(F.lit(1).alias("end"), F.xxhash64(F.substring(F.col("word"), F.char_length("word") - last + 1, last)).alias("half")),
    )
    made = each.select("word", "n", (F.col("total") - F.col("k.value")).alias("key"), shared.alias("shared"), (F.col("k.value") > 0).alias("less"), F.explode(halves).alias("h"))
    return made.select("word", "n", "key", "shared", "less", "h.end", "h.half")


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of ``words`` (word, n) that differ by one letter added, removed or exchanged, once: a, a_n, b, b_n."""
    # words are dealt before they are given keys, since a table of words is small for what is made of it
    total = F.aggregate(F.split("word", ""), F.lit(0).cast("bigint"), lambda sum_, c: sum_ + _value(c)).alias("total")
    dealt = words.select("word", "n", total).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    keys = keyed(dealt)
    on = ["key", "shared", "end", "half"]
    side = lambda x: keys.select(*on, F.col("word").alias(x), F.col("n").alias(f"{x}_n"), F.col("less").alias(f"{x}_less"))
    # both less a letter: an exchange, once; a whole word beside one less a letter: an addition.  The condition takes both sides, so
    # that these are one shuffle
    once = F.when(F.col("a_less") & F.col("b_less"), F.col("a") < F.col("b")).otherwise(F.col("a_less") & (F.col("a") != F.col("b")))
    met = side("a").join(side("b"), on).where(once)
    first = F.floor(F.col("shared") / 2).cast("int")
    same = F.substring(F.col("a"), F.lit(1), first) == F.substring(F.col("b"), F.lit(1), first)
    return met.where((same == (F.col("end") == 0)) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) that have near words, with n_near, form and form_n: the near word of largest n, if it is large enough."""
    pairs = near_pairs(words)
    sides = [F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")]
    both = pairs.select(F.inline(F.array(*sides)))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best")
    found = both.groupBy("word").agg(F.first("n").alias("own"), F.count("*").alias("n_near"), best)
    enough = -F.col("best.m") >= F.col("own") * ratio
    return found.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """Words with a ``form`` and the last one that forms lead to.  Each pass doubles the steps; each step multiplies n, so that
    few passes are needed."""
    links = cut(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = after.select("word", "root")
        if after.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, least: int = LEAST, ratio: int = RATIO, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs`` with their near words, forms and roots: word, n, n_near, form, form_n, root."""
    words = cut(occurrences(docs, shortest, doc_id=doc_id, text=text).where(F.col("n") >= least), "words")
    formed = cut(forms(words, ratio), "forms")
    out = words.join(formed, "word", "left").join(rooted(formed), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
