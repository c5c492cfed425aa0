"""A detector and censor without a lexicon file: white-space words, a short list, containment and small edit distances.

It is what a client without a server falls back on.  The list is a parameter; all is column expressions, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import destuff_punctuation, strip
from sieveline.operators.spans import quoted

#: Signs that are read as letters (fixed values).
SWAPS = {"3": "e", "!": "i", "@": "a", "0": "o", "$": "s", "1": "i"}
FALLBACK = "[friend]"
SPAN = "struct<token:string,source:string,canon:string,category:string,severity:string,match_type:string>"
#: word, canon, category, severity: a demonstration list, in order.
DEMO = (("idiot", "idiot", "profanity", "high"), ("moron", "moron", "profanity", "high"), ("stupid", "stupid", "profanity", "medium"), ("scum", "scum", "profanity", "high"), ("loser", "loser", "threat", "medium"))


def bare(word: Column) -> Column:
    """Letters and digits of a word, in lower case."""
    return F.regexp_replace(F.lower(word), r"[^a-z0-9\p{L}\p{Nd}]+", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def detect(rows: DataFrame, text: str = "text", sensitivity: str = "standard", entries=DEMO) -> DataFrame:
    """``rows`` with clean, tokens, merged_tags, flagged_spans, flagged_words, categories and safe."""
    clean = strip(F.coalesce(F.col(text), F.lit("")))
    if sensitivity != "standard":
        clean = F.translate(destuff_punctuation(clean), "".join(SWAPS), "".join(SWAPS.values()))
    listed = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(c).alias("canon"), F.lit(k).alias("category"), F.lit(s).alias("severity")) for w, c, k, s in entries])
    most = {"standard": 0, "strict": 1, "maximum": 2}[sensitivity]

    def match(word: Column) -> Column:
        # one pattern of all listed words tells whether to look for the first of them
        first = F.try_element_at(F.filter(listed, lambda e: F.contains(word, e["word"])), F.lit(1))
        inside = F.when(word.rlike("|".join(quoted(e[0]) for e in entries)), first) if entries else first
        if not most:
            return inside
        near = F.try_element_at(F.filter(listed, lambda e: (F.length(e["word"]) >= 4) & (F.levenshtein(word, e["word"]) <= most)), F.lit(1))
        return F.coalesce(inside, near)

    out = rows.withColumn("clean", F.explode(F.array(clean))).withColumn("tokens", F.explode(F.array(_words(F.col("clean")))))
    # bare words are an array of their own, so that each is made once, however often it is looked at
    found = F.zip_with("tokens", F.transform("tokens", bare), lambda t, b: F.struct(t.alias("token"), match(b).alias("m")))
    out = out.withColumn("flagged_spans", F.explode(F.array(found)))
    out = out.withColumn("merged_tags", F.transform("flagged_spans", lambda x: F.when(x["m"].isNotNull(), "B-ABUSE").otherwise("O")))
    span = lambda x: F.struct(x["token"].alias("token"), F.lit("lexicon").alias("source"), x["m"]["canon"].alias("canon"), x["m"]["category"].alias("category"), x["m"]["severity"].alias("severity"), F.lit("exact").alias("match_type"))
    out = out.withColumn("flagged_spans", F.transform(F.filter("flagged_spans", lambda x: x["m"].isNotNull()), span))
    out = out.withColumn("flagged_words", F.array_distinct(F.transform("flagged_spans", lambda s: s["token"])))
    out = out.withColumn("categories", F.array_distinct(F.transform("flagged_spans", lambda s: s["category"])))
    return out.withColumn("safe", F.size("flagged_spans") == 0)


def mask(word: Column) -> Column:
    """One character kept at either end of a word of four or fewer, two of a longer one; one mark at least."""
    n = F.length(word)
    ends = lambda k: F.concat(F.left(word, F.lit(k)), F.repeat(F.lit("*"), F.greatest(F.lit(1), n - 2 * k)), F.right(word, F.lit(k)))
    return F.when(n <= 4, ends(1)).otherwise(ends(2))


def censor(rows: DataFrame, text: str = "text", mode: str = "partial", polite: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``detect`` with censored, polite_suggestion and redacted_count: words that hold a flagged token are masked, and the
    words of an unsafe text are joined by single spaces."""
    if mode not in ("partial", "tag", "block", "polite"):
        raise ValueError("mode is partial, tag, block or polite")
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+")
    span = lambda w: F.try_element_at(F.filter("flagged_spans", lambda s: (w != "") & F.contains(w, F.lower(s["token"]))), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in (polite or {"": FALLBACK}).items() for x in kv])
    kind = lambda s: F.coalesce(F.try_element_at(table, F.lower(s["token"])), F.lit(FALLBACK))
    shown = {
        "partial": lambda w, s: mask(w),
        "tag": lambda w, s: F.concat(F.lit("[REDACTED: "), F.upper(F.coalesce(s["category"], F.lit("ABUSE"))), F.lit("]")),
        "block": lambda w, s: F.repeat(F.lit("█"), F.length(w)),
        "polite": lambda w, s: kind(s),
    }[mode]
    out = rows.withColumn("redacted_spans", F.explode(F.array(F.transform(words, lambda w: F.struct(w.alias("w"), span(bare(w)).alias("s"))))))
    part = lambda f: F.array_join(F.transform("redacted_spans", lambda x: F.when(x["s"].isNotNull(), f(x["w"], x["s"])).otherwise(x["w"])), " ")
    raw = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumn("censored", F.when(F.col("safe"), raw).otherwise(part(shown))).withColumn("polite_suggestion", F.when(F.col("safe"), raw).otherwise(part(lambda w, s: kind(s))))
    hits = F.filter("redacted_spans", lambda x: x["s"].isNotNull())
    made = F.transform(hits, lambda x: F.struct(x["w"].alias("original_token"), shown(x["w"], x["s"]).alias("redacted_token"), F.lit(mode).alias("mode"), x["s"]["category"].alias("category"), x["s"]["severity"].alias("severity")))
    out = out.withColumn("redacted_spans", F.when(F.col("safe"), F.slice(made, 1, 0)).otherwise(made))
    return out.withColumn("redacted_count", F.size("redacted_spans"))
