"""BIO tagging of documents, merging with a model's tags, spans and verdicts.

Tags are found where a document is read: its tokens meet a table of the words that match, held as a literal, so that nothing is
shuffled and no row is joined back by a key that may be null or repeat.  The table lists what a lexicon can match: surfaces and
their Latin suffixed forms; with edit distances or containment it is made from the distinct vocabulary first.  Tables above
BROADCAST words are met by a join on the words, with a number for each row.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import NormalizeOptions, nfc, normalize, surface_script, token_texts
from sieveline.operators.matching import BROADCAST, MAX_STRIP, MIN_STEM, enumerable_matches, match_words, phrase_rows, phrase_starts
from sieveline.scratch import fresh, numbered

#: Which severities a single token needs to be tagged, by use.
GATES = {"serving": ("high", "medium", ""), "weak": ("high", "medium"), "all": None}
MATCH = "struct<canon:string,category:string,severity:string,match_type:string>"
SPAN = "struct<pos:int,token:string,tag:string,canon:string,category:string,severity:string,match_type:string>"
#: Parts of a table of words; a word is looked for in the part that its hash names.
PARTS = 1024
_FIELDS = ("canon", "category", "severity", "match_type")


def with_tokens(docs: DataFrame, text: str = "text", options: NormalizeOptions | None = NormalizeOptions(), clean: str = "clean", tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``clean``, its normalised text, and ``tokens``.  Without options only NFC is applied."""
    made = normalize(F.col(text), options) if options else nfc(F.coalesce(F.col(text), F.lit("")))
    # an exploded array of one keeps Spark from computing both anew for each use
    return docs.withColumn(clean, F.explode(F.array(made))).withColumn(tokens, F.explode(F.array(token_texts(F.col(clean)))))


class WordTable:
    """Words and what they match, as a literal: an array of maps, so that a look-up reads one small map."""

    def __init__(self, matches: dict[str, dict]) -> None:
        self.words = sorted(matches)
        parts: list[dict[str, dict]] = [{} for _ in range(PARTS)]
        for w, m in matches.items():
            parts[zlib.crc32(w.encode()) % PARTS][w] = m
        self.parts = F.from_json(F.lit(json.dumps(parts)), f"array<map<string,{MATCH}>>")

    def has(self, word: Column) -> Column:
        return word.isin(*self.words) if self.words else F.lit(False)

    def get(self, word: Column) -> Column:
        return F.try_element_at(F.element_at(self.parts, (F.crc32(word) % PARTS + 1).cast("int")), word)


def _is_tamil(word: Column) -> Column:
    return word.rlike(r"^\p{IsTamil}")


def _stems(word: Column, table: WordTable) -> list[Column]:
    """A word and, if it is Tamil, what stripping up to MAX_STRIP characters leaves, where the table has it."""
    cut = [F.substring(word, F.lit(1), F.length(word) - n) for n in range(1, MAX_STRIP + 1)]
    return [F.when(_is_tamil(word) & (F.length(s) >= MIN_STEM) & table.has(s), s) for s in cut]


def _allowed(severity: str | None, sensitivity: str, gate: str) -> bool:
    allowed = GATES[gate] if sensitivity != "maximum" else None
    return allowed is None or (severity or "") in allowed


def _vocabulary(rows: DataFrame, tokens: str) -> DataFrame:
    each = rows.select(F.explode(tokens).alias("token"))
    return each.select(F.lower("token").alias("word"), surface_script(F.col("token")).alias("script")).distinct()


def _span(pos: Column, token: Column, tag: str, match: Column, kind: str | None = None) -> Column:
    fields = [match[f].alias(f) for f in _FIELDS[:3]]
    return F.struct(pos.cast("int").alias("pos"), token.alias("token"), F.lit(tag).alias("tag"), *fields, (F.lit(kind) if kind else match["match_type"]).alias("match_type"))


def _phrase_spans(tokens: Column, starts: Column, phrases: WordTable) -> Column:
    at = lambda i: F.element_at(tokens, i)
    of = lambda s: phrases.get(F.lower(F.concat(at(s), F.lit(" "), at(s + 1))))
    return F.flatten(F.transform(starts, lambda s: F.array(_span(s - 1, at(s), "B-ABUSE", of(s), "exact"), _span(s, at(s + 1), "I-ABUSE", of(s), "exact"))))


def with_spans(rows: DataFrame, entries: DataFrame, spans: str, tokens: str = "tokens", sensitivity: str = "standard", gate: str = "serving", most: int = BROADCAST) -> DataFrame:
    """``rows`` with a column ``spans``: array<SPAN> of the tokens that the lexicon flags, in the order of the text."""
    known = phrase_rows(entries)
    phrases = WordTable({r.surface: {f: r[f] for f in _FIELDS[:3]} for r in known})
    starts = fresh(rows, "starts")
    rows = rows.withColumn(starts, F.explode(F.array(phrase_starts(F.col(tokens), [r.surface for r in known]))))
    if sensitivity == "standard":
        found = enumerable_matches(entries, most)
    else:
        matched = match_words(_vocabulary(rows, tokens), entries, sensitivity).select("word", "match.*").limit(most + 1).collect()
        found = {r.word: {f: r[f] for f in _FIELDS} for r in matched} if len(matched) <= most else None
    if found is None:
        out = _joined_spans(rows, entries, spans, tokens, starts, sensitivity, gate)
    else:
        table = WordTable({w: m for w, m in found.items() if _allowed(m["severity"], sensitivity, gate)})
        tamil = sensitivity == "standard" and any(w > "஀" for w in table.words)
        out = rows.withColumn(spans, single_spans(F.col(tokens), F.col(starts) if known else None, table, tamil))
    if known:
        out = out.withColumn(spans, with_phrases(F.col(spans), F.col(tokens), F.col(starts), phrases))
    return out.withColumn(spans, F.explode(F.array(F.col(spans).cast(f"array<{SPAN}>")))).drop(starts)


def single_spans(tokens: Column, starts: Column | None, table: WordTable, tamil: bool = False) -> Column:
    """The spans of single tokens that the table has, less those of the phrases that begin at ``starts``."""
    free = lambda i: ~F.array_contains(starts, i + 1) & ~F.array_contains(starts, i)
    known_as = lambda w: F.coalesce(F.when(table.has(w), w), *(_stems(w, table) if tamil else []))
    # one pass over the tokens gives the places of hits; all else is done for these alone
    begins = sorted({w[:MIN_STEM] for w in table.words if w > "஀" and len(w) >= MIN_STEM})
    # a stem has MIN_STEM letters at least, so that a token that begins like no word has none
    may = lambda w: table.has(w) | F.substring(w, 1, MIN_STEM).isin(*begins) if tamil and begins else table.has(w)
    places = F.filter(F.transform(tokens, lambda t, i: F.when(may(F.lower(t)), i)), lambda i: i.isNotNull())
    some = places if starts is None else F.filter(places, free)
    words = F.transform(some, lambda i: F.struct(i.alias("i"), F.get(tokens, i).alias("t"), F.lower(F.get(tokens, i)).alias("w")))
    keyed = F.filter(F.transform(words, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"), x["w"].alias("w"), known_as(x["w"]).alias("k"))), lambda x: x["k"].isNotNull())
    return F.transform(keyed, lambda x: _single(x, table))


def with_phrases(spans: Column, tokens: Column, starts: Column, phrases: WordTable) -> Column:
    """Spans of single tokens and those of the phrases, in the order of the text."""
    both = F.array_sort(F.concat(spans, _phrase_spans(tokens, starts, phrases)))
    return F.when(F.size(starts) > 0, both).otherwise(spans)


def _single(x: Column, table: WordTable) -> Column:
    """The span of a token that matches by its key: the word itself, or a stem of it."""
    match = table.get(x["k"])
    kind = F.when(x["k"] == x["w"], match["match_type"]).otherwise("suffix_strip")
    return F.struct(x["i"].cast("int").alias("pos"), x["t"].alias("token"), F.lit("B-ABUSE").alias("tag"), *[match[f].alias(f) for f in _FIELDS[:3]], kind.alias("match_type"))


def _joined_spans(rows: DataFrame, entries: DataFrame, spans: str, tokens: str, starts: str, sensitivity: str, gate: str) -> DataFrame:
    """The same for a table of any size: words are joined, and what is found goes back to its row by the row's number."""
    rows, row = numbered(rows)
    each = rows.select(F.col(row).alias("r"), F.col(starts).alias("s"), F.posexplode(tokens).alias("pos", "token"))
    each = each.where(~F.array_contains("s", F.col("pos") + 1) & ~F.array_contains("s", F.col("pos"))).withColumn("w", F.lower("token"))
    words = match_words(_vocabulary(rows, tokens), entries, sensitivity)
    allowed = GATES[gate] if sensitivity != "maximum" else None
    if allowed is not None:
        words = words.where(F.coalesce("match.severity", F.lit("")).isin(*allowed))
    hits = each.join(words, F.col("w") == F.col("word"))
    span = F.struct("pos", "token", F.lit("B-ABUSE").alias("tag"), *[F.col(f"match.{f}") for f in _FIELDS])
    found = hits.groupBy(F.col("r").alias(fresh(rows, "of"))).agg(F.array_sort(F.collect_list(span)).alias(spans))
    out = rows.join(found, F.col(row) == F.col(found.columns[0]), "left").drop(row, found.columns[0])
    return out.withColumn(spans, F.coalesce(F.col(spans), F.array()).cast(f"array<{SPAN}>"))


def tags_of(n: Column, spans: str) -> Column:
    """The BIO tag of each of n tokens: runs of O between the spans, which are in order."""
    before = lambda i: F.when(i > 0, F.try_element_at(F.col(spans), i)["pos"]).otherwise(-1)
    parts = F.transform(F.col(spans), lambda s, i: F.concat(F.array_repeat(F.lit("O"), s["pos"] - before(i) - 1), F.array(s["tag"])))
    last = F.coalesce(F.try_element_at(F.col(spans), F.lit(-1))["pos"], F.lit(-1))
    return F.concat(F.flatten(parts), F.array_repeat(F.lit("O"), n - last - 1))


def merge_tags(model: Column, lexicon: Column) -> Column:
    """I only if both are I, else B if either is not O."""
    return F.when((model == "I-ABUSE") & (lexicon == "I-ABUSE"), "I-ABUSE").when((model != "O") | (lexicon != "O"), "B-ABUSE").otherwise("O")


def span_source(model: Column, lexicon: Column) -> Column:
    return F.when((model != "O") & (lexicon != "O"), "both").when(model != "O", "model").when(lexicon != "O", "lexicon")


def tag_rows(docs: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", sensitivity: str = "standard", gate: str = "weak", options: NormalizeOptions | None = None) -> DataFrame:
    """The long table of tokens: key, pos, token, tag, canon, category, severity, match_type, needs_review.

    Each row is tagged by itself, so a null or repeated key mixes nothing up.
    """
    tagged = tagged_texts(docs, entries, key, text, sensitivity, gate, options)
    each = F.transform(with_places(F.col("tokens"), F.col("spans")), lambda x, i: F.struct(i.alias("pos"), x["token"].alias("token"), x["s"].alias("s")))
    out = tagged.select(F.col(key).alias("k"), "needs_review", F.explode(each).alias("x"))
    blank = lambda c: F.coalesce(F.col(f"x.s.{c}"), F.lit("")).alias(c)
    return out.select(F.col("k").alias(key), "x.pos", "x.token", F.coalesce("x.s.tag", F.lit("O")).alias("tag"), *map(blank, _FIELDS), "needs_review")


def with_places(tokens: Column, spans: Column) -> Column:
    """array<struct<token, s>>: each token beside the span at its place, or null; spans are in order, so no place is searched for."""
    none = F.lit(None).cast(SPAN)
    gap = lambda s, i: s["pos"] - F.when(i > 0, F.try_element_at(spans, i)["pos"]).otherwise(-1) - 1
    parts = F.transform(spans, lambda s, i: F.concat(F.array_repeat(none, gap(s, i)), F.array(s)))
    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["pos"], F.lit(-1))
    filled = F.concat(F.flatten(parts), F.array_repeat(none, F.size(tokens) - last - 1))
    bare = F.transform(tokens, lambda t: F.struct(t.alias("token"), none.alias("s")))
    return F.when(F.size(spans) > 0, F.zip_with(tokens, filled, lambda t, s: F.struct(t.alias("token"), s.alias("s")))).otherwise(bare)


def tagged_texts(docs: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", sensitivity: str = "standard", gate: str = "weak", options: NormalizeOptions | None = None) -> DataFrame:
    """One row per text: key, tokens, spans and needs_review (no span): what ``tag_rows`` deals out by token."""
    rows = with_tokens(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), "text", options)
    tagged = with_spans(rows, entries, "spans", "tokens", sensitivity, gate)
    return tagged.select(F.col("k").alias(key), "tokens", "spans", (F.size("spans") == 0).alias("needs_review"))


def moderate(docs: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", sensitivity: str = "standard", model: DataFrame | None = None) -> DataFrame:
    """One row per document: clean, tokens, model_tags, lexicon_tags, merged_tags, flagged_spans, flagged_words, categories, safe.

    ``model``: optional (key, tags) of a tagger, one tag a token, for each key; keys must then be given and be unique there.
    Strict and maximum sensitivity fold leet; null or blank texts are safe with empty lists.  Columns of ``docs`` that have the
    name of a result are replaced, all others kept; the key may be null or repeat.
    """
    options = NormalizeOptions(leet=sensitivity in ("strict", "maximum"))
    spans = fresh(docs, "spans")
    return verdicts(with_spans(with_tokens(docs, text, options), entries, spans, "tokens", sensitivity), spans, key, model)


def verdicts(rows: DataFrame, spans: str, key: str, model: DataFrame | None = None) -> DataFrame:
    """Rows with ``tokens`` and spans as ``moderate`` returns them, merged with a model's tags."""
    out = rows
    none = F.array_repeat(F.lit("O"), F.size("tokens"))
    if model is not None:
        own, tags = fresh(out, "model_key"), fresh(out, "their_tags")
        out = out.join(model.select(F.col(key).alias(own), F.col("tags").alias(tags)), F.col(key) == F.col(own), "left").withColumn("model_tags", F.coalesce(F.col(tags), none)).drop(own, tags)
        out = out.withColumn("model_tags", F.when(F.size("model_tags") == F.size("tokens"), F.col("model_tags")).otherwise(F.raise_error(F.lit("a model gives one tag a token"))))
    else:
        out = out.withColumn("model_tags", none)
    out = out.withColumn("lexicon_tags", tags_of(F.size("tokens"), spans))
    out = out.withColumn("merged_tags", F.zip_with("model_tags", "lexicon_tags", merge_tags))
    field = lambda s, c: F.coalesce(s[c], F.lit("")).alias(c)
    if model is None:
        found = F.transform(spans, lambda s: F.struct(s["token"].alias("token"), F.lit("lexicon").alias("source"), *[field(s, c) for c in _FIELDS]))
    else:
        every = F.transform(F.arrays_zip("tokens", "model_tags", "lexicon_tags"), lambda x, i: F.struct(i.alias("i"), x["tokens"].alias("token"), span_source(x["model_tags"], x["lexicon_tags"]).alias("source")))
        of = lambda x: F.try_element_at(F.filter(spans, lambda s: s["pos"] == x["i"]), F.lit(1))
        found = F.transform(F.filter(every, lambda x: x["source"].isNotNull()), lambda x: F.struct(x["token"].alias("token"), x["source"].alias("source"), *[field(of(x), c) for c in _FIELDS]))
    out = out.withColumn("flagged_spans", F.explode(F.array(found))).drop(spans)
    out = out.withColumn("flagged_words", F.array_distinct(F.transform("flagged_spans", lambda s: s["token"])))
    out = out.withColumn("categories", F.filter(F.array_distinct(F.transform("flagged_spans", lambda s: s["category"])), lambda c: c != ""))
    return out.withColumn("safe", F.size("flagged_spans") == 0)
