"""Redaction of flagged words in raw text: partial, tag, block and polite modes, as one narrow transform.

A flagged word may stand in a piece of text in many disguises, each of which is a look-up in the words of that very text; an
Arrow function does this for the flagged texts, all others pass by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import LEET_DIGITS, LEET_SYMBOLS
from sieveline.scratch import fresh

MODES = ("partial", "tag", "block", "polite")
RANKS = {"low": 1, "medium": 2, "high": 3}
#: Demonstration replacements for the polite mode; a caller gives its own in order.
POLITE = {"idiot": "thoughtless person", "stupid": "unwise", "loser": "person", "trash": "not to my taste", "scum": "person", "moron": "person"}
FALLBACK = "[removed]"


def severity_rank(c: Column) -> Column:
    """low 1, medium 2, high 3, anything else 1."""
    return F.when(F.lower(c) == "high", 3).when(F.lower(c) == "medium", 2).otherwise(1)


def allowed_spans(spans: Column, threshold: str | Column = "all", categories: list[str] | Column | None = None) -> Column:
    """Spans at or above a severity whose category, if any, is allowed.  Both may be columns; no categories allow all."""
    if isinstance(threshold, Column):
        rank = F.coalesce(severity_rank(threshold), F.lit(1))
    else:
        rank = F.lit(RANKS.get(threshold, 1))
    none = F.array().cast("array<string>")
    allowed = none if not isinstance(categories, Column) and not categories else categories if isinstance(categories, Column) else F.array(*map(F.lit, categories))
    allowed = F.coalesce(allowed, none)

    def keep(s: Column) -> Column:
        return (severity_rank(s["severity"]) >= rank) & ((s["category"] == "") | (F.size(allowed) == 0) | F.array_contains(allowed, s["category"]))

    return F.filter(spans, keep)


_SPAN = "struct<token:string,source:string,canon:string,category:string,severity:string,match_type:string>"
_HIT = "struct<original_token:string,redacted_token:string,mode:string,category:string,severity:string,source:string,canon:string>"
_PIECE = regex.compile(r"\s+|\S+")
_AFFIX = regex.compile(r"([^\p{L}\p{N}_\u0B80-\u0BFF]*)([\p{L}\p{N}_\u0B80-\u0BFF]+)([^\p{L}\p{N}_\u0B80-\u0BFF]*)", regex.S)
_STUFFED, _STUFFING = regex.compile(r"\b[\p{L}\d](?:[*._\-+~^/][\p{L}\d]){2,}\b"), regex.compile(r"[*._\-+~^/]")
_ODD, _LETTER, _GRAPHEME = regex.compile(r"[0-9@$!+|*._\-~^/]"), regex.compile(r"\p{L}"), regex.compile(r".\p{M}*", regex.S)
_SYMBOLS, _DIGITS = str.maketrans(LEET_SYMBOLS), str.maketrans(LEET_DIGITS)


def graphemes_of(word: str) -> list[str]:
    return _GRAPHEME.findall(word)


def partly_masked(word: str, mark: str) -> str:
    g = graphemes_of(word)
    k = 0 if len(g) <= 2 else 1 if len(g) <= 6 else 2
    return "".join(g[:k]) + mark * (len(g) - 2 * k) + "".join(g[len(g) - k :])


def unstuffed(word: str) -> str:
    return _STUFFED.sub(lambda m: _STUFFING.sub("", m[0]), word)


def unleeted(word: str) -> str:
    """The word with stuffing removed and digits and symbols folded to letters, by the rule of ``functions.text.leet_word``."""
    word = unstuffed(word)
    digits, symbols = sum(c in LEET_DIGITS for c in word), sum(c in LEET_SYMBOLS for c in word)
    letters = bool(_LETTER.search(word))
    if not letters and digits + symbols < 2:
        return word
    folded = word.translate(_SYMBOLS)
    return folded.translate(_DIGITS) if letters or digits >= 3 else folded


class _Redactor:
    """The rewriting of one text after another in one mode."""

    def __init__(self, mode: str, mark: str, replacements: dict[str, str], strict_token: bool) -> None:
        self.mode, self.mark, self.replacements, self.strict = mode, mark, replacements, strict_token
        self.known: dict[tuple[str, ...], dict[str, tuple | None]] = {}
        self.size = 0

    def polite(self, word: str, canon: str | None) -> str:
        own, canon = word.strip().lower(), (canon or "").strip().lower()
        for key in (own, canon):
            if key in self.replacements:
                return self.replacements[key]
        inside = (v for k, v in self.replacements.items() if k in own or (canon and k in canon))
        return next(inside, FALLBACK)

    def masked(self, word: str, span: dict) -> str:
        if self.mode == "tag":
            name = (span["category"] or "").strip() or (span["severity"] or "").strip() or "ABUSE"
            return f"[REDACTED: {name.upper()}]"
        if self.mode == "block":
            return self.mark * max(len(graphemes_of(word)), len(word))
        return self.polite(word, span["canon"]) if self.mode == "polite" else partly_masked(word, self.mark)

    def find(self, low: str, spans: dict[str, dict]) -> dict | None:
        """The span of the word, of its leet folding or of its unstuffed form, else of the first flagged word inside it."""
        folded, plain = (unleeted(low), unstuffed(low)) if _ODD.search(low) else (low, low)
        for form in (low, folded, plain):
            if form in spans:
                return spans[form]
        if self.strict:
            return None
        return next((s for w, s in spans.items() if w in low or w in folded or w == plain), None)

    def piece(self, p: str, spans: dict[str, dict]) -> tuple[str, str, str, str] | None:
        """Prefix, word, suffix and flagged word of a piece, if it holds one."""
        parts = _AFFIX.fullmatch(p)
        span = self.find(parts[2].lower(), spans) if parts else None
        if span is not None:
            return parts[1], parts[2], parts[3], span["token"].lower()
        span = self.find(p.lower(), spans)
        return None if span is None else ("", p, "", span["token"].lower())

    def pieces(self, words: tuple[str, ...]) -> dict[str, tuple | None]:
        """What is known of the pieces of texts with these flagged words, which many texts share."""
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        return self.known.setdefault(words, {})

    def text(self, raw: str, kept: list[dict]) -> dict:
        spans: dict[str, dict] = {}
        for s in kept:  # of equal words the last span counts, at the place of the first
            spans[s["token"].lower()] = s
        known = self.pieces(tuple(spans))
        shown, kind, hits = [], [], []
        for p in _PIECE.findall(raw):
            if p not in known:
                known[p] = None if p.isspace() else self.piece(p, spans)
                self.size += 1
            found = known[p]
            if found is None:
                shown.append(p)
                kind.append(p)
                continue
            before, word, after, key = found
            span = spans[key]
            masked = self.masked(word, span)
            shown.append(before + masked + after)
            kind.append(before + self.polite(word, span["canon"]) + after)
            hits.append({"original_token": word, "redacted_token": masked, "mode": self.mode, **{c: span[c] for c in ("category", "severity", "source", "canon")}})
        return {"censored": "".join(shown), "hits": hits, "kind": "".join(kind) if hits else None}


#: Pieces of text that a task remembers, and texts that it has as Python objects at once.
REMEMBERED, TOGETHER = 200_000, 128
_FIELDS = ("token", "source", "canon", "category", "severity")


def redact(rows: DataFrame, text: str = "text", spans: str = "flagged_spans", mode: str | Column = "partial", mask: str | Column | None = None, threshold: str | Column = "all", categories: list[str] | Column | None = None, replacements: dict[str, str] = POLITE, strict_token: bool = False) -> DataFrame:
    """``rows`` with censored, redacted_spans, redacted_count and polite_suggestion (null if nothing was redacted).

    Mode, mark, threshold and categories may be columns, so that each row has its own in one plan; a mode that is none is partial,
    a mark that is null the mode's own.  Only the flagged texts and the fields that redaction reads go to Python, as flat arrays.
    """
    if isinstance(mode, str) and mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    modes = F.when(mode.isin(*MODES), mode).otherwise("partial") if isinstance(mode, Column) else F.lit(mode)
    marks = F.coalesce(mask if isinstance(mask, Column) else F.lit(mask).cast("string"), F.when(modes == "partial", "*").otherwise("█"))
    result = pa.struct([("censored", pa.string()), ("hits", pa.list_(pa.struct([(c, pa.string()) for c in ("original_token", "redacted_token", "mode", "category", "severity", "source", "canon")]))), ("kind", pa.string())])

    @F.arrow_udf(f"struct<censored:string,hits:array<{_HIT}>,kind:string>")
    def rewritten(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        known: dict[tuple[str, str], _Redactor] = {}
        def some(texts: pa.Array, modes_: pa.Array, marks_: pa.Array, *fields: pa.Array) -> list[dict | None]:
            made = []
            for raw, how, mark, *lists in zip(texts.to_pylist(), modes_.to_pylist(), marks_.to_pylist(), *(x.to_pylist() for x in fields), strict=True):
                if raw is None:
                    made.append(None)
                    continue
                if (how, mark) not in known:
                    if len(known) >= 64:  # marks are free text
                        known.clear()
                    known[how, mark] = _Redactor(how, mark, dict(replacements), strict_token)
                made.append(known[how, mark].text(raw, [dict(zip(_FIELDS, x, strict=True)) for x in zip(*lists, strict=True)]))
            return made

        for columns in batches:
            # few texts at a time as Python objects, whatever the batch holds
            parts = [pa.array(some(*(x.slice(at, TOGETHER) for x in columns)), result) for at in range(0, len(columns[0]), TOGETHER)]
            yield pa.concat_arrays(parts) if parts else pa.array([], result)

    raw = F.coalesce(F.col(text), F.lit(""))
    kept = allowed_spans(F.coalesce(F.col(spans).cast(f"array<{_SPAN}>"), F.array().cast(f"array<{_SPAN}>")), threshold, categories)
    all_, made = fresh(rows, "kept"), fresh(rows, "made")
    some = F.size(all_) > 0
    out = rows.withColumn(all_, F.explode(F.array(kept)))
    lists = [F.when(some, F.col(all_)[c]) for c in _FIELDS]
    out = out.withColumn(made, rewritten(F.when(some, raw), modes, marks, *lists))
    out = out.withColumn("censored", F.coalesce(F.col(made)["censored"], raw)).withColumn("polite_suggestion", F.col(made)["kind"])
    out = out.withColumn("redacted_spans", F.coalesce(F.col(made)["hits"], F.array().cast(f"array<{_HIT}>"))).withColumn("redacted_count", F.size("redacted_spans"))
    return out.drop(all_, made)
