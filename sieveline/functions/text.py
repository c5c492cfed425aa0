"""Text normalisation, tokenising by script, masking: builders of Spark column expressions.

All are JVM expressions but for ``nfc`` and ``unescape_html``, which have no built-in and share one Arrow UDF that only sees the
rows that need it.  Java's ``(?U)`` makes white space and word boundaries Unicode-aware; ``(?d)`` lets a dot stop at \\n alone.
"""

from __future__ import annotations

import html
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Leet substitutions (fixed values).
LEET_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
LEET_SYMBOLS = {"@": "a", "$": "s", "!": "i", "+": "t", "|": "l", "*": ""}
#: French stop words (fixed values).
FRENCH_STOP_WORDS = (
    "je", "tu", "il", "elle", "nous", "vous", "ils", "elles",
    "le", "la", "les", "un", "une", "des", "du", "de", "au", "aux",
    "et", "ou", "mais", "donc", "car", "ni", "que", "qui", "quoi",
    "avec", "sans", "sur", "sous", "dans", "pour", "par", "chez",
    "est", "sont", "était", "être", "avoir", "ont", "se", "ça",
    "très", "plus", "moins", "bien", "aussi", "après", "avant",
    "cette", "ce", "cet", "ces", "mon", "ma", "mes", "ton", "ta",
    "vraiment", "merci", "bonjour", "où", "envie", "savoir",
)
#: Blocks of other Indic scripts, Arabic and Thai (fixed values).
FOREIGN_SCRIPTS = "[\\x{0900}-\\x{097F}\\x{0980}-\\x{09FF}\\x{0A00}-\\x{0A7F}\\x{0A80}-\\x{0AFF}\\x{0B00}-\\x{0B7F}\\x{0C00}-\\x{0C7F}\\x{0C80}-\\x{0CFF}\\x{0D00}-\\x{0D7F}\\x{0600}-\\x{06FF}\\x{0E00}-\\x{0E7F}]"
TAMIL_BLOCK = "[\\x{0B80}-\\x{0BFF}]"
SCRIPTS = ("TAMIL", "LATIN", "DIGIT", "OTHER_SCRIPT", "SPACE", "SYMBOL")

#: Texts that are Python objects at a time.
AT_ONCE = 128

_WS = r"(?U)\s+"
_PIECES = r"(?U)\s+|\S+"
_STUFFED = r"(?Us)\b[\p{L}\d](?:[*._\-+~^/][\p{L}\d]){2,}\b"
_SPACED = r"(?Us)(?:\b\p{L}\s+){2,}\b\p{L}\b"
#: Letters, digits and signs of ASCII, each run whole.
_ASCII_RUNS = "".join(f"{run}++(?![^\\x00-\\x7F])|" for run in ("[A-Za-z]", "[0-9]", r"[!-/:-@\[-`{-\x7F\x00-\x08\x0E-\x1F]"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


@F.arrow_udf(StringType())
def _clean(texts: pa.Array, decode: pa.Array, compose: pa.Array) -> pa.Array:
    def made(text: str, d: bool, n: bool) -> str:
        out = html.unescape(text) if d else text
        return unicodedata.normalize("NFC", out) if n else out

    if texts.null_count == len(texts):  # none of them needs it
        return pa.nulls(len(texts), pa.string())
    # pyarrow makes a list of what it is given, so that only AT_ONCE texts are Python objects at a time
    parts = []
    for at in range(0, len(texts), AT_ONCE):
        some = zip(*(c.slice(at, AT_ONCE) for c in (texts, decode, compose)), strict=True)
        parts.append(pa.array([made(t.as_py(), d.as_py(), n.as_py()) if t.is_valid else None for t, d, n in some], pa.string()))
    return pa.concat_arrays(parts)


def clean(c: Column, decode_html: bool = True, nfc: bool = True, by=_clean) -> Column:
    """HTML entities decoded, then NFC.  Only texts with an entity or beyond Latin-1 letters travel to Python.

    ``by``: what they travel to, a function of the text and the two options.
    """
    if not decode_html and not nfc:
        return c
    needed = F.lit(False)
    if decode_html:
        needed = needed | c.rlike("&[#A-Za-z]")
    if nfc:
        needed = needed | c.rlike("[^\\x{0000}-\\x{02FF}]")
    return F.coalesce(by(F.when(needed, c), F.lit(decode_html), F.lit(nfc)), c)


def nfc(c: Column) -> Column:
    return clean(c, decode_html=False)


def unescape_html(c: Column) -> Column:
    return clean(c, nfc=False)


def strip_urls(c: Column, replacement: str = "") -> Column:
    return F.regexp_replace(c, r"(?iU)(?:https?://|www\.)\S+", _literal(replacement))


def strip_mentions(c: Column, replacement: str = "") -> Column:
    return F.regexp_replace(c, r"(?U)(?<![\w@])@\w+", _literal(replacement))


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def collapse_repeats(c: Column, most: int = 2) -> Column:
    """Runs of a character longer than ``most`` become ``most`` of it."""
    if most < 1:
        raise ValueError("a run keeps one character at least")
    return F.regexp_replace(c, f"(?d)(.)\\1{{{most},}}", "$1" * most)


def _rewritten(c: Column, pattern: str, drop: str) -> Column:
    """Drop characters inside the matches of a pattern only: matches and single characters alternate."""
    parts = F.regexp_extract_all(c, F.lit(pattern + "|."), F.lit(0))
    return F.when(c.rlike(pattern), F.array_join(F.transform(parts, lambda p: F.when(F.length(p) > 1, F.regexp_replace(p, drop, "")).otherwise(p)), "")).otherwise(c)


def destuff_punctuation(c: Column) -> Column:
    return _rewritten(c, _STUFFED, r"[*._\-+~^/]")


def destuff_spaces(c: Column) -> Column:
    return _rewritten(c, _SPACED, _WS)


def destuff(c: Column) -> Column:
    return destuff_spaces(destuff_punctuation(_text(c)))


def pieces(c: Column) -> Column:
    """Runs of white space and of other characters, in order: joined they are the text."""
    return F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))


def leet_word(w: Column) -> Column:
    """Digits and symbols of a word folded to letters, if the word has letters or two of either."""
    digits, symbols = "".join(LEET_DIGITS), "".join(LEET_SYMBOLS)
    letters = F.regexp_count(w, F.lit(r"\p{L}"))
    n_digits = F.length(w) - F.length(F.translate(w, digits, ""))
    n_symbols = F.length(w) - F.length(F.translate(w, symbols, ""))
    # translate drops characters past the end of its replacement, so the one without a letter comes last
    folded = F.translate(w, symbols, "".join(LEET_SYMBOLS.values()))
    both = F.translate(folded, digits, "".join(LEET_DIGITS.values()))
    whole = F.when((letters > 0) | (n_digits >= 3), both).otherwise(folded)
    return F.when((letters > 0) | (n_digits + n_symbols >= 2), whole).otherwise(w)


def leet(c: Column) -> Column:
    """Stuffing removed, then each word folded; white space stays."""
    return F.array_join(F.transform(pieces(destuff(c)), leet_word), "")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _WS, " "), "^ | $", "")


@dataclass(frozen=True)
class NormalizeOptions:
    nfc: bool = True
    decode_html: bool = True
    remove_urls: bool = True
    remove_mentions: bool = True
    collapse_repeats: bool = True
    max_repeat: int = 2
    leet: bool = False
    url_replacement: str = ""
    mention_replacement: str = ""


def normalize(c: Column, options: NormalizeOptions = NormalizeOptions()) -> Column:
    """The whole pipeline; null becomes empty."""
    o = options
    out = clean(_text(c), o.decode_html, o.nfc)
    if o.remove_urls:
        out = strip_urls(out, o.url_replacement)
    if o.remove_mentions:
        out = strip_mentions(out, o.mention_replacement)
    if o.collapse_repeats:
        out = collapse_repeats(out, o.max_repeat)
    if o.leet:
        out = leet(out)
    return collapse_space(out)


def token_texts(c: Column, spaces: bool = False) -> Column:
    """Maximal runs of one script, as an array.

    Runs of ASCII that a character beyond ASCII does not follow come first: they are the usual ones, and looking up the script of
    each of their characters is what takes the time.
    """
    symbol = r"[^\s\p{L}\p{Nd}]+"
    return F.regexp_extract_all(c, F.lit(r"(?U)" + _ASCII_RUNS + r"\p{IsTamil}+|\p{IsLatin}+|\p{Nd}+|\p{L}+|" + (r"\s+|" if spaces else "") + symbol), F.lit(0))


def script_of(token: Column) -> Column:
    """The script of one token.  A letter of ASCII at its beginning decides without a pattern."""
    first = F.ascii(token)
    return (
        F.when(first.between(65, 90) | first.between(97, 122), "LATIN")
        .when(token.rlike(r"^\p{IsTamil}"), "TAMIL")
        .when(token.rlike(r"^\p{IsLatin}"), "LATIN")
        .when(token.rlike(r"^\p{Nd}"), "DIGIT")
        .when(token.rlike(r"^\p{L}"), "OTHER_SCRIPT")
        .when(token.rlike(r"(?U)^\s"), "SPACE")
        .otherwise("SYMBOL")
    )


def tag_tokens(c: Column, spaces: bool = False) -> Column:
    """array<struct<text, script>>."""
    return F.transform(token_texts(_text(c), spaces), lambda t: F.struct(t.alias("text"), script_of(t).alias("script")))


def normalize_and_tag(c: Column, options: NormalizeOptions = NormalizeOptions(), spaces: bool = False) -> Column:
    """struct<clean, tokens> of a text: normalised, then cut by script."""
    return F.transform(F.array(normalize(c, options)), lambda t: F.struct(t.alias("clean"), tag_tokens(t, spaces).alias("tokens")))[0]


def pool_text(c: Column) -> Column:
    """The form in which texts of a pool are compared: normalised, in lower case."""
    return F.lower(normalize(c))


def surface_script(surface: Column) -> Column:
    """The script that a surface is matched by: its own if it is one run, else Tamil before Latin, else symbols."""
    found = token_texts(surface)
    single = script_of(F.element_at(found, 1))
    mixed = F.when(surface.rlike(r"\p{IsTamil}"), "TAMIL").when(surface.rlike(r"\p{IsLatin}"), "LATIN").otherwise("SYMBOL")
    return F.when(F.size(found) == 0, "SYMBOL").when(F.size(found) == 1, single).otherwise(mixed)


def dominant_script(word: Column) -> Column:
    tamil, latin = F.regexp_count(word, F.lit(TAMIL_BLOCK)), F.regexp_count(word, F.lit("[A-Za-z]"))
    return F.when(tamil >= latin, "TAMIL").otherwise("LATIN")


def vocabulary_words(c: Column) -> Column:
    """Lower-case runs of three or more Tamil or Latin characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{IsTamil}{3,}|\p{IsLatin}{3,}"), F.lit(0))


def embedding_tokens(c: Column) -> Column:
    """Lower-case tokens that are Tamil, Latin or digits."""
    return F.filter(F.transform(token_texts(_text(c)), F.lower), lambda t: t.rlike(r"^(\p{IsTamil}|\p{IsLatin}|\p{Nd})"))


def dedup_key(c: Column, keep_marks: bool = False) -> Column:
    """The key of near-duplicate removal; combining marks are dropped unless kept."""
    out = F.regexp_replace(F.lower(collapse_space(_text(c))), _WS, " ")
    out = collapse_repeats(out, 2)
    out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s" + (r"\p{M}" if keep_marks else "") + "]", "")
    return collapse_space(out)


def stop_word_hits(c: Column, words: tuple[str, ...] = FRENCH_STOP_WORDS) -> Column:
    """How many of a text's words are in the list."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def graphemes(c: Column) -> Column:
    """A base character with the marks that follow; a leading mark starts its own."""
    return F.regexp_extract_all(c, F.lit(r"(?s).\p{M}*"), F.lit(0))


def mask_partial(c: Column, mark: str = "*") -> Column:
    g = graphemes(c)
    n = F.size(g)
    ends = lambda k: F.concat(F.array_join(F.slice(g, 1, k), ""), F.repeat(F.lit(mark), n - 2 * k), F.array_join(F.slice(g, -k, k), ""))
    return F.when(n <= 2, F.repeat(F.lit(mark), n)).when(n <= 6, ends(1)).otherwise(ends(2))


def mask_tag(category: Column, severity: Column) -> Column:
    name = lambda c: F.nullif(strip(c), F.lit(""))
    return F.concat(F.lit("[REDACTED: "), F.upper(F.coalesce(name(category), name(severity), F.lit("ABUSE"))), F.lit("]"))


def mask_block(c: Column, mark: str = "█") -> Column:
    return F.repeat(F.lit(mark), F.greatest(F.size(graphemes(c)), F.length(c)))


def polite(token: Column, canon: Column, replacements: dict[str, str], fallback: str) -> Column:
    """The replacement of the token, else of its canonical form, else of the first key that either contains."""
    if not replacements:
        return F.lit(fallback)
    keys = F.array(*map(F.lit, replacements))
    values = F.map_from_arrays(keys, F.array(*map(F.lit, replacements.values())))
    t, c = F.lower(strip(token)), F.lower(strip(F.coalesce(canon, F.lit(""))))
    inside = F.filter(keys, lambda k: F.contains(t, k) | ((c != "") & F.contains(c, k)))
    return F.coalesce(F.try_element_at(values, t), F.try_element_at(values, c), F.try_element_at(values, F.try_element_at(inside, F.lit(1))), F.lit(fallback))


_CORE = r"[\p{L}\p{N}_\x{0B80}-\x{0BFF}]"
_NOT_CORE = r"[^\p{L}\p{N}_\x{0B80}-\x{0BFF}]"
AFFIX = rf"(?s)^({_NOT_CORE}*)({_CORE}+)({_NOT_CORE}*)$"


def affixes(piece: Column) -> tuple[Column, Column, Column]:
    """Leading punctuation, core and trailing punctuation; all empty if the piece is not of that form."""
    return tuple(F.regexp_extract(piece, AFFIX, k) for k in (1, 2, 3))


def edit_threshold(length: Column) -> Column:
    return F.when(length <= 6, 1).when(length <= 10, 2).otherwise(3)


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """The edit distance, or most + 1 if it is greater."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters agree."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def char_ids(word: Column, ids: dict[str, int], most: int = 32, unknown: int = 1, pad: int = 0) -> Column:
    """The ids of a word's first characters; an empty word is one pad."""
    table = F.map_from_arrays(F.array(*map(F.lit, ids)), F.array(*map(F.lit, ids.values())))
    chars = F.regexp_extract_all(F.substring(word, 1, most), F.lit("(?s)."), F.lit(0))
    return F.when(F.size(chars) == 0, F.array(F.lit(pad))).otherwise(F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown))))


def remove_words(c: Column, words: list[str], mark: str = "") -> Column:
    """Each word, in any case, removed from a text or replaced by as many marks."""
    for w in words:
        c = F.regexp_replace(c, "(?i)\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E", _literal(mark * len(w)))
    return c
