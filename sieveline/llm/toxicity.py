"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

A lexicon of terms (whole words) and stems (beginnings of words) is held as a trie.  A word of a text is found in it by running
the trie's letters through the word's Levenshtein automaton, bit-parallel states of 0, 1 and 2 edits, so that misspelled terms
are caught; a branch ends where no state is left.  Words near a term that clean training rows hold are ordinary words, not
misspellings, and are guarded.  Each hit counts by its entry's log odds, less for each edit, and by its context window: inside
quotation marks or beside words of reporting it counts QUOTED times, beside words of address ADDRESSED times.  The sum becomes
a score by a logistic fit.

The lexicon and the fit are learned from labelled rows, from the SAMPLE rows with the least hash at most, the documented bound
of all that the driver holds; identical texts count once.  A lexicon may be given instead, and is then only weighed.  All texts
are scored whole, on the executors, without a shuffle.

Defined results: null and empty texts have no hits and get the score of a text without any; rows without an id are scored and
never trained on; without labels of both kinds the score rests on the given lexicon, or is the share of label 1; of entries with
equal edits the first counts; rows that repeat get the same score; very long texts are scored whole, word by word; an empty table
gives an empty result; other columns are ignored or carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import cut, whole_texts

#: Most labelled rows that are learned from.
SAMPLE = 20_000
STEMS = (3, 4, 5, 6)
#: A candidate must be this much likelier in label 1 (a G statistic; the second is for what is not covered yet).
G_FIRST, G_LEFT = 12.0, 14.0
#: Least log odds of an entry (chosen on three folds of training rows); share of a stem's rows that a narrower entry must explain to stand for it.
LEAST_ODDS, NARROW = 1.5, 0.85
#: A row of label 1 is covered by so many entries.
COVER = 3
WINDOW = 4
QUOTED, ADDRESSED, PER_EDIT = 0.25, 1.5, 0.6
_STRIP = " \t\n\r\x0b\x0c.,;:!?*#$%&()[]{}<>/\\|~^_+=-'\"`´‘’“”„«»…¡¿"
_QUOTES = re.compile("[\"“”„«»]")
#: Fixed word lists of reporting and of address.
_REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word term insult slur".split())
_ADDRESS = frozenset("you your youre u ya du dich dein ihr tu toi vous usted ustedes".split())


def edits(size: int, stem: bool) -> int:
    """The edits that a term or stem of so many letters allows."""
    return 0 if size < 5 + stem else 1 if size < 8 + stem else 2


@dataclass(frozen=True)
class Lexicon:
    """entries: (letters, whether it is a stem, weight)."""

    entries: tuple[tuple[str, bool, float], ...]
    guards: frozenset[str] = frozenset()


class Automaton:
    """The trie of a lexicon, met with the Levenshtein automata of words."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.trie = lexicon, {}
        parts = set()
        for at, (letters, stem, _) in enumerate(lexicon.entries):
            node = self.trie
            for c in letters:
                node = node.setdefault(c, {})
            node.setdefault(None, []).append((at, stem, edits(len(letters), stem)))
            k = edits(len(letters), stem) + 1
            cuts = [round(len(letters) * i / k) for i in range(k + 1)]
            parts |= {letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a}
        # with k edits at most, one of k + 1 parts of an entry is in the word as it is
        self.parts = re.compile("|".join(map(re.escape, sorted(parts)))) if parts else None
        self.memory: dict[str, tuple[int, int] | None] = {}

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the best entry for a bare word in lower case."""
        if self.parts is None or not self.parts.search(word):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 2 << i
        full, whole = (2 << len(word)) - 1, 1 << len(word)
        best: tuple[int, int] | None = None
        stack = [(self.trie, (1, 3 & full, 7 & full))]  # bit i of state e: i letters of the word are read with e edits
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c is None:
                    for at, stem, most in child:
                        for e in range(most + 1):
                            if state[e] if stem else state[e] & whole:
                                if best is None or (e, at) < best:
                                    best = (e, at)
                                break
                    continue
                m = masks.get(c, 0)
                s0 = state[0] << 1 & m
                s1 = (state[1] << 1 & m | state[0] | state[0] << 1 | s0 << 1) & full
                s2 = (state[2] << 1 & m | state[1] | state[1] << 1 | s1 << 1) & full
                if s2:
                    stack.append((child, (s0, s1, s2)))
        if best and best[0] and word in self.lexicon.guards:
            return None
        return best

    def word(self, raw: str) -> tuple[int, int] | None:
        if raw in self.memory:
            return self.memory[raw]
        found = self.find(raw.strip(_STRIP))
        if len(self.memory) > 400_000:
            self.memory.clear()
        self.memory[raw] = found
        return found

    def hits(self, text: str) -> list[tuple[int, int, float, str]]:
        """(entry, edits, factor of the context, bare word) of the hits of a text."""
        words = text.lower().split()
        marked = {w for w in set(words) if self.word(w)}
        if not marked:
            return []
        out = []
        for i, w in enumerate(words):
            if w in marked:
                e, at = self.word(w)
                out.append((at, e, _context(words, i), w.strip(_STRIP)))
        return out

    def evidence(self, text: str) -> float:
        """The summed weight of a text's distinct hits."""
        best: dict[str, float] = {}
        for at, e, factor, word in self.hits(text):
            x = self.lexicon.entries[at][2] * PER_EDIT**e * factor
            best[word] = max(x, best.get(word, 0.0))
        return sum(best.values())


def _context(words: list[str], i: int) -> float:
    before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
    opened = bool(_QUOTES.search(words[i][: -len(words[i].lstrip(_STRIP)) or None])) or any(_QUOTES.match(w) for w in before)
    closed = any(_QUOTES.search(w[-2:]) for w in (words[i], *after))
    bare = {w.strip(_STRIP) for w in (*before, *after)}
    if opened and closed or bare & _REPORTING:
        return QUOTED
    return ADDRESSED if bare & _ADDRESS else 1.0


def _g(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The G statistic of counts a of n1 and b of n0, negative if b is the likelier."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p = (a + b) / max(n1 + n0, 1)
    term = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    out = 2 * (term(a, n1 * p) + term(b, n0 * p) + term(n1 - a, n1 * (1 - p)) + term(n0 - b, n0 * (1 - p)))
    return np.where(a * n0 >= b * n1, out, -out)


def _candidates(text: str) -> set[str]:
    words = {w.strip(_STRIP) for w in set(text.lower().split())}
    words = {w for w in words if len(w) >= 3 and w.isalpha()}
    return {"=" + w for w in words if len(w) <= 24} | {w[:k] for w in words for k in STEMS if len(w) > k}


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("ones", pa.int64()), ("rows", pa.int64())])
    ones, rows = Counter(), Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([ones[k] for k in rows], pa.int64()), pa.array(list(rows.values()), pa.int64())], schema=schema)
        ones.clear()
        rows.clear()
        return batch

    for batch in batches:
        for text, label in zip(whole_texts(batch), batch.column(1).to_pylist(), strict=True):
            found = _candidates(text.decode("utf-8"))
            rows.update(found)
            if label:
                ones.update(found)
            if len(rows) > 200_000:
                yield out()
    yield out()


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the labelled rows to learn from, each text once: those whose crc32(id) mod 5 is not 0.

    The sample is so small by definition that its ids are sent to all tasks; no text is shuffled to find it.
    """
    fit = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("toxic")).where("i IS NOT NULL AND toxic IN (0, 1)")
    fit = fit.where(F.crc32(F.col("i").cast("string")) % 5 != 0).groupBy("i").agg(F.max("toxic").alias("toxic"))
    fit = fit.orderBy(F.xxhash64(F.lit(7), "i"), "i").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(fit), "i")
    return rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.max(F.struct("toxic", "text")).alias("x")).select("x.text", "x.toxic")


def learn(rows: DataFrame, entries: list[tuple[str, bool]] | None = None) -> tuple[Lexicon, float, float]:
    """The lexicon, slope and intercept that a bounded table of text and toxic teaches."""
    rows = cut(rows.select("text", "toxic"), "toxic")
    sums = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).first()
    n, n1 = sums.n, sums.ones or 0
    n0 = n - n1
    if entries is None:
        entries = _chosen(rows, n1, n0) if n1 and n0 else []
    bare = Lexicon(tuple((w, stem, 1.0) for w, stem in entries))
    found = rows.select("text", "toxic").mapInArrow(_hit_rows(bare), "toxic int, at array<int>, edits array<int>, words array<string>, factors array<double>").toPandas()
    clean = {w for label, e, ws in zip(found.toxic, found.edits, found.words, strict=True) if not label for k, w in zip(e, ws, strict=True) if k}
    a, b = np.zeros(len(entries)), np.zeros(len(entries))
    for label, at, e in zip(found.toxic, found["at"], found.edits, strict=True):
        for i in {i for i, k in zip(at, e, strict=True) if not k}:
            (a if label else b)[i] += 1
    weights = np.clip(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)), 0.0, 6.0) if n1 and n0 else np.full(len(entries), 3.0)
    lexicon = Lexicon(tuple((w, stem, float(x)) for (w, stem), x in zip(entries, weights, strict=True)), frozenset(clean))
    if not (n1 and n0):
        share = min(max(n1 / n if n else 0.05, 0.01), 0.99)
        return lexicon, 1.0, math.log(share / (1 - share)) if not entries or n else -3.0
    xs = []
    for at, e, ws, fs in zip(found["at"], found.edits, found.words, found.factors, strict=True):
        best: dict[str, float] = {}
        for i, k, w, f in zip(at, e, ws, fs, strict=True):
            if not (k and w in clean):
                best[w] = max(best.get(w, 0.0), weights[i] * PER_EDIT**k * f)
        xs.append(sum(best.values()))
    return lexicon, *_logistic(np.minimum(xs, 40.0), found.toxic.to_numpy(float))


def _chosen(rows: DataFrame, n1: int, n0: int) -> list[tuple[str, bool]]:
    """Entries that cover rows of label 1, the likeliest first; none inside another."""
    counts = rows.mapInArrow(_count_rows, "term string, ones long, rows long").groupBy("term").agg(F.sum("ones").alias("a"), F.sum("rows").alias("r"))
    p = n1 / (n1 + n0)
    top = counts.where((F.col("a") >= 3) & (F.col("a") > F.col("r") * (p + 0.4 * (1 - p)))).withColumn("score", F.col("a") * F.col("a") / F.col("r"))
    # the sample bounds how many terms there are; most go by the first test, where they are counted
    g = lambda x, n: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    a, b, r = F.col("a").cast("double"), (F.col("r") - F.col("a")).cast("double"), F.col("r") / (n1 + n0)
    top = top.where(2 * (g(a, n1 * r) + g(b, n0 * r) + g(n1 - a, n1 * (1 - r)) + g(n0 - b, n0 * (1 - r))) >= G_FIRST - 0.01)
    top = top.orderBy(F.desc("score"), F.length("term"), "term").toPandas()
    top = top[_g(top.a, top.r - top.a, n1, n0) >= G_FIRST]
    terms = top.term.tolist()
    if not terms:
        return []
    index = {t: i for i, t in enumerate(terms)}

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32()))])
        for batch in batches:
            at = [sorted(index[t] for t in _candidates(x.decode("utf-8")) if t in index) for x in whole_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(at, pa.list_(pa.int32()))], schema=schema)

    has = rows.mapInArrow(having, "toxic int, at array<int>").where(F.size("at") > 0).toPandas()
    of_term: list[tuple[list[int], list[int]]] = [([], []) for _ in terms]
    for r, (label, at) in enumerate(zip(has.toxic, has["at"], strict=True)):
        for i in at:
            of_term[i][0 if label else 1].append(r)
    need = np.where(has.toxic.to_numpy() == 1, COVER, 0)
    b = np.array([len(x[1]) for x in of_term], float)
    odds = np.log((np.array([len(x[0]) for x in of_term]) + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    of_term = [x if o >= LEAST_ODDS else ([], []) for x, o in zip(of_term, odds, strict=True)]
    open_, out = np.ones(len(terms), bool), []
    while open_.any():
        a = np.array([(need[x[0]] > 0).sum() if o else 0 for x, o in zip(of_term, open_, strict=True)], float)
        g = np.where(open_ & (a > 0), _g(a, b, max(n1, 1), n0), -1.0)
        best = int(np.lexsort((np.array([len(t) for t in terms]), -g))[0])
        if g[best] < G_LEFT:
            break
        inner = [i for i in np.flatnonzero(open_) if i != best and not terms[best].startswith("=") and terms[i].lstrip("=").startswith(terms[best]) and a[i] >= NARROW * a[best]]
        best = max(inner, key=lambda i: (terms[i].startswith("="), a[i]), default=best)  # the word itself, or a longer stem, if it explains the stem
        term = terms[best]
        out.append((term.lstrip("="), not term.startswith("=")))
        need[of_term[best][0]] -= 1
        bare = term.lstrip("=")
        for i, t in enumerate(terms):
            t = t.lstrip("=")
            open_[i] &= not (t == bare or (t.startswith(bare) or bare.startswith(t)))
    return out


def _hit_rows(lexicon: Lexicon):
    schema = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("edits", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("factors", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            hits = [automaton.hits(t.decode("utf-8")) for t in whole_texts(batch)]
            columns = [pa.array([[h[k] for h in row] for row in hits], schema.field(j).type) for j, k in ((1, 0), (2, 1), (3, 3), (4, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *columns], schema=schema)

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not negative) and intercept by Newton's method."""
    w = np.zeros(2)
    m = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + ridge * np.eye(2), m.T @ (y - p) - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _score_rows(lexicon: Lexicon, slope: float, intercept: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            x = np.minimum([automaton.evidence(t.decode("utf-8")) for t in whole_texts(batch)], 40.0)
            scores = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, entries: list[tuple[str, bool]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    lexicon, slope, intercept = learn(training_rows(docs, labels, sample), entries)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score_rows(lexicon, slope, intercept), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, by the same model, with their own columns."""
    lexicon, slope, intercept = learn(training_rows(docs, labels, options.get("sample", SAMPLE)), options.get("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            x = np.minimum([automaton.evidence(t.decode("utf-8")) for t in whole_texts(batch)], 40.0)
            yield batch.filter(pa.array(slope * x + intercept < 0))

    return docs.mapInArrow(run, docs.schema)
