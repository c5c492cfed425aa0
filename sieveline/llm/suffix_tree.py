"""Language-model scoring by a probabilistic suffix tree over words.

The symbols are the frequent words (at least LEAST_WORD of all tokens, so at most 1 / LEAST_WORD of them), the end of a text,
and one symbol for all rarer words, which are told apart by their own counts.  A context is retained if its next symbols diverge
from what its longest retained suffix predicts by more than their number pays for (a minimum description length test on n times
the Kullback-Leibler divergence).  Next-symbol distributions keep pairs that occur twice at least, are discounted, and give the
rest of their mass to the suffix.  A position is scored in the longest suffix state that it reaches.

Contexts of up to ``depth`` symbols are candidates if they occur often; they make up the tree that is sent to all tasks.  What
counts as often grows as the power GROWTH of the tokens, so that this tree gets richer with the input, by its power 1 - GROWTH,
and still has a proven bound: least(n) times its pairs are no more than n tokens a level.  Every rare word that occurs is a
context of its own, too, a refinement of the symbol of all rare words; these contexts are as many as the corpus has, so they
never travel to all tasks: the tokens that follow rare words are dealt by the word, and counted, tested and scored there.  They
are no hot keys, since the words are rare.

Defined results: null and empty texts are their end alone; a null id counts as not held out; rows that repeat count and are
scored each; very long texts are laid out whole, one at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import cut, whole_texts

LEAST_WORD = 1e-6
#: How often a context and a pair of the tree occur in SCALE tokens at least; in others, by the power GROWTH of their number.
LEAST_CONTEXT, LEAST_PAIR, SCALE, GROWTH = 1300, 32, 1 << 26, 2 / 3
DEPTH, DISCOUNT = 3, 0.5
RARE, END, BEGIN, FIRST = 0, 1, 2, 3
#: Bits of a symbol in a key of several; 1 / LEAST_WORD symbols fit.
BITS = 21
#: Tokens, or distinct words, that a task counts before it passes them on.
COUNTED, DISTINCT = 1 << 21, 250_000
#: Rare tokens that a task holds beside those of one word.
HELD = 200_000


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words, and of the end as the empty word."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for text in whole_texts(batch):
            counts.update(text.lower().split())
            if len(counts) > DISTINCT:
                yield out()
        counts[b""] += batch.num_rows
    yield out()


def _symbol_rows(frequent: list[str]):
    """Each text as symbols, with its rare words aside."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.list_(pa.int32())), ("rare", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w.encode(): i for i, w in enumerate(frequent, FIRST)}
        get = index.get
        for batch in (x.slice(at, 128) for x in batches for at in range(0, x.num_rows, 128)):
            ids, rare = [], []
            for text in whole_texts(batch):
                words = text.lower().split()
                symbols = [get(w, RARE) for w in words]
                rare.append([w.decode() for w, s in zip(words, symbols, strict=True) if not s])
                symbols.append(END)
                ids.append(np.array(symbols, dtype=np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))), pa.array(rare, pa.list_(pa.string()))], schema=schema)

    return run


def _laid(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows of a batch in one line, the beginning before each row, and each row's length with it."""
    lists = batch.column(k)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.insert(values, starts, BEGIN).astype(np.int64), sizes + 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of values in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _context_keys(line: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For each place the ``length`` symbols before it as one key, or -1 where a row has fewer."""
    key = np.zeros(len(line), dtype=np.int64)
    for back in range(length, 0, -1):
        key = key << BITS
        key[back:] |= line[:-back] if back < len(line) else 0
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    key[np.arange(len(line)) - starts < length] = -1
    return key


def _pair_rows(contexts: np.ndarray, length: int):
    """Counts of (place of the context among the candidates, next symbol)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            line, sizes = _laid(batch, 0)
            at = _find(contexts, _context_keys(line, sizes, length))
            good = at >= 0
            held.append(at[good] << BITS | line[good])
            size += int(good.sum())
            if size > COUNTED:
                yield out()
                size = 0
        yield out()

    return run


@dataclass
class Tree:
    """State 0 is the root; ``pairs`` are sorted keys ``state << BITS | next`` with their discounted shares."""

    root: np.ndarray  # probability of each symbol without context
    contexts: list[np.ndarray]  # by length: sorted keys
    states: list[np.ndarray]  # by length: the state of each key
    parent: np.ndarray
    left: np.ndarray  # mass that a state gives to its suffix
    pairs: np.ndarray
    shares: np.ndarray

    def state(self, line: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The longest suffix state at each place."""
        out = np.zeros(len(line), dtype=np.int64)
        for length, (keys, states) in enumerate(zip(self.contexts, self.states, strict=True), 1):
            if len(keys):
                at = _find(keys, _context_keys(line, sizes, length))
                out = np.where(at >= 0, states[at], out)
        return out

    def probability(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """P(symbol | state): kept shares of the state and its suffixes, then the root's."""
        out, mass, state = np.zeros(len(state)), np.ones(len(state)), state.copy()
        live = np.flatnonzero(state)
        while len(live):
            s = state[live]
            at = _find(self.pairs, s << BITS | symbol[live])
            hit = at >= 0
            out[live[hit]] += mass[live[hit]] * self.shares[at[hit]]
            mass[live] *= self.left[s]
            state[live] = self.parent[s]
            live = live[state[live] > 0]
        return out + mass * self.root[symbol]


def least(n: int, at_scale: float) -> int:
    """How often something must occur in n tokens to be in the tree."""
    return max(2, math.ceil(at_scale * (n / SCALE) ** GROWTH))


def grow(symbols: DataFrame, root: np.ndarray, n: int, depth: int = DEPTH) -> Tree:
    """Grow the tree level by level from the symbols (ids) of the training rows.  The driver holds what ``least`` bounds."""
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"the depth is from 1 to {DEPTH}")
    tree = Tree(root, [], [], np.zeros(1, np.int64), np.ones(1), np.empty(0, np.int64), np.empty(0))
    context_least, pair_least = least(n, LEAST_CONTEXT), least(n, LEAST_PAIR)
    candidates = np.flatnonzero(root * (n + 2) >= context_least).astype(np.int64)
    candidates = np.unique(np.concatenate([candidates[candidates != END], [BEGIN]]))
    for length in range(1, depth + 1):
        if not len(candidates):
            break
        counts = symbols.mapInArrow(_pair_rows(candidates, length), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        totals = counts.groupBy(F.shiftright("pair", BITS).alias("at")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= pair_least, F.col("n"))).alias("kept"))
        both = counts.where(F.col("n") >= pair_least).select("pair", "n").unionByName(totals.where("kept IS NOT NULL").select((-F.col("at") - 1).alias("pair"), "n")).toPandas()
        total = np.zeros(len(candidates), dtype=np.int64)
        sums, found = both[both.pair < 0], both[both.pair >= 0].sort_values("pair")
        total[(-sums.pair - 1).to_numpy(np.int64)] = sums.n
        pair, count = found.pair.to_numpy(np.int64), found.n.to_numpy(np.int64)
        at, symbol = pair >> BITS, pair & ((1 << BITS) - 1)
        parents = _suffix_states(tree, candidates, length)
        expected = tree.probability(parents[at], symbol)
        kept = np.bincount(at, count, len(candidates))
        width = np.bincount(at, minlength=len(candidates))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.bincount(at, count * np.log(count / total[at] / expected), len(candidates)).astype(float)
            rest, rest_expected = total - kept, np.maximum(1 - np.bincount(at, expected, len(candidates)), 1e-12)
            gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(total, 1) / rest_expected), 0)
            price = 0.5 * width * np.log(np.maximum(total, 2))
        retained = (width > 0) & (gain > price)
        new = np.full(len(candidates), -1, dtype=np.int64)
        new[retained] = len(tree.parent) + np.arange(retained.sum())
        shares = (count - DISCOUNT) / np.maximum(total[at], 1)
        mine = retained[at]
        left = 1 - np.bincount(at, shares, len(candidates))
        keys = np.concatenate([tree.pairs, new[at[mine]] << BITS | symbol[mine]])
        order = np.argsort(keys)
        tree = Tree(
            root,
            [*tree.contexts, candidates[retained]],
            [*tree.states, new[retained]],
            np.concatenate([tree.parent, parents[retained]]),
            np.concatenate([tree.left, left[retained]]),
            keys[order],
            np.concatenate([tree.shares, shares[mine]])[order],
        )
        longer = (count >= context_least) & (symbol != END)
        candidates = np.unique(candidates[at[longer]] << BITS | symbol[longer]) if length < depth else np.empty(0, np.int64)
    return tree


def _suffix_states(tree: Tree, keys: np.ndarray, length: int) -> np.ndarray:
    """The state of the longest retained proper suffix of each key."""
    out = np.zeros(len(keys), dtype=np.int64)
    for shorter in range(1, length):
        at = _find(tree.contexts[shorter - 1], keys & ((1 << BITS * shorter) - 1))
        if len(tree.contexts[shorter - 1]):
            out = np.where(at >= 0, tree.states[shorter - 1][at], out)
    return out


def _score_rows(tree: Tree, counts: np.ndarray):
    """What the symbols of each row give: tokens, known ones, log10 sums under the base (without its divisor) and the tree, and
    for each rare word the symbol that follows it with its probability under the tree."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("tree", pa.float64()), ("rare", pa.list_(pa.string())), ("next", pa.list_(pa.int32())), ("p", pa.list_(pa.float64()))])
    base = np.log10(counts + 1.0)
    base[RARE] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                line, sizes = _laid(part, 3)
                scored = line != BEGIN
                p = np.ones(len(line))
                p[scored] = tree.probability(tree.state(line, sizes)[scored], line[scored])
                starts = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                known = add(((line != RARE) & scored & (counts[line] > 0)).astype(np.int64))
                after = np.flatnonzero(line == RARE) + 1  # a rare word is never the last symbol of its row
                offsets = pa.array(np.concatenate([[0], np.cumsum(add((line == RARE).astype(np.int64)))]).astype(np.int32))
                follow = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (line[after].astype(np.int32), p[after])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes - 1), pa.array(known), pa.array(add(np.where(scored, base[line], 0.0))), pa.array(add(np.log10(p))), part.column(4), *follow], schema=schema)

    return run


def _refined(total: np.ndarray, first: np.ndarray, pair: np.ndarray, train: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The probability at each row, of rows in the order of (word, next symbol).

    ``total`` is each row's number of training rows of its word, ``first`` the start of each word, ``pair`` of each (word, next).
    """
    n = len(p)
    sizes = np.diff([*pair, n])
    word = np.searchsorted(first, pair, side="right") - 1  # of each pair
    count = np.add.reduceat(train.astype(np.int64), pair)
    of = total[pair]
    expected = np.add.reduceat(p * train, pair) / np.maximum(count, 1)
    kept = count >= 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.bincount(word, np.where(kept, count * np.log(count / np.maximum(of, 1) / np.maximum(expected, 1e-300)), 0.0), len(first))
    rest = total[first] - np.bincount(word, np.where(kept, count, 0), len(first))
    left_expected = np.maximum(1 - np.bincount(word, np.where(kept, expected, 0.0), len(first)), 1e-12)
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(total[first], 1) / left_expected), 0.0)
    width = np.bincount(word, kept, len(first))
    retained = (width > 0) & (gain > 0.5 * width * np.log(np.maximum(total[first], 2)))
    share = np.where(kept, (count - DISCOUNT) / np.maximum(of, 1), 0.0)
    left = 1 - np.bincount(word, share, len(first))
    return np.repeat(np.where(retained[word], share, 0.0), sizes) + np.repeat(np.where(retained[word], left[word], 1.0), sizes) * p


def _rare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (word, next, row, train, p) in the order of (word, next): what the rare words of each row add.

    A word's rows are held at a time; as it is rare, they are less than LEAST_WORD of the tokens.
    """
    schema = pa.schema([("row", pa.int64()), ("rare_known", pa.int64()), ("rare_base", pa.float64()), ("rare_tokens", pa.int64()), ("more", pa.float64())])

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        new = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
        words = rows.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        follow, row, train, p = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
        starts = new(words)
        first, pair = np.flatnonzero(starts), np.flatnonzero(starts | new(follow))
        sums = np.add.reduceat(train.astype(np.int64), first)
        total = np.repeat(sums, np.diff([*first, len(p)]))
        more = np.log10(_refined(total, first, pair, train, p)) - np.log10(p)
        keys, at = np.unique(row, return_inverse=True)
        add = lambda x: np.bincount(at, x, len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(add(total > 0).astype(np.int64)), pa.array(add(np.log10(total + 1.0))), pa.array(add(np.ones(len(p))).astype(np.int64)), pa.array(add(more))], schema=schema)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < HELD:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words = whole.column(0)
        last = words[len(words) - 1].as_py()
        end = _first_of(words, last)
        if end:
            yield out(whole.slice(0, end))
        held = [whole.slice(end)]
        size = held[0].num_rows if end else 0  # a word of more than HELD rows waits for as many more
    if held:
        yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _first_of(words: pa.Array, word: str) -> int:
    """Where the run of a word at the end of sorted words begins."""
    low, high = 0, len(words)
    while low < high:
        mid = (low + high) // 2
        if words[mid].as_py() == word:
            high = mid
        else:
            low = mid + 1
    return low


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    words = cut(rows.where("NOT held_out").select("text").mapInArrow(_word_rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(facts.n), int(facts.v)
    often = max(2, math.ceil(n * LEAST_WORD))
    top = words.where((F.col("n") >= often) & (F.col("word") != "")).orderBy(F.desc("n"), "word").toPandas()
    ends = (words.where("word = ''").first() or (None, 0))[1]
    counts = np.concatenate([[0, ends, 0], top.n.to_numpy(np.int64)]).astype(np.int64)
    rare_n, rare_v = n - int(counts.sum()), v - len(top) - (ends > 0)
    root = (counts / (n + 2.0)).astype(float)
    root[RARE] = (rare_n + 1) / (n + 2.0)
    root[END] = (ends + 1) / (n + 2.0)

    rows = rows.withColumn("row", F.monotonically_increasing_id())
    symbols = cut(rows.select("row", "doc_id", "held_out", "text").mapInArrow(_symbol_rows(top.word.tolist()), "row long, doc_id long, held_out boolean, ids array<int>, rare array<string>"), "symbols")
    tree = grow(symbols.where("NOT held_out").select("ids"), root, n, depth)
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, tree double, rare array<string>, next array<int>, p array<double>"
    main = cut(symbols.mapInArrow(_score_rows(tree, counts), kinds), "scored")

    rare = main.select("row", (~F.col("held_out")).alias("train"), F.explode(F.arrays_zip("rare", "next", "p")).alias("x")).select(F.col("x.rare").alias("word"), F.col("x.next").alias("next"), F.col("row").alias("of"), "train", F.col("x.p").alias("p"))
    dealt = rare.repartition("word").sortWithinPartitions("word", "next")
    sums = dealt.mapInArrow(_rare_rows, "of long, rare_known long, rare_base double, rare_tokens long, more double")
    of_row = sums.groupBy("of").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]])
    out = main.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "tree").join(of_row, F.col("row") == F.col("of"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    base = F.col("base") + zero("rare_base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    full = F.col("tree") + zero("more") + zero("rare_base") - zero("rare_tokens") * F.log10(F.lit(float(rare_n + rare_v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))
