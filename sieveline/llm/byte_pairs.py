"""Byte-level byte-pair encoding of whole texts, and decoding.

A text is split by a pattern; each word's bytes are folded by ranked merges: of all adjacent pieces the leftmost pair whose bytes
have the lowest rank is joined, until no pair has a rank.  A word that is a piece itself is that piece.

Words are folded by Spark's higher-order functions and by nothing else: ranks of pairs of ids are literal arrays, a perfect hash, and
a piece is a number that holds the rank of the pair of it and the next, its place and its id.  The MOST_WORDS most frequent words of
SAMPLED random documents are folded once and go to the tasks, which split the texts and look words up.  That table saves work and
decides nothing: a word that it lacks comes back beside the ids of what it has, and is folded there, once for a document.  Long
words lie in blocks, so that a merge looks at about the square root of their pieces.  Decoding is one array_join of the ids' pieces,
and back to bytes.  ``merged`` is the same in plain Python, for tests; no query calls it.

Defined results: null and empty texts have no ids; texts that repeat get the same; very long texts, also of one word, take time
in proportion to their length, a long word by the power 1.5; all columns are carried, and a column named like the new one is replaced, as
``withColumn`` does; an empty table stays empty; ids that no piece has decode to nothing.
"""

from __future__ import annotations

import base64
import heapq
import json
import random
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the cache, and documents of the random sample whose words are counted for it: a bound on its size and on its cost.
MOST_WORDS, SAMPLED = 700_000, 20_000
#: Parts of a literal table; a key is looked for in the part that its hash names.
PARTS = 32_768
#: White space as the public libraries' patterns have it; Java's \s has the ASCII characters only.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Ids are below NONE, which as a rank says that a pair is in no piece.  A piece has its rank from bit RANK on, and from NO_PAIR on none.
BITS = 18
NONE, RANK = 2**BITS, 62 - BITS
NO_PAIR = NONE << RANK
#: Pieces of a word, with both its ends, up to which all are looked through for every merge.
LONGEST_PLAIN = 200


def java_pattern(pattern: str) -> str:
    """A pattern of the public libraries for Java: white space is that of Unicode, inside classes and outside."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE}]")
        elif two.startswith("\\"):
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _literal(table: dict[str, object], kind: str) -> Column:
    """A small table as a literal: an array of maps from key to value, by the key's hash."""
    parts: list[dict] = [{} for _ in range(PARTS)]
    for key, value in table.items():
        parts[zlib.crc32(key.encode()) % PARTS][key] = value
    return F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _found(table: Column, key: Column) -> Column:
    """The value of a key in such a literal, or null."""
    return F.try_element_at(F.get(table, (F.crc32(key) % PARTS).cast("int")), key)


def _letting(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, and written once in the plan."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, of)  # a get of a transform finds out its type anew for each row


def _pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int], int]:
    """Which pairs of pieces have a rank, as two arrays and ``size``: a perfect hash.

    A pair's key is its left id times NONE, plus its right id.  Its entry lies at the key modulo ``size``, plus the shift at the key
    modulo the number of shifts, and is the key times NONE, plus the rank.  All that share a shift are moved to free places by it.
    """
    keys = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                keys[left * NONE + right] = rank
    n_shifts, size = len(keys) // 2 + 1, 2 * len(keys) + 1
    while len({(key % n_shifts, key % size) for key in keys}) < len(keys):
        size += 1
    sharing: dict[int, list[int]] = {}
    for key in keys:
        sharing.setdefault(key % n_shifts, []).append(key)
    shifts, entries, rng = [0] * n_shifts, [2**62] * (size + size // 4 + 1), random.Random(0)
    for at, group in sorted(sharing.items(), key=lambda x: -len(x[1])):
        while any(entries[key % size + shifts[at]] != 2**62 for key in group):
            shifts[at] = rng.randrange(size // 4 + 1)
        for key in group:
            entries[key % size + shifts[at]] = key * NONE + keys[key]
    return shifts, entries, size


def _numbers(values: list[int], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


def _at(xs: Column, i: Column) -> Column:
    """The element at place ``i``, from 1, or null."""
    return F.get(xs, i - 1)


def _from(xs: Column, i: Column) -> Column:
    """The elements from place ``i`` on."""
    return F.slice(xs, i, F.lit(2**30))


def _id(piece: Column) -> Column:
    return piece.bitwiseAND(F.lit(NONE - 1).cast("long"))


def _own(piece: Column) -> Column:
    """Place and id of a piece."""
    return piece.bitwiseAND(F.lit(2**RANK - 1))


class _Fold:
    """The ids of a word by ranked merges, in higher-order functions over the literals of a vocabulary.

    A piece is one number: the rank of the pair of it and the next piece (NONE without), its place, and its id.  So the least number
    is the leftmost pair of the lowest rank, and the rank is the id of what the pair makes.
    """

    def __init__(self, tables: Column, end: int, sizes: tuple[int, int]) -> None:
        self.tables, self.end, self.sizes = tables, F.lit(end).cast("long"), sizes

    def piece(self, own: Column, following: Column) -> Column:
        """The piece of a place and id, before a following id."""
        n_shifts, size = self.sizes

        def with_rank(key: Column) -> Column:
            entry = F.get(self.tables["entries"], (key % size).cast("int") + F.get(self.tables["shifts"], (key % n_shifts).cast("int")))
            return F.shiftleft(F.least(entry.bitwiseXOR(F.shiftleft(key, BITS)), F.lit(NONE).cast("long")), RANK) + own

        return _letting(F.shiftleft(_id(own), BITS) + following, with_rank)

    def joined(self, least: Column, before: Column, after: Column) -> Column:
        """The piece before a pair, and what the pair makes, before the id of the piece after it."""
        rank = F.shiftright(least, RANK)
        return F.array(self.piece(_own(before), rank), self.piece(_own(least) - _id(least) + rank, after))

    def plain(self, pieces: Column) -> Column:
        """Pieces between two ends, folded: all are looked through for every merge."""

        def step(xs: Column, _: Column) -> Column:
            def merge(i: Column, least: Column) -> Column:
                return F.flatten(F.array(F.slice(xs, 1, i - 2), self.joined(least, _at(xs, i - 1), _id(_at(xs, i + 2))), _from(xs, i + 2)))

            def with_least(least: Column) -> Column:
                until = _letting(_own(least), lambda own: F.size(F.filter(xs, lambda x: _own(x) <= own)))  # array_position leaves its loop by an exception
                return F.when(least < NO_PAIR, _letting(until, lambda i: merge(i, least))).otherwise(xs)

            return _letting(F.array_min(xs), with_least)

        return F.aggregate(_from(pieces, F.lit(4)), pieces, step)

    def in_blocks(self, pieces: Column) -> Column:
        """The same for long words: pieces lie in blocks, about as many as a block has pieces, beside the least of each block.

        A pair whose second piece is the first of the next block is brought into one block before it is joined.
        """

        def put(xs: Column, k: Column, two: Column) -> Column:
            """``xs`` with other elements for the two from place k on."""
            return F.concat(F.slice(xs, 1, k - 1), two, _from(xs, k + 2))

        def put_blocks(s: Column, k: Column, two: Column) -> Column:
            new = lambda two: F.struct(put(s["blocks"], k, two).alias("blocks"), put(s["least"], k, F.transform(two, F.array_min)).alias("least"))
            return _letting(two, new)

        def bring(s: Column, k: Column) -> Column:
            """The first piece of the block after ``k`` goes to block ``k``; an empty block goes."""
            rest = _at(s["blocks"], k + 1)
            both = F.array(F.concat(_at(s["blocks"], k), F.slice(rest, 1, 1)), _from(rest, F.lit(2)))
            return put_blocks(s, k, F.filter(both, lambda xs: F.size(xs) > 0))

        def merge(s: Column, k: Column, i: Column, least: Column) -> Column:
            own, older = _at(s["blocks"], k), _at(s["blocks"], k - 1)
            before = F.when(i > 1, _at(own, i - 1)).otherwise(F.element_at(older, -1))
            after = F.coalesce(_at(own, i + 2), F.get(_at(s["blocks"], k + 1), F.lit(0)))

            def both(new: Column) -> Column:
                inner = F.array(older, F.concat(F.slice(own, 1, F.greatest(i - 2, F.lit(0))), new, _from(own, i + 2)))
                over = F.array(F.concat(F.slice(older, 1, F.size(older) - 1), F.slice(new, 1, 1)), F.concat(F.slice(new, 2, 1), _from(own, F.lit(3))))
                return F.when(i > 1, inner).otherwise(over)

            return put_blocks(s, k - 1, _letting(self.joined(least, before, _id(after)), both))

        def step(s: Column, _: Column) -> Column:
            def in_block(k: Column, least: Column) -> Column:
                place = F.array_position(_at(s["blocks"], k), least).cast("int")
                return _letting(place, lambda i: F.when(i < F.size(_at(s["blocks"], k)), merge(s, k, i, least)).otherwise(bring(s, k)))

            def with_least(least: Column) -> Column:
                return F.when(least < NO_PAIR, _letting(F.array_position(s["least"], least).cast("int"), lambda k: in_block(k, least))).otherwise(s)

            return _letting(F.array_min(s["least"]), with_least)

        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        rest = F.transform(F.sequence(F.lit(2), F.size(pieces), width), lambda i: F.slice(pieces, i, width))
        blocks = F.concat(F.array(F.slice(pieces, 1, 1)), rest)  # the first alone, so that every pair has a block before it
        start = _letting(blocks, lambda xs: F.struct(xs.alias("blocks"), F.transform(xs, F.array_min).alias("least")))
        return F.aggregate(F.concat(pieces, pieces), start, step, lambda s: F.flatten(s["blocks"]))

    def ids(self, word: Column) -> Column:
        """The ids of a word, a string with a character for each of its bytes."""

        def pieces(owns: Column) -> Column:
            return F.transform(owns, lambda own, i: self.piece(own, F.coalesce(_id(F.get(owns, i + 1)), self.end)))

        def folded(xs: Column) -> Column:
            done = F.when(F.size(xs) > LONGEST_PLAIN, self.in_blocks(xs)).otherwise(self.plain(xs))
            return _letting(done, lambda xs: F.transform(F.slice(xs, 2, F.size(xs) - 2), lambda x: _id(x).cast("int")))

        own = lambda byte, i: F.shiftleft(i.cast("long") + 1, BITS) + F.get(self.tables["bytes"], F.ascii(byte))
        owns = F.concat(F.array(self.end), F.transform(F.split(word, ""), own), F.array(F.lit(2**RANK - NONE) + self.end))
        known = _found(self.tables["named"], word)
        return F.when(known.isNotNull(), F.array(known)).otherwise(_letting(_letting(owns, pieces), folded))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, by the same merges: a heap of pairs over a linked list, for words of any length."""
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, len(word) + 1))  # where the piece that begins at a place ends
    start = list(range(-1, len(word)))  # where the piece that ends at a place (less one) begins
    pairs: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        middle = end[a]
        if middle < len(word) and (rank := ranks.get(word[a : end[middle]])) is not None:
            heapq.heappush(pairs, (rank, a, end[middle]))

    for a in range(len(word)):
        start[a + 1] = a
        offer(a)
    while pairs:
        _, a, b = heapq.heappop(pairs)
        middle = end[a] if a >= 0 else -1
        if middle < 0 or middle >= b or end[middle] != b:  # one of the two has been joined with another
            continue
        end[a], end[middle], start[b] = b, -1, a
        offer(a)
        if a:
            offer(start[a])
    out, a = [], 0
    while a < len(word):
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def _as_bytes(word: Column) -> Column:
    """A string with a character for each byte."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


class Frequent:
    """A table of folded words, sent as Arrow; a process makes its look-up table once."""

    def __init__(self, folded: pa.Table) -> None:
        self.folded, self.made = folded, None

    def table(self) -> dict[str, bytes]:
        """From words to their ids, as the bytes of 32-bit numbers."""
        if self.made is None:
            words, ids = (column.combine_chunks() for column in self.folded.columns)
            ends, values = (4 * ids.offsets.to_numpy()).tolist(), ids.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            self.made = {word: values[a:b] for word, a, b in zip(words.to_pylist(), ends[:-1], ends[1:], strict=True)}
        return self.made


class BytePairs:
    """The vocabulary of a rank file and its pattern, and what Spark makes of them."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.pattern = read_ranks(path), pattern
        self.named = {piece.decode("latin-1"): rank for piece, rank in self.ranks.items()}
        self.end = max(self.ranks.values(), default=-1) + 1
        if self.end >= NONE:
            raise ValueError(f"ids from {NONE - 1} on are not supported")
        self.pairs: tuple[list[int], list[int], int] | None = None

    def folding(self, of) -> Column:
        """``of`` a fold with the literals of this vocabulary: ids of bytes and of whole pieces, and the pairs that have a rank."""
        if self.pairs is None:
            self.pairs = _pair_table(self.ranks)
        shifts, entries, size = self.pairs
        tables = {
            "bytes": _numbers([self.ranks.get(bytes([b])) for b in range(256)], "long"),
            "named": _literal(self.named, "int"),
            "shifts": _numbers(shifts, "int"),
            "entries": _numbers(entries, "long"),
        }
        return _letting(F.struct(*(t.alias(name) for name, t in tables.items())), lambda t: of(_Fold(t, self.end, (len(shifts), size))))

    def words(self, text: Column) -> Column:
        """The matches of the pattern, one after another."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(self.pattern)), F.lit(0))

    def folded(self, words: DataFrame, word: str = "word", ids: str = "ids") -> DataFrame:
        """A table of words with their ids."""
        return words.withColumn(ids, self.folding(lambda fold: fold.ids(_as_bytes(F.col(word)))))

    def most_frequent(self, docs: DataFrame, text: str = "text") -> pa.Table:
        """The most frequent words of SAMPLED random documents, folded."""
        some = docs.sample(min(1.0, SAMPLED / max(docs.count(), 1)), seed=0)
        counts = some.select(F.explode(self.words(F.col(text))).alias("word")).groupBy("word").count()
        most = counts.orderBy(F.desc("count"), "word").limit(MOST_WORDS)
        parts = 4 * docs.sparkSession.sparkContext.defaultParallelism
        return self.folded(most.repartition(parts, "word").select("word")).toArrow().combine_chunks()

    def frequent(self, docs: DataFrame, text: str = "text") -> dict[str, list[int]]:
        """The same as a table in Python."""
        return dict(zip(*(column.to_pylist() for column in self.most_frequent(docs, text).columns), strict=True))

    def looked_up(self, frequent):
        """A function from a column of texts to what a table of folded words has of them.

        ``ids`` has the stretches of known ids before, between and after the words that the table lacks; ``words`` has each of these
        once, and ``at`` which one stands at each gap.  ``frequent`` is a broadcast Frequent.
        """
        pattern = self.pattern

        @F.arrow_udf("struct<ids:array<array<int>>,at:array<int>,words:array<string>>")
        def look_up(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import regex

            split, known = regex.compile(pattern).findall, frequent.value.table().get
            for batch in texts:
                stretches, gaps, words, ends = [], [], [], [(0, 0, 0)]
                for text in batch:
                    met = split(text.as_py() or "")
                    found, new, start = list(map(known, met)), {}, 0
                    if None in found:
                        for i, ids in enumerate(found):
                            if ids is None:
                                stretches.append(b"".join(found[start:i]))
                                gaps.append(new.setdefault(met[i], len(new)))
                                start = i + 1
                    stretches.append(b"".join(found[start:]))
                    words.extend(new)
                    ends.append((len(stretches), len(gaps), len(words)))
                of_docs = [pa.array(x, pa.int32()) for x in zip(*ends, strict=True)]
                sizes = np.cumsum([0, *map(len, stretches)], dtype=np.int64) // 4
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(stretches), np.int32)))
                columns = zip(of_docs, (ids, pa.array(gaps, pa.int32()), pa.array(words, pa.string())), strict=True)
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(*x) for x in columns], ["ids", "at", "words"])

        return look_up

    def ids_of(self, found: Column) -> Column:
        """The ids of a text, of what a table has of it and of its other words, each folded once."""
        folded = self.folding(lambda fold: F.transform(found["words"], lambda word: fold.ids(_as_bytes(word))))
        with_gap = lambda all_ids: F.zip_with(found["ids"], found["at"], lambda ids, k: F.coalesce(F.concat(ids, F.get(all_ids, k)), ids))
        return F.when(F.size(found["words"]) == 0, found["ids"][0]).otherwise(F.flatten(_letting(folded, with_gap)))

    def bytes_of(self, ids: Column) -> Column:
        """The bytes that ids stand for: their pieces, one after another."""
        names = {rank: name for name, rank in self.named.items()}
        table = F.from_json(F.lit(json.dumps([names.get(i, "") for i in range(max(names, default=-1) + 1)])), "array<string>")
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids``."""
    made, found = BytePairs(path, pattern), next(name for i in count() if (name := f"found_{i}") not in docs.columns)
    looked_up = made.looked_up(docs.sparkSession.sparkContext.broadcast(Frequent(made.most_frequent(docs, text))))
    return docs.withColumn(found, looked_up(F.col(text))).withColumn(ids, made.ids_of(F.col(found))).drop(found)


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids, as binary."""
    return encoded.withColumn(to, BytePairs(path, "").bytes_of(F.col(ids)))
