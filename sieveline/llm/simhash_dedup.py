"""Near-duplicates by SimHash and BK-trees.

Fingerprints of 64 bits that differ in at most ``radius`` bits agree in c of radius + c blocks of bits.  So the distinct
fingerprints are sharded by (a choice of c blocks, their value), each shard gets a BK-tree (children keyed by their integer
Hamming distance to the parent), and a query follows only the edges within the radius of its own distance.  c grows with the
number of fingerprints, so that shards stay small.  A tree is at home in the task that holds its shard's queries: sending all
trees to all tasks would broadcast data without a size bound.  A shard links its members by a spanning forest, never by all
pairs.  Shards above TREE keys, as a mass of near copies makes them, are sharded once more by FINEST blocks; what then is still
above is linked without a tree in linear work: keys within two bits share a key within one bit of both, so each key is grouped
under itself and its 64 neighbours (larger radii take as many flips as half the radius).  Nothing is capped.

Defined results: a null or empty text has fingerprint zero and links like any other; a null doc_id never names a component
unless all its ids are null; rows that repeat get the same result; very long texts are hashed slice by slice; an empty table
gives an empty result; other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import chosen_rows, cut, identity, looked_up, whole_texts, without_repeats
from sieveline.llm.components import components

#: Keys that one tree holds.
TREE = 1024
#: Blocks that keys share at the finest.
FINEST = 8
#: Shingles that are in memory at once.
SLICE = 1 << 16


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The majority, bit by bit, of the XXH64 of all shingles of ``width`` words, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = None
    total = max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, SLICE):
        if hashes is None or at:
            part = words[at : at + SLICE + width - 1]
            hashes = [digest(b" ".join(x), seed) for x in zip(*(part[k:] for k in range(width)), strict=False)]
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        hashes = None
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _print_rows(width: int, seed: int):
    schema = pa.schema([("ia", pa.int64()), ("ib", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t, width, seed) for t in whole_texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints, pa.int64())], schema=schema)

    return run


class BKTree:
    """Keys of 64 bits under the Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, key: int) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while key != node[0]:
            d = (key ^ node[0]).bit_count()
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, key: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            other, children = stack.pop()
            d = (key ^ other).bit_count()
            if d <= radius:
                found.append(other)
            for edge in range(d - radius, d + radius + 1):
                if edge in children:
                    stack.append(children[edge])
        return found


def _forest(keys: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that span the components of one shard: each key with the root of each component that it meets."""
    tree, parent, out = BKTree(), {}, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for key in keys:
        parent[key] = key
        for other in tree.within(key, radius):
            a, b = find(key), find(other)
            if a != b:
                parent[a] = b
                out.append((key, other))
        tree.add(key)
    return out


def _shard_rows(radius: int, most: int):
    """Over rows sorted by shard: links (block, u, v); a key of a shard that has no tree comes out with v null."""
    schema = pa.schema([("block", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])
    mask = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, large = None, [], False
        found: list[tuple[int, int, int | None]] = []

        def end() -> None:
            if large:
                found.extend((shard[0], k, None) for k in keys)
            elif len(keys) > 1:
                found.extend((shard[0], signed(a), signed(b)) for a, b in _forest([k & mask for k in keys], radius))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], schema.field(k).type) for k in range(3)], schema=schema)
            found.clear()
            return made

        for batch in batches:
            shards = np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)])
            prints = batch.column(2).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.any(shards[:, 1:] != shards[:, :-1], axis=0)) + 1
            bounds = [0, *new.tolist(), len(prints)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                this = (int(shards[0, a]), int(shards[1, a]))
                if this != shard:
                    end()
                    shard, keys, large = this, [], False
                keys.extend(prints[a:b].tolist())
                if len(keys) > most:
                    large = True
                    end()
                    keys = []
                if len(found) > 50_000:
                    yield out()
        end()
        yield out()

    return run


def _flip_links(keys: DataFrame, radius: int) -> DataFrame:
    """Links of any number of keys: each with the least of those that share a key within half the radius of both."""
    near = keys.select("turn", "u", F.col("u").alias("z"))
    bits = F.sequence(F.lit(0), F.lit(63))
    for _ in range(radius // 2):
        flips = near.select("turn", "u", F.explode(F.concat(F.array("z"), F.transform(bits, lambda b: F.col("z").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))).alias("z"))
        near = flips.distinct()
    meet = near.groupBy("turn", "z").agg(F.min("u").alias("least"))
    return near.join(meet, ["turn", "z"]).where("u != least").select("turn", "u", F.col("least").alias("v")).distinct()


def masks(n: int, radius: int, most: int) -> list[int]:
    """The bits that each sharding of n keys goes by: any two keys within the radius agree in all bits of one of them.

    The 64 bits are cut into radius + c blocks, of which keys within the radius share c; there is a sharding for each choice of
    c blocks.  c is the least for which shards of evenly spread keys hold a quarter of ``most``, so that trees stay small however
    many keys there are.
    """
    c = 1
    while c < FINEST and n / 2 ** (64 * c // (radius + c)) > most / 4:
        c += 1
    edges = [round(64 * k / (radius + c)) for k in range(radius + c + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, c)]


def _sharded(keys: DataFrame, found: list[int], radius: int, most: int) -> DataFrame:
    """Links (turn, u, v) of keys (turn, print) in the shards of each mask; v is null for keys of shards above ``most``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in found]
    shards = F.array(*[F.struct((F.col("turn") * len(found) + k).alias("block"), F.col("print").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)])
    rows = keys.select(F.explode(shards).alias("s"), "print").select("s.block", "s.value", "print")
    dealt = rows.repartition("block", "value").sortWithinPartitions("block", "value", "print")
    made = cut(dealt.mapInArrow(_shard_rows(radius, most), "block int, u long, v long"), "shards")
    return made.select(F.floor(F.col("block") / len(found)).cast("int").alias("turn"), "u", "v")


def links(prints: DataFrame, radius: int = 2, most: int = TREE) -> DataFrame:
    """Links (turn, u, v) that join the same keys as all pairs of distinct ``print`` within the radius.

    Prints of several hash functions, named by a column ``turn``, are linked apart from each other.
    """
    if radius % 2:
        raise ValueError("the radius must be even: a key half-way is what links the largest shards")
    turn = F.col("turn").cast("int") if "turn" in prints.columns else F.lit(0)
    keys = prints.select(turn.alias("turn"), "print")
    made = _sharded(keys, masks(keys.count(), radius, most), radius, most)
    out, large = made.where("v IS NOT NULL"), made.where("v IS NULL").select("turn", F.col("u").alias("print")).distinct()
    if large.isEmpty():
        return out
    # keys of large shards once more, by the finest blocks; the few that still meet in masses are linked by shared neighbours
    made = _sharded(large, masks(1 << 62, radius, most), radius, most)
    return out.unionByName(made.where("v IS NOT NULL")).unionByName(_flip_links(made.where("v IS NULL").select("turn", "u").distinct(), radius))


def _printed(docs: DataFrame, width: int, seed: int) -> DataFrame:
    a, b = identity(docs)
    rows = docs.select(a.alias("ia"), b.alias("ib"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_print_rows(width, seed), "ia long, ib long, doc_id long, print long"), "simhash")


def _classed(prints: DataFrame, radius: int, most: int) -> DataFrame:
    """``prints`` with root, the least print of the component, and component_id."""
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = components(links(distinct.select("print"), radius, most))
    named = cut(distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", "n", F.coalesce("root", "print").alias("root")), "roots")
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    total = named.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_print = looked_up(named, least, [("root", "r")], "prints", total[0]).select(F.col("print").alias("p"), "n", "root", "component_id")
    return looked_up(prints, of_print, [("print", "p")], "n", total[1])


def simhash_dedup(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, most: int = TREE) -> DataFrame:
    """doc_id, print (signed) and component_id, the least doc_id that links reach, of every row."""
    return _classed(_printed(docs, width, seed), radius, most).select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, most: int = TREE) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the least doc_id, of several such rows one.

    Rows are joined by their identity, so null and repeated ids are told apart.
    """
    docs, prints = without_repeats(docs, _printed(docs, width, seed))
    found = _classed(prints, radius, most)
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "ia", "ib")).alias("best"))
    return chosen_rows(docs, best.select("best.ia", "best.ib"), "left_semi")
