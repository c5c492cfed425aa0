"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get words by the highest quotients ``target / (2 k + 1)``, the unit being one token, so that a source of any size comes
within a word or so of its target; the words of a source go in the same way to its shards, seeded groups of its documents.  A
shard is cut into blocks of equal tokens and takes its quota of them: all as often as it can, and a seeded choice once more, the
last block of which is taken only as far as the quota goes.  A document may lie in several blocks: it is taken word by word.

Sources are those that a mix names: MAX_SOURCES at most, or the call fails rather than mix in part.  The number of shards of a
source is bounded by MAX_SHARDS, so that what one task holds to apportion them is bounded too; documents stay on executors.

Defined results: a null text has size 0; a null source is a source of its own and comes last; documents of size 0 are taken 0
times; rows that repeat are mixed one by one, and since the order within a shard ends with a hash of the row, reruns take the
same words; equal quotients go to the first source or shard; a very long text lies in many blocks and may be taken in part; a
table of any size, of one word too, is mixed; an empty table gives an empty result; other columns are ignored or carried, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import cut, fresh, identified, identity, without_repeats

BLOCK = 256
SHARD_DOCS = 4096
MAX_SHARDS = 1 << 16
#: No document is taken more often than this.
MOST = 2
#: A prime above any number of blocks of a shard.
STEP = 2147483647
MAX_SOURCES = 1_000_000
_WORD = r"[^\x20\x09-\x0D]+"


def apportion(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """Seats by the highest quotients ``vote / (2 k + 1)``, none above its cap; of equal quotients the first vote wins.

    The seats whose quotients lie above a level are counted at once, the level is found by bisection, and the ties that
    remain at it are dealt in order.
    """
    v = np.asarray(votes, dtype=np.float64)
    most = np.full(len(v), seats, dtype=np.int64) if caps is None else np.asarray(caps, dtype=np.int64)
    most = np.where(v > 0, most, 0)
    seats = min(int(seats), int(most.sum()))
    if seats <= 0:
        return np.zeros(len(v), dtype=np.int64)
    above = lambda t: np.minimum(np.floor((v / t + 1) / 2), most).astype(np.int64)
    low, high = v[v > 0].min() / (4.0 * seats + 4), v.max() * 2
    while above(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (mid, high) if above(mid).sum() >= seats else (low, mid)
    out = above(high)
    left = seats - int(out.sum())
    while left > 0:
        quotient = np.where(out < most, v / (2 * out + 1), -1.0)
        chosen = np.argsort(-quotient, kind="stable")[:left]
        chosen = chosen[quotient[chosen] >= quotient[chosen[0]] * (1 - 1e-12)]
        out[chosen] += 1
        left -= len(chosen)
    return out


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Shares of the total by weight; none above ``most`` times its size, the excess goes to the others by weight."""
    caps, total = [most * s for s in sizes], share * sum(sizes)
    full: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in free)
        level = (total - sum(caps[i] for i in full)) / Fraction(weight) if weight else Fraction(0)
        more = [i for i in free if caps[i] < weights[i] * level]
        if not more:
            return [Fraction(caps[i]) if i in full else weights[i] * level for i in range(len(sizes))]
        full.update(more)


def _quota_rows(quotas: dict[int, int], most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        tokens = rows["tokens"].to_numpy()
        rows["quota"] = apportion(tokens, quotas[int(rows["at"].iloc[0])], most * tokens)
        return rows[["at", "shard", "tokens", "quota"]]

    return run


def _extra(at: Column, block: int) -> Column:
    """How many words of a shard's block the seeded choice takes beyond the whole passes.

    ``turn`` seeds an order that visits each block once (a prime step is coprime to any smaller number of blocks).  The words
    before a block in that order are whole blocks but for the shard's last, which may be shorter.
    """
    n = F.greatest(F.ceil(F.col("tokens") / block), F.lit(1))
    place = lambda b: F.pmod(b * F.lit(STEP) + F.col("turn"), n)
    short = n * block - F.col("tokens")
    before = place(at) * block - F.when(place(n - 1) < place(at), short).otherwise(0)
    wanted = F.col("quota") % F.greatest("tokens", F.lit(1))
    return F.greatest(wanted - before, F.lit(0))


def _plan(rows: DataFrame, weights: Sequence[int], share: Fraction, seed: int, block: int) -> DataFrame:
    """``rows`` (ia, ib, doc_id, source, size, draw) with source_size, target, taken, passes and parts.

    A document's ``parts`` are, for each of its blocks, the words of it there and how many of these go in once more; ``passes``
    is how often all of it is taken.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix has {MAX_SOURCES} sources at most")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.size for r in found], [weights[i % len(weights)] for i in range(len(found))], share, MOST)
    quotas = apportion([float(g) for g in goal], round(sum(goal)), [MOST * r.size for r in found])
    shards = [min(MAX_SHARDS, -(-r.docs // SHARD_DOCS)) for r in found]
    facts = rows.sparkSession.createDataFrame([(r.source, i, shards[i], r.size, float(goal[i])) for i, r in enumerate(found)], "name string, at int, shards int, source_size long, target double")
    facts = F.broadcast(facts) if len(found) <= 10_000 else facts
    placed = rows.join(facts, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards")).cast("int"))
    order = Window.partitionBy("at", "shard").orderBy("draw", "doc_id", "ia", "ib").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    tokens = placed.groupBy("at", "shard").agg(F.sum("size").alias("tokens"))
    own = {i: int(q) for i, q in enumerate(quotas)}
    plan = tokens.groupBy("at").applyInPandas(_quota_rows(own, MOST), "at int, shard int, tokens long, quota long")
    out = placed.join(plan, ["at", "shard"]).withColumn("turn", F.abs(F.xxhash64(F.lit(seed), "at", "shard") % F.lit(1 << 30)))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)

    def part(b: Column) -> Column:
        begin = F.greatest(F.col("start"), b * block)
        words = F.least(F.col("start") + F.col("size"), (b + 1) * block) - begin
        return F.struct(words.alias("words"), F.greatest(F.lit(0), F.least(words, _extra(b, block) - (begin - b * block))).alias("more"))

    none = F.array().cast("array<struct<words:bigint,more:bigint>>")
    out = out.withColumn("passes", F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).withColumn("parts", F.when(F.col("size") > 0, F.transform(F.sequence(first, last), part)).otherwise(none))
    more = F.aggregate("parts", F.lit(0).cast("long"), lambda total, x: total + x["more"])
    return out.withColumn("taken", F.col("passes") * F.col("size") + more)


def _sizes(docs: DataFrame, seed: int) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    draw, (a, b) = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")), identity(docs)
    return cut(docs.select(a.alias("ia"), b.alias("ib"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), draw.alias("draw")), "sizes")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and taken."""
    return _plan(_sizes(docs, seed), weights, share, seed, block).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass over a document, with the words that the pass takes.

    A pass that takes all words keeps the text as it is; ``n_chars``, where there is one, is counted again.
    """
    columns, kinds = docs.columns, dict(docs.dtypes)
    sizes = _sizes(docs, seed)
    plan = cut(_plan(sizes, weights, share, seed, block).where("taken > 0").select("ia", "ib", "passes", "parts"), "mix")
    docs, _ = without_repeats(docs, sizes)  # each of several equal rows has its own part of the plan, and takes its text from one
    docs, (a, b) = identified(docs)
    own = {c: fresh(docs, c) for c in ("of_a", "of_b", "whole", "parts", "again")}
    plan = plan.select(F.col("ia").alias(own["of_a"]), F.col("ib").alias(own["of_b"]), F.col("passes").alias(own["whole"]), F.col("parts").alias(own["parts"]))
    rows = docs.join(plan.hint("shuffle_hash"), (F.col(a) == F.col(own["of_a"])) & (F.col(b) == F.col(own["of_b"])))
    parts = F.col(own["parts"])
    some, all_ = F.exists(parts, lambda x: x["more"] > 0), F.forall(parts, lambda x: x["more"] == x["words"])
    turns = F.transform(F.sequence(F.lit(1).cast("long"), F.col(own["whole"]) + F.when(some, 1).otherwise(0)), lambda t: (t > F.col(own["whole"])) & ~all_)
    rows = rows.withColumn(own["again"], F.explode(turns))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(_WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    head = F.element_at(parts, 1)["words"]  # the words before the second block, then blocks are whole
    at = lambda i: F.when(i < head, 1).otherwise(F.floor((i - head) / block) + 2).cast("int")
    inside = lambda i: F.when(i < head, i).otherwise((i - head) % block)
    part = F.array_join(F.filter(words, lambda w, i: inside(i) < F.element_at(parts, at(i))["more"]), "")
    out = rows.withColumn("text", F.when(F.col(own["again"]), part).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(own["again"]), F.length("text").cast(kinds["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in columns])
