"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is the big-endian integer of its bytes modulo three primes, that is a polynomial in 256.  Such hashes
compose: ``H(ab) = H(a) * 256^|b| + H(b)``, so the chunks of a document can be hashed anywhere and in any order, and the
pairs ``(hash, 256^length)`` are a monoid that Spark folds.  Texts of at most ``huge_bytes`` are hashed where they are read;
the chunks of longer ones are dealt to all tasks.  Equal fingerprints are only a conjecture: each member of a group is then
compared with the row that stays, chunk by chunk, and whatever differs is grouped again by the text itself.

Defined results: null texts count as empty; a null doc_id sorts last, after all numbers; of rows of equal texts exactly one
stays, also if they repeat a doc_id or have none; very long texts are hashed and compared in chunks; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import SPACES, chosen_rows, cut, identity, looked_up, whole_texts, without_repeats

#: Below 2^31, so that a product of two residues fits a signed 64-bit integer in the JVM.
PRIMES = (2147483629, 2147483587, 2147483563)
CHUNK = 1 << 16
HUGE = 8 << 20
#: Bytes of a text that one comparison holds.
COMPARED = 1 << 20
#: Members of a group that share one copy of the chunks that stay.
GROUP_PART = 256

_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUNS = re.compile(rb"  +")


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    text = text.translate(_TO_SPACE)
    return _RUNS.sub(b" ", text) if b"  " in text else text


def normalised(text: Column) -> Column:
    """The same as a column expression, as bytes."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), "UTF-8")


def combine(left: tuple[int, int], right: tuple[int, int], prime: int) -> tuple[int, int]:
    """The pair ``(hash, 256^length)`` of two neighbouring stretches taken together."""
    return (left[0] * right[1] + right[0]) % prime, left[1] * right[1] % prime


def fingerprint(text: bytes, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """One pair ``(hash, 256^length)`` for each prime, folded over chunks."""
    out = [(0, 1 % p) for p in primes]
    for at in range(0, len(text), chunk):
        part = text[at : at + chunk]
        value, size = int.from_bytes(part, "big"), len(part)
        out = [combine(have, (value % p, pow(256, size, p)), p) for have, p in zip(out, primes, strict=True)]
    return out


def _print_rows(primes: tuple[int, ...]):
    schema = pa.schema([("ia", pa.int64()), ("ib", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("print", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, prints = [], [], []
            for raw in whole_texts(batch):
                text = normalise(raw)
                sizes.append(len(text))
                digests.append(hashlib.sha256(text).hexdigest())
                prints.append([h for h, _ in fingerprint(text, primes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(prints, pa.list_(pa.int64()))], schema=schema)

    return run


def _chunk_rows(primes: tuple[int, ...]):
    schema = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("pairs", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[list(x) for x in fingerprint(part, primes)] for part in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pairs, schema.field(2).type)], schema=schema)

    return run


def _chunks(text: Column, size: int) -> Column:
    """The bytes of a column as an array of chunks, one at least."""
    last = F.greatest(F.floor((F.octet_length(text) - 1) / F.lit(size)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _folded(pairs: Column, prime: int, k: int) -> Column:
    """The hash of a document from its chunks' pairs in order, in the JVM."""
    p = F.lit(prime).cast("long")
    start = F.lit(0).cast("long")
    return F.aggregate(pairs, start, lambda have, x: (have * x["pairs"][k][1] + x["pairs"][k][0]) % p)


def fingerprints(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge_bytes: int = HUGE) -> DataFrame:
    """ia, ib, doc_id, raw, n_bytes, text_sha256 and print (one residue for each prime) of every row.

    ia and ib are the row's identity; ``raw`` is a hash of the text as it is, which with the doc_id finds the text again.
    """
    text, (a, b) = F.col("text").cast("string"), identity(docs)
    rows = docs.select(a.alias("ia"), b.alias("ib"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    small = rows.where(size <= huge_bytes).mapInArrow(_print_rows(primes), "ia long, ib long, doc_id long, raw long, n_bytes long, text_sha256 string, print array<long>")
    large = rows.where(size > huge_bytes).select("ia", "ib", "doc_id", "raw", normalised(F.col("text")).alias("bytes"))
    large = large.withColumn("text_sha256", F.sha2("bytes", 256)).withColumn("key", F.xxhash64("doc_id", "text_sha256"))
    parts = large.select("key", F.posexplode(_chunks(F.col("bytes"), CHUNK * 16)).alias("at", "part")).repartition("key", "at")
    hashed = parts.mapInArrow(_chunk_rows(primes), "key long, at int, pairs array<array<long>>").dropDuplicates(["key", "at"])
    whole = hashed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "pairs"))).alias("c"))
    whole = whole.select("key", F.array(*[_folded(F.col("c"), p, k) for k, p in enumerate(primes)]).alias("print"))
    facts = large.select("ia", "ib", "key", "doc_id", "raw", F.octet_length("bytes").cast("long").alias("n_bytes"), "text_sha256")
    return small.unionByName(facts.join(whole, "key").select(*small.columns))


def _numbered(docs: DataFrame, primes: tuple[int, ...], huge_bytes: int) -> DataFrame:
    return cut(fingerprints(docs, primes, huge_bytes).withColumn("row", F.monotonically_increasing_id()), "prints")


def exact_dedup(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge_bytes: int = HUGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    found = _grouped(docs, _numbered(docs, primes, huge_bytes))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_bytes")


def _grouped(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows of ``prints`` with keep_row, keep_id and group_size."""
    prints = prints.withColumn("key", F.xxhash64("n_bytes", "print"))
    same = ["key", "n_bytes", "print"]
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")
    groups = cut(prints.groupBy(*same).agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "groups")
    table = groups.select(*[F.col(c).alias(f"g_{c}") for c in same], "first", "group_size")
    joined = looked_up(prints, table, [(c, f"g_{c}") for c in same], "group_size", groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0])
    members = cut(joined.select("ia", "ib", "doc_id", "row", "raw", "n_bytes", "text_sha256", "print", F.col("first.row").alias("keep_row"), F.col("first.doc_id").alias("keep_id"), "group_size"), "members")
    wrong = cut(_differing(docs, members.where("group_size > 1")), "differing")
    if not wrong.isEmpty():
        members = _regrouped(docs, members, wrong)
    return members


#: What tells a text of ``docs`` from others when its bytes are fetched.
_SAME = ("doc_id", "raw", "text_sha256")


def _with_text(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with their normalised bytes.  Each text moves once; the hash tables hold the small side."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("raw"))
    found = texts.join(members.hint("shuffle_hash"), same).withColumn("bytes", normalised(F.col("text")))
    return found.where(F.sha2("bytes", 256) == F.col("text_sha256")).drop("d", "h", "text")


def _differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of groups whose text is not that of the row that stays, found chunk by chunk.

    The chunks that stay are given once to every GROUP_PART members, so that a group of any size is spread over tasks.
    """
    once = members.groupBy(*_SAME, "keep_row", "group_size").agg(F.min("row").alias("row"))
    texts = _with_text(docs, once)
    salts = F.ceil(F.col("group_size") / F.lit(GROUP_PART)).cast("int")
    chunks = texts.select(*_SAME, "row", "keep_row", salts.alias("salts"), F.posexplode(_chunks(F.col("bytes"), COMPARED)).alias("at", "part"))
    kept = chunks.where("row = keep_row").select(F.col("keep_row").alias("k"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), F.col("at").alias("a"), F.col("part").alias("kept_part")).dropDuplicates(["k", "s", "a"])
    rest = chunks.where("row != keep_row").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    both = rest.join(kept, (F.col("keep_row") == F.col("k")) & (F.col("salt") == F.col("s")) & (F.col("at") == F.col("a")), "left")
    return both.where(~F.col("part").eqNullSafe(F.col("kept_part"))).select(*[F.col(c).alias(f"w_{c}") for c in _SAME], F.col("keep_row").alias("w_row")).distinct()


def _regrouped(docs: DataFrame, members: DataFrame, wrong: DataFrame) -> DataFrame:
    """After a collision of fingerprints: the rows that differ are grouped by the whole text."""
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in _SAME]
    odd = _with_text(docs, members.join(wrong, [*same, F.col("keep_row") == F.col("w_row")], "left_semi")).dropDuplicates(["row"])
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")
    first = odd.groupBy("bytes").agg(F.min(order).alias("first"))
    again = cut(odd.join(first, "bytes").select("row", F.col("first.row").alias("new_row"), F.col("first.doc_id").alias("new_id")), "regrouped")
    out = members.drop("group_size").join(again, "row", "left")
    out = out.withColumn("keep_id", F.when(F.col("new_row").isNull(), F.col("keep_id")).otherwise(F.col("new_id"))).withColumn("keep_row", F.coalesce("new_row", "keep_row")).drop("new_row", "new_id")
    return out.join(out.groupBy("keep_row").agg(F.count("*").alias("group_size")), "keep_row")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one for each text, joined by the rows' identity."""
    docs, prints = without_repeats(docs, _numbered(docs, PRIMES, HUGE))
    lost = _grouped(docs, prints).where("row != keep_row").select("ia", "ib")
    return chosen_rows(docs, lost, "left_anti")
