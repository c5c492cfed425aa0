"""What the operators share: table access, the cutting of lineage, joins on hot keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.scratch import cut, delete, fresh, new_folder, shared_dir, temporary

__all__ = ["MOST_LARGE", "SPACES", "chosen_rows", "cut", "delete", "drop_cut", "fresh", "identified", "identity", "looked_up", "new_folder", "shared_dir", "table", "temporary", "whole_texts", "without_repeats"]

#: Hot keys that are sent to all tasks, at most.
MOST_LARGE = 50_000
#: The six white-space bytes of the contracts: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be one that only Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and that nothing reads any more."""
    delete(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def looked_up(rows: DataFrame, table: DataFrame, on: list[tuple[str, str]], n: str, total: int, least: int = 1024) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``n`` how many of the ``total`` rows have that key.

    Keys of more than a MOST_LARGE-th of the rows (and of ``least``) are sent to all tasks, so that rows of a hot key stay where
    they are; there are no more than MOST_LARGE of them.  All others are joined as usual.
    """
    bound = max(least, -(-total // MOST_LARGE))
    if total <= bound:  # no key can have more rows than there are
        return rows.join(table, [F.col(a) == F.col(b) for a, b in on])
    names = {c: f"hot_{c}" for c in table.columns}
    hot = F.broadcast(table.where(F.col(n) > bound).withColumnsRenamed(names))
    both = rows.join(hot, [F.col(a) == F.col(names[b]) for a, b in on], "left")
    # rows that have met a hot key are dealt evenly and meet nothing more; the others by a hash of their key, which the table has too
    # (a constant there would be folded into a filter, and all rows dealt by the key alone)
    is_hot, hashed = F.col(names[n]).isNotNull(), lambda k: F.xxhash64(*[pair[k] for pair in on])
    both = both.withColumn("hot_spread", F.when(is_hot, F.xxhash64(*rows.columns)).otherwise(hashed(0)))
    cold = table.where(F.col(n) <= bound).withColumn("cold_spread", hashed(1))
    same = [F.col(a) == F.col(b) for a, b in on]
    met = both.join(cold, [*same, F.col("hot_spread") == F.col("cold_spread")], "left").where(is_hot | F.col(n).isNotNull())
    return met.select(*rows.columns, *[F.coalesce(names[c], c).alias(c) for c in table.columns])


def identity(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns, 128 bits together: what a row is joined back by.  Rows with the same are equal, and any will do."""
    own = [(F.col("`" + c.replace("`", "``") + "`"), t) for c, t in df.dtypes]
    own = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else c for c, t in own]
    return F.xxhash64(*own), F.xxhash64(F.lit(1), *own)


def identified(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its rows' identity in two columns of new names, and these."""
    names = [fresh(df, c) for c in ("identity_a", "identity_b")]
    return df.withColumns(dict(zip(names, identity(df), strict=True))), names


def without_repeats(docs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` and a ``table`` made of its rows (with their identity as ia and ib), both without rows that repeat in all columns.

    Only where the table shows that there are any do texts move.
    """
    if table.groupBy("ia", "ib").count().where("count > 1").isEmpty():
        return docs, table
    columns = docs.columns
    marked, names = identified(docs)
    return marked.dropDuplicates(names).select(*[f"`{c}`" for c in columns]), table.dropDuplicates(["ia", "ib"])


def chosen_rows(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose identity is in ``chosen`` (ia, ib), or not in it: ``how`` is left_semi or left_anti."""
    columns = docs.columns
    marked, (a, b) = identified(docs)
    keys = chosen.select(F.col("ia").alias(f"{a}_of"), F.col("ib").alias(f"{b}_of"))
    same = (F.col(a) == F.col(f"{a}_of")) & (F.col(b) == F.col(f"{b}_of"))
    return marked.join(keys.hint("shuffle_hash"), same, how).select(*[f"`{c}`" for c in columns])


def whole_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as UTF-8; null counts as empty."""
    at = batch.schema.get_field_index(column)
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
