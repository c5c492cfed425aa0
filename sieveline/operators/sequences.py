"""Tagged sentences as rows and as sequences: reading with checks, positions, ids of words and characters, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import strip
from sieveline.operators.evaluate import TAGS
from sieveline.scratch import fresh, ranked

#: Columns that a file of tagged tokens may have its tags in, the first that is there counts (fixed values).
TAG_COLUMNS = ("tag", "final_tag", "weak_tag")


def missing_columns(rows: DataFrame, wanted: list[str]) -> list[str]:
    return sorted(set(wanted) - set(rows.columns))


def unknown_tags(rows: DataFrame, tag: str, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """The distinct tags that are none of the known ones."""
    known = rows.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    return rows.select(F.col(tag).alias("tag")).distinct().join(F.broadcast(known), "tag", "left_anti")


def bio_sequences(rows: DataFrame, order: str, sent_id: str | None = None, token: str = "token", tag: str | None = None, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(sent_id, tokens, tags) of tagged tokens, tokens stripped and in lower case, in the order of a column.

    The sentence is named by gold_id, else sent_id; the tag is in the first of TAG_COLUMNS.  A missing column is an error at once,
    an unknown tag when the rows are read.
    """
    sent_id = sent_id or ("gold_id" if "gold_id" in rows.columns else "sent_id")
    tag = tag or next((c for c in TAG_COLUMNS if c in rows.columns), None)
    if tag is None:
        raise ValueError(f"one of these columns must hold the tags: {TAG_COLUMNS}")
    if gone := missing_columns(rows, [sent_id, token, tag, order]):
        raise ValueError(f"the rows have no columns {gone}")
    known = F.coalesce(F.col(tag).isin(*tags), F.lit(False))
    sure = F.when(known, F.col(tag)).otherwise(F.raise_error(F.concat(F.lit("unknown tag "), F.coalesce(F.col(tag), F.lit("null")), F.lit(" in "), F.col(sent_id).cast("string"))))
    step = F.struct(F.col(order).alias("o"), F.lower(strip(F.coalesce(F.col(token), F.lit("")))).alias("token"), sure.alias("tag"))
    by = rows.groupBy(F.col(sent_id).cast("string").alias("sent_id")).agg(F.array_sort(F.collect_list(step)).alias("x"))
    return by.select("sent_id", F.transform("x", lambda s: s["token"]).alias("tokens"), F.transform("x", lambda s: s["tag"]).alias("tags"))


def whole_sequences(rows: DataFrame, sent_id: str = "sent_id", *more: str, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """The same of rows that hold a sentence each, with tokens and tags as arrays: nothing is shuffled, and rows of one id stay apart.

    Sentences without a token are left out, as they have no rows of tokens; an unknown tag is an error when the rows are read.
    """
    known = F.forall("tags", lambda t: F.coalesce(t.isin(*tags), F.lit(False)))
    sure = F.when(known, F.col("tags")).otherwise(F.raise_error(F.concat(F.lit("unknown tag in "), F.col(sent_id).cast("string"))))
    tokens = F.transform("tokens", lambda t: F.lower(strip(F.coalesce(t, F.lit("")))))
    return rows.where("size(tokens) > 0").select(F.col(sent_id).cast("string").alias("sent_id"), tokens.alias("tokens"), sure.alias("tags"), *more)


def zipped(left: Column, right: Column, what: str = "tags") -> Column:
    """array<struct<left, right>> by position; arrays of different length are an error."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.when(F.size(left) == F.size(right), pairs).otherwise(F.raise_error(F.lit(f"{what} of different length")))


def positions(rows: DataFrame, key: str, order: list[str], name: str = "pos") -> DataFrame:
    """Each row's place, from 0, within its key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows back in the order that they were read in."""
    return rows.orderBy(*order)


def renamed(rows: DataFrame, names: dict[str, str], first: list[str] = (), inserted: dict[str, Column] | None = None) -> DataFrame:
    """Columns renamed, new ones inserted, those of ``first`` in front."""
    out = rows.withColumnsRenamed(names)
    for name, value in (inserted or {}).items():
        out = out.withColumn(name, value)
    return out.select(*first, *[c for c in out.columns if c not in first])


def token_ids(tokens: DataFrame, token: str, vocabulary: DataFrame, unknown: int = 1) -> DataFrame:
    """``tokens`` with the id that the vocabulary (token, id) gives, the unknown one else.  Joined by the word, whatever its size."""
    word, known = fresh(tokens, "word"), fresh(tokens, "known_id")
    ids = vocabulary.select(F.col("token").alias(word), F.col("id").alias(known))
    return tokens.join(ids, F.col(token) == F.col(word), "left").withColumn("id", F.coalesce(known, F.lit(unknown))).drop(word, known)


def counters(sequences: DataFrame) -> DataFrame:
    """(kind, value, n) of the words, characters and tags of sequences, in one pass."""
    each = sequences.select(F.explode(F.concat(
        F.transform("tokens", lambda t: F.struct(F.lit("word").alias("kind"), t.alias("value"))),
        F.flatten(F.transform("tokens", lambda t: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.struct(F.lit("char").alias("kind"), c.alias("value"))))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))),
    )).alias("x"))
    return each.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def padded(ids: Column, width: Column | int, pad: int = 0) -> Column:
    """struct<ids, mask, length> of ids filled up to a width."""
    n = F.size(ids)
    more = F.greatest((F.lit(width) if isinstance(width, int) else width) - n, F.lit(0))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), more)).alias("ids"), F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), more)).alias("mask"), n.alias("length"))


def mini_batches(sequences: DataFrame, ids: str, order: list[str], size: int = 32) -> DataFrame:
    """(batch, rows) of padded sequences: the sequences in order, cut into batches, each filled up to its longest."""
    numbered = ranked(sequences, [F.col(c) for c in order], "place").withColumn("batch", F.floor((F.col("place") - 1) / size))
    by = numbered.groupBy("batch").agg(F.max(F.size(ids)).alias("width"), F.array_sort(F.collect_list(F.struct("place", F.col(ids).alias("ids")))).alias("x"))
    return by.select("batch", F.transform("x", lambda r: padded(r["ids"], F.col("width"))).alias("rows"))
