"""Intervals of matches in raw text: finding, merging, splitting for highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.ordered import Ordered
from sieveline.scratch import fresh


def merged_intervals(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end): intervals that touch or overlap become one; one without a start or an end is none.

    Of intervals with one start the longest is kept before anything is ordered; a key's intervals are dealt over parts of the order.
    """
    longest = rows.where("start IS NOT NULL AND end IS NOT NULL").groupBy(key, "start").agg(F.max("end").alias("end"))
    before, earlier, group = (fresh(longest, c) for c in ("before", "earlier", "group"))
    made = Ordered(longest, [key], ["start"]).with_before(before, F.col("end"))
    opens = F.when(F.col(before).isNull() | (F.col("start") > F.col(before)), 1).otherwise(0)
    made = made.with_before(earlier, opens, "sum")
    return made.rows.groupBy(key, (F.col(earlier) + opens).alias(group)).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop(group)


def word_places(text: Column, word: str) -> Column:
    """Where a word, in any case, begins in a text, as 0-based places, without overlap.

    The text itself is cut, not its lower case, which may be longer.
    """
    gaps = F.split(text, "(?iu)" + quoted(word), -1)
    n = F.size(gaps) - 1
    ends = F.aggregate(F.slice(gaps, F.lit(1), F.greatest(n, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("o")), lambda a, g: F.struct((a["at"] + F.length(g) + len(word)).alias("at"), F.concat(a["o"], F.array(a["at"] + F.length(g))).alias("o")))
    return ends["o"]


def quoted(word: str) -> str:
    """A pattern for the word itself."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def match_intervals(rows: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    each = F.concat(*[_intervals(F.col(text), w) for w in words])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.start", "x.end")


def _intervals(text: Column, word: str) -> Column:
    size = len(word)
    return F.transform(word_places(text, word), lambda s: F.struct(s.alias("start"), (s + size).alias("end")))


def highlighted(text: Column, intervals: Column) -> Column:
    """The text cut into (text, hit) parts by sorted, disjoint intervals; joined they are the text."""
    last = F.coalesce(F.try_element_at(intervals, F.lit(-1))["end"], F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.transform(intervals, lambda x: x["end"]))
    part = lambda a, b, hit: F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(hit).alias("hit"))
    both = F.flatten(F.transform(intervals, lambda x, i: F.array(part(F.element_at(starts, i + 1), x["start"], False), part(x["start"], x["end"], True))))
    return F.filter(F.concat(both, F.array(F.struct(F.substring(text, last + 1, F.length(text)).alias("text"), F.lit(False).alias("hit")))), lambda p: p["text"] != "")


def batches(rows: DataFrame, key: str, order: list[str], size: int = 50) -> DataFrame:
    """A column ``batch``: rows of a key numbered in blocks, from 0; a key's rows are dealt over parts of the order."""
    number = fresh(rows, "number")
    made = Ordered(rows, [key], order).with_before(number, F.lit(1), "sum")
    return made.result().withColumn("batch", F.floor(F.col(number) / size).cast("int")).drop(number)
