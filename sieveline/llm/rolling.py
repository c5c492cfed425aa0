"""Rolling window features over minute panes.

Rows are aggregated once per key and minute: their count, the sum of their lengths, the set of their languages, and a histogram of
their lengths in order.  A window that begins and ends on minutes is a run of panes, so that it needs no rows: its count and sum are
sums, its languages a union, and its ranks are read off the panes' histograms, merged in order and counted cumulatively.

No task holds a whole key: the panes of a key are dealt by blocks of time as long as the widest window, and each pane goes to its
own block and to the next one, whose windows may reach back to it.  So a task's group has the panes of two widths at most, however
long the key's history is, and every pane moves twice.  A pane is as large as its distinct lengths and languages are many, not its
rows.  Rows meet their pane's features again by key and minute; keys of many rows are sent to all tasks.

Defined results: a null key is one of its own; a row without a time is in no window, and has itself a window without rows; a null
length counts as a row and adds nothing else; repeated rows count as often as they come; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import cut, looked_up

MINUTE = 60
#: What a window's features are made of: name, and its type.
FEATURES = "struct<window_s:bigint,n_events:bigint,sum_chars:bigint,n_langs:bigint,median_chars:bigint,high_chars:bigint>"


def panes(rows: DataFrame) -> DataFrame:
    """The panes of ``rows`` (key, minute, length, lang): key, minute, n, total, langs, lengths (array of (length, n) in order).

    Rows are counted by length and language before they are dealt by pane.
    """
    counted = rows.groupBy("key", "minute", "length", "lang").agg(F.count("*").alias("n"))
    known = F.col("length").isNotNull()
    by_length = counted.groupBy("key", "minute", "length").agg(F.sum("n").alias("n"), F.collect_set("lang").alias("langs"))
    return by_length.groupBy("key", "minute").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0)).alias("total"),
        F.array_distinct(F.flatten(F.collect_list("langs"))).alias("langs"),
        F.array_sort(F.collect_list(F.when(known, F.struct("length", "n")))).alias("lengths"),
    )


def _ranks(histogram: Column, places: list[Column]) -> Column:
    """The lengths at some places, counted from 1, of a histogram in order: an array; null where there is no such place."""
    none = F.lit(None).cast("bigint")

    def step(state: Column, part: Column) -> Column:
        reached = state["n"] + part["n"]
        new = [F.when(state[f"r{i}"].isNull() & (place <= reached), part["length"]).otherwise(state[f"r{i}"]).alias(f"r{i}") for i, place in enumerate(places)]
        return F.struct(reached.alias("n"), *new)

    start = F.struct(F.lit(0).cast("bigint").alias("n"), *[none.alias(f"r{i}") for i in range(len(places))])
    return F.aggregate(histogram, start, step, lambda s: F.array(*[s[f"r{i}"] for i in range(len(places))]))


def window_features(made: DataFrame, widths: list[int]) -> DataFrame:
    """For each pane (key, minute) an array of FEATURES, one for each width in seconds, of the panes that precede it."""
    minutes = [w // MINUTE for w in widths]
    if any(w % MINUTE or w <= 0 for w in widths):
        raise ValueError("a window is a whole number of minutes")
    block = max(minutes)
    own = F.floor(F.col("minute") / block).cast("bigint")
    dealt = made.withColumn("block", F.explode(F.array(own, own + 1))).withColumn("home", F.col("block") == own)
    columns = {}
    for i, width in enumerate(minutes):
        over = Window.partitionBy("key", "block").orderBy("minute").rangeBetween(-width, -1)
        columns |= {
            f"n{i}": F.coalesce(F.sum("n").over(over), F.lit(0)),
            f"total{i}": F.coalesce(F.sum("total").over(over), F.lit(0)),
            f"langs{i}": F.size(F.array_distinct(F.flatten(F.collect_list("langs").over(over)))),
            f"lengths{i}": F.array_sort(F.flatten(F.collect_list("lengths").over(over))),
        }
    found = dealt.withColumns(columns).where("home")

    def features(i: int) -> Column:
        histogram = F.col(f"lengths{i}")
        count = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda n, part: n + part["n"])
        ranks = F.transform(F.array(count), lambda m: _ranks(histogram, [F.floor((m + 1) / 2), F.floor((3 * m + 3) / 4)]))[0]
        return F.struct(F.lit(widths[i]).cast("bigint"), f"n{i}", f"total{i}", F.col(f"langs{i}").cast("bigint"), ranks[0], ranks[1]).cast(FEATURES)

    return found.select("key", "minute", F.array(*[features(i) for i in range(len(widths))]).alias("features"), "n")


def rolling_features(rows: DataFrame, key: Column, seconds: Column, length: Column, lang: Column, widths: list[int]) -> DataFrame:
    """``rows`` with a column ``features``: for each width what the rows of its key hold in ``[seconds - width, seconds)``.

    ``seconds`` is a whole number of minutes.  Names of the result's own columns must be free in ``rows``.
    """
    known_key = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    own = rows.withColumns({"rolling_key": known_key, "rolling_minute": F.coalesce(F.floor(seconds / MINUTE).cast("bigint"), F.lit(-(2**62)))})
    slim = rows.select(known_key.alias("key"), F.floor(seconds / MINUTE).cast("bigint").alias("minute"), length.cast("bigint").alias("length"), lang.cast("string").alias("lang"))
    made = cut(panes(slim.where(F.col("minute").isNotNull())), "panes")
    found = cut(window_features(made, widths).withColumnsRenamed({"key": "pane_key", "minute": "pane_minute", "n": "pane_n"}), "features")
    total, none = rows.count(), F.array(*[F.struct(F.lit(w), F.lit(0), F.lit(0), F.lit(0), F.lit(None), F.lit(None)).cast(FEATURES) for w in widths])
    timed = own.where(F.col("rolling_minute") > -(2**62))
    met = looked_up(timed, found, [("rolling_key", "pane_key"), ("rolling_minute", "pane_minute")], "pane_n", total)
    untimed = own.where(F.col("rolling_minute") == -(2**62)).withColumn("features", none)
    keep = [*[f"`{c}`" for c in rows.columns], "features"]
    return met.select(*keep).unionByName(untimed.select(*keep))
