"""What came before a row in the order of its key, without one task a key.

Rows are sorted by key and order into parts of the order, so that a key with a third of all rows lies in many of them.  A part
sums up its own rows; what the key's earlier parts add comes as one row for each part that goes on with the key of the part
before it, hence at most as many rows as there are parts, however many keys and rows there are.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.scratch import cut, fresh

#: Bits of a row's place that count within its part.
WITHIN = 33


class Ordered:
    """``rows``, written once in the order of ``keys`` and ``order``, each with its place.

    Rows that tie in both keep the order in which they were written, the same for all that is asked of them.  Rows that tie lie
    in one part: order by enough columns to tell a mass of rows apart.  A null key is a key, null values come first in an order.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list) -> None:
        self.place = fresh(rows, "place")
        self.keys = list(keys)
        self.rows = cut(rows.orderBy(*keys, *order).withColumn(self.place, F.monotonically_increasing_id()), "ordered")

    def with_before(self, name: str, value: Column, how: str = "max") -> Ordered:
        """A column: the ``max`` or ``sum`` of a value over the key's rows before this one; null, for sums 0, if there are none."""
        fold = {"max": F.max, "sum": F.sum}[how]
        part, carried = fresh(self.rows, "part"), fresh(self.rows, "carried")
        rows = self.rows.withColumn(part, F.shiftright(F.col(self.place), WITHIN))
        before = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(part, *self.keys).agg(fold(value).alias(carried))
        sums = sums.withColumn(carried, fold(carried).over(before(self.keys, part))).where(F.col(carried).isNotNull())
        names = [f"{carried}_{k}" for k in range(len(self.keys) + 1)]
        sums = F.broadcast(sums.toDF(*names, carried))
        same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip([part, *self.keys], names, strict=True)]
        own = fold(value).over(before([part, *self.keys], self.place))
        both = F.greatest(own, F.col(carried)) if how == "max" else F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))
        made = copy(self)
        made.rows = rows.join(sums, same, "left").withColumn(name, both).drop(part, carried, *names)
        return made

    def result(self, *more: str) -> DataFrame:
        """The rows without their places."""
        return self.rows.drop(self.place, *more)
