"""Tables that an operator writes for itself, and names and numbers that cannot clash with a caller's."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, as in local tests, a folder of this machine is set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file, not a folder."""
    system, place = _place(spark, path)
    return system.getFileStatus(place).isFile()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that the application deletes when it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, place = _place(spark, path)
    system.deleteOnExit(place)
    if (mine := _owned.get()) is not None:
        mine.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, place = _place(spark, path)
        system.delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """All folders that are made inside are deleted at its end: for results that are written before it."""
    token = _owned.set([])
    try:
        yield
    finally:
        made = _owned.get()
        _owned.reset(token)
        delete(spark, *made)


def cut(df: DataFrame, name: str = "part", most: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    A table, not ``checkpoint()``, since the latter computes its input twice.  ``most``: rows of a file, for rows of megabytes: a
    reader takes thousands of rows of a file at once, and a writer a hundred before it looks at their size.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """``df``, written once, with a number for each row in a column of a new name.

    Decisions are joined back by this number, never by an id of the data, which may be null or repeat.
    """
    name = fresh(df, name)
    return cut(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


#: Rows of a side that is sent to all tasks, at most.
BROADCAST = 100_000


def small(df: DataFrame) -> DataFrame:
    """The rows as a local table to broadcast if their count allows it, so that they are computed once; else as they are."""
    rows = df.limit(BROADCAST + 1).toArrow()  # rows of Python objects would go to the executors through Python workers
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= BROADCAST else df


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with its rows' places, from 1, in a total order: parts of the order are ranked apart and shifted by what precedes.

    No task holds more than a part; the driver holds one number for each.
    """
    part = fresh(df, "part")
    sorted_ = cut(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "sorted")
    sizes = dict(sorted_.groupBy(part).count().collect())
    before, sums = 0, []
    for k in sorted(sizes):
        sums.append((k, before))
        before += sizes[k]
    first, at = fresh(df, "before"), fresh(df, "at")
    shifts = F.broadcast(df.sparkSession.createDataFrame(sums, f"{at} int, {first} long"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return sorted_.join(shifts, F.col(part) == F.col(at)).withColumn(name, own + F.col(first)).drop(part, at, first)
