"""Appends and checkpoints that are there whole or not at all.

What is written goes to a hidden folder first, by Spark's own writers, whose failed tasks leave nothing.  When all of it is
there, one rename makes it visible.  A writer that dies before leaves a folder that no reader sees and ``sweep`` deletes.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sieveline.operators import network

#: The folder of writes that are not committed, hidden from readers by its first letter.
STAGED = "_staged"
HEADER = "header"
WHICH = ("best", "last")


def _fs(spark: SparkSession, path: str):
    """The file system of a path, a maker of paths, and a rename that never replaces unless told to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    system = make(path).getFileSystem(conf)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")

    def rename(a: str, b: str, replace: bool = False) -> None:
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        system_path = lambda p: system.makeQualified(make(p))
        context.rename(system_path(a), system_path(b), how)

    return system, make, rename


def _children(spark: SparkSession, folder: str) -> list[str]:
    system, make, _ = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(make(folder))) if system.exists(make(folder)) else []


def _put_text(spark: SparkSession, text: str, path: str) -> None:
    system, make, _ = _fs(spark, path)
    out = system.create(make(path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def _publish(spark: SparkSession, staged: str, folder: str) -> int:
    """Rename a staged folder to the next number; of writers at the same time each takes a number of its own."""
    _, _, rename = _fs(spark, folder)
    taken = [int(n) for n in _children(spark, folder) if n.isdigit()]
    number = max(taken, default=0) + 1
    while True:
        try:
            rename(staged, f"{folder}/{number:08d}")
            return number
        except Exception as error:
            if f"{number:08d}" not in _children(spark, folder):
                raise error
            number += 1


def append_csv(rows: DataFrame, folder: str) -> int:
    """Append rows to a log of comma-separated text: all of them or, if a task fails for good, none.  The append's number.

    The header is one file, written by the first append; an append with other columns is refused before anything is written.
    In the order of their names the files are one log with the header on top.
    """
    spark = rows.sparkSession
    folder = folder.rstrip("/")
    system, make, _ = _fs(spark, folder)
    head = ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns) + "\n"
    place = f"{folder}/00000000/{HEADER}.csv"
    if not system.exists(make(place)):
        hidden = f"{folder}/{STAGED}/{uuid.uuid4().hex}"
        _put_text(spark, head, f"{hidden}/{HEADER}.csv")
        try:
            _fs(spark, folder)[2](hidden, f"{folder}/00000000")
        except Exception as error:  # another first append was faster
            system.delete(make(hidden), True)
            if not system.exists(make(place)):
                raise error
    if (found := _get_text(spark, place)) != head:
        raise ValueError(f"the log has the columns {found.strip()}, not {head.strip()}")
    staged = f"{folder}/{STAGED}/{uuid.uuid4().hex}"
    try:
        rows.write.option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(staged)
        return _publish(spark, staged, folder)
    except Exception:
        system.delete(make(staged), True)
        raise


def read_appended(spark: SparkSession, folder: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of all appends that were committed, as strings or in a schema of the same columns.

    An empty text and a null stay apart; a text of U+0000 alone comes back empty.  A log without appends is an error without a schema, no rows with one.
    """
    folder = folder.rstrip("/")
    parts = [f"{folder}/{n}" for n in _children(spark, folder) if n.isdigit() and int(n) > 0]
    if schema is None:
        names = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/00000000/{HEADER}.csv").columns
        schema = StructType()
        for n in names:
            schema = schema.add(n, StringType())
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("escape", '"').option("emptyValue", "\0").option("nullValue", "").option("multiLine", True).csv(parts)
    return rows.select(*[F.when(F.col(f"`{c}`") == "\0", "").otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])


def sweep(spark: SparkSession, folder: str) -> None:
    """Delete what writers that died have left.  Only when no writer is at work."""
    system, make, _ = _fs(spark, folder)
    system.delete(make(f"{folder.rstrip('/')}/{STAGED}"), True)


def save_checkpoint(spark: SparkSession, folder: str, epoch: int, weights: dict[str, np.ndarray], score: float) -> bool:
    """Weights as ``epoch_N``, and the names ``last`` and, if the score is the best so far, ``best``.  Whether it is.

    The weights become visible by one rename and are never changed; a name is a small file that is replaced by a rename, so
    that a reader finds the old weights or the new.  An epoch that is saved again replaces nothing and is an error.
    """
    folder = folder.rstrip("/")
    _, _, rename = _fs(spark, folder)
    name, staged = f"epoch_{epoch}", f"{folder}/{STAGED}/{uuid.uuid4().hex}"
    if name in _children(spark, folder):
        raise ValueError(f"{name} is there already")
    network.save_weights(weights, spark, staged)
    rename(staged, f"{folder}/{name}")
    best = not np.isnan(score) and ((old := _manifest(spark, folder, "best")) is None or score > old[1])
    for which in ("last", "best") if best else ("last",):
        hidden = f"{folder}/{STAGED}/{uuid.uuid4().hex}"
        _put_text(spark, f"{name} {float(score)!r}", hidden)
        rename(hidden, f"{folder}/{which}", replace=True)
    return best


def _manifest(spark: SparkSession, folder: str, which: str) -> tuple[str, float] | None:
    if which not in _children(spark, folder):
        return None
    name, score = _get_text(spark, f"{folder}/{which}").split(" ")
    return name, float(score)


def load_checkpoint(spark: SparkSession, folder: str, which: str = "best") -> dict[str, np.ndarray]:
    """The weights of ``best``, ``last`` or ``epoch_N``."""
    folder = folder.rstrip("/")
    if which in WHICH:
        found = _manifest(spark, folder, which)
        if found is None:
            raise ValueError(f"no checkpoint is named {which}")
        which = found[0]
    return network.load_weights(spark, f"{folder}/{which}")
