"""The always-on scan as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import strip, token_texts
from sieveline.operators.tagging import moderate
from sieveline.scratch import is_file, new_folder


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file, which is picked from its folder, or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema, one = spark.read.parquet(path).schema, is_file(spark, path)
    return read_stream(spark, sf_dir, schema, f"{name}.parquet") if one else read_stream(spark, path, schema)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a time stamp that a watermark accepts."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run over all that is there and give the result table, which is written to the shared folder, batch by batch.

    A complete result is written anew by each batch; appended rows are added.
    """
    spark = stream.sparkSession
    state, out = new_folder(spark, "stream-state"), new_folder(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number if mode == 'append' else 0}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def running_counts(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n"))


def windowed_rate(events: DataFrame, width: str, flagged) -> DataFrame:
    """Per window: how many events, and how many are flagged."""
    w = events.withWatermark("ts", "1 day").groupBy(F.window("ts", width))
    return w.agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged")).select(F.col("window.start").alias("start"), "n", "flagged")


def bursts(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Events of a key that follow within the gap are one burst."""
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark([key])


def latest_settings(settings: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Of a table of settings with versions the last row of each key."""
    rest = [c for c in settings.columns if c not in (key, version)]
    return settings.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("x")).select(key, "x.*")


def with_live_config(stream: DataFrame, settings, key: str, after=None) -> DataFrame:
    """The rows of a stream with the settings of their key, which ``settings()`` reads anew for each micro-batch.

    The table may change while the query runs: a batch has what is there when it begins, and keeps it if it is repeated after a
    failure only if the table keeps its versions.  ``after(number)`` is called when a batch has been written.  The result is
    a table; rows that have come twice, since a batch was repeated, replace themselves.
    """
    spark = stream.sparkSession
    state, out = new_folder(spark, "live-state"), new_folder(spark, "live")
    kinds = stream.limit(0).schema  # the names that are there before settings are joined
    joined = latest_settings(settings(), key)
    schema = spark.createDataFrame([], kinds).join(joined, key, "left").schema
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")

    def write(rows: DataFrame, number: int) -> None:
        now = latest_settings(settings(), key)
        rows.join(now, key, "left").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after is not None:
            after(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def moderated(stream: DataFrame, entries: DataFrame, key: str, text: str = "text", sensitivity: str = "standard", state: str | None = None, out: str | None = None) -> DataFrame:
    """The verdicts of a stream's texts, in every sensitivity: each micro-batch is moderated as a table would be.

    Texts are judged one by one, so that a batch's verdicts do not hang on where the stream was cut.  ``state`` and ``out`` are
    folders that outlive the query; a query that is started again goes on where the last one ended.
    """
    spark = stream.sparkSession
    state, out = state or new_folder(spark, "moderation-state"), out or new_folder(spark, "moderation")
    empty = moderate(spark.createDataFrame([], stream.schema), entries, key, text)
    empty.write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(rows: DataFrame, number: int) -> None:
        rows.persist()  # the stricter sensitivities read the batch twice: for its vocabulary, and for its verdicts
        moderate(rows, entries, key, text, sensitivity).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(empty.schema).option("recursiveFileLookup", True).parquet(out)


def read_lines_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The lines of a folder's text files as they come, blank ones left out: ``value``, and ``doc_id``, a hash of file and line.

    Equal lines of a file have the same id and the same verdict.
    """
    reader = spark.readStream.format("text")
    lines = (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)
    return lines.where(strip(F.col("value")) != "").select(F.xxhash64("_metadata.file_path", "value").alias("doc_id"), "value")


def flagged_lines(lines: DataFrame, words: list[str]) -> DataFrame:
    """Stateless scoring of lines: the flagged words of each, and whether it is safe."""
    hits = F.filter(F.transform(token_texts(F.col("value")), F.lower), lambda t: t.isin(*words))
    return lines.where(strip(F.col("value")) != "").withColumn("flagged_words", F.array_distinct(hits)).withColumn("safe", F.size("flagged_words") == 0)


def scan_batches(stream: DataFrame, handle) -> None:
    """One micro-batch at a time to a function of (rows, number)."""
    stream.writeStream.foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()
