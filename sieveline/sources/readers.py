"""Readers and writers: delimited text, lines, HTML text nodes, source discovery; always with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import strip

#: Elements whose text is not shown, and names of columns that hold text (fixed values).
SKIPPED = ("script", "style", "noscript", "textarea", "input", "select", "option", "code", "pre")
TEXT_COLUMNS = ("text", "comment", "tweet", "sentence", "content", "message", "review")


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """All columns as strings; an empty field stays an empty string, never a null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("sep", sep).option("quote", quote).option("escape", '"').option("multiLine", bool(quote)).option("nullValue", "\u0000").option("emptyValue", "").csv(path, header=header)
    return rows.fillna("")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Tab for .tsv, else the commonest of the usual signs in the first lines, which Spark reads."""
    if path.lower().endswith(".tsv"):
        return "\t"
    lines = [r.value for r in spark.read.text(path).limit(20).collect()]
    return max(",\t;|", key=lambda c: (sum(c in x for x in lines), sum(x.count(c) for x in lines), -",\t;|".index(c)))


def read_raw(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A file without a header and without quoting: a header that is there after all goes, and so does a stray last field."""
    rows = read_delimited(spark, path, [*columns, "_stray"], sep, quote="", header=False).drop("_stray")
    is_header = F.lit(True)
    for c in columns:
        is_header = is_header & (strip(F.col(c)) == c)
    return rows.where(~is_header)


def union_pools(*pools: DataFrame) -> DataFrame:
    """(text, label) of all pools."""
    out = pools[0].select("text", "label")
    for p in pools[1:]:
        out = out.unionByName(p.select("text", "label"))
    return out


def find_text_column(rows: DataFrame, asked: list[str] | None = None) -> str:
    """An asked column, else one of a usual name, else the string column whose first 200 values are longest on average."""
    names = {c.lower(): c for c in rows.columns}
    for c in [*(asked or []), *TEXT_COLUMNS]:
        if c.lower() in names:
            return names[c.lower()]
    strings = [c for c, t in rows.dtypes if t == "string"]
    if not strings:
        raise ValueError("no column holds text")
    means = rows.limit(200).agg(*[F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias(c) for c in strings]).first()
    return max(strings, key=lambda c: means[c])


def read_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    rows = spark.read.text(path).withColumnRenamed("value", "text")
    return rows if blank else rows.where(strip(F.col("text")) != "")


def discover(spark: SparkSession, folder: str, known: list[str] = ()) -> DataFrame:
    """path and size of csv, tsv and txt files below a folder that are not known yet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,tsv,txt}").load(folder)
    return files.select("path", "length").where(~F.col("path").isin(*known)) if known else files.select("path", "length")


def split_lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def text_nodes(html: Column, least: int = 3) -> Column:
    """The shown text nodes of a page, trimmed, of three characters or more, with a Latin or Tamil letter."""
    shown = html
    for tag in SKIPPED:
        shown = F.regexp_replace(shown, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "<>")
    shown = F.regexp_replace(shown, r"(?s)<!--.*?-->", "<>")
    nodes = F.transform(F.regexp_extract_all(F.concat(F.lit(">"), shown, F.lit("<")), F.lit(">([^<]+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(nodes, lambda x: (F.length(x) >= least) & x.rlike(r"[a-zA-Z\x{0B80}-\x{0BFF}]"))


def write_csv(rows: DataFrame, path: str, quote_all: bool = False, sep: str = ",") -> None:
    """RFC quoting by doubled quotes, a header in each file."""
    rows.write.mode("overwrite").option("quoteAll", quote_all).option("escape", '"').option("sep", sep).option("header", True).csv(path)


def export_csv(rows: DataFrame, path: str, quote_all: bool = False, sep: str = ",") -> None:
    """One file for a spreadsheet, a byte-order mark before its header; rows stream through the driver one part at a time."""
    options = {"quoteAll": str(quote_all).lower(), "escape": '"', "sep": sep}
    spark = rows.sparkSession
    names = ", ".join(f"c{k} string" for k in range(len(rows.columns)))
    head = spark.createDataFrame([tuple(rows.columns)], names)
    text = [rows[f"`{c}`"].cast("string").alias(f"c{k}") for k, c in enumerate(rows.columns)]
    lines = lambda df: df.select(F.to_csv(F.struct(*df.columns), options).alias("value"))
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray("\ufeff".encode() + (lines(head).first().value + "\n").encode()))
        for r in lines(rows.select(*text)).toLocalIterator():
            out.write(bytearray((r.value + "\n").encode()))
    finally:
        out.close()


def write_neighbours(found: DataFrame, path: str) -> None:
    """query, in_vocab, neighbor and score as tab-separated text; a query without a vector has one row that says so."""
    out = found.select("query", "in_vocab", F.coalesce("neighbor", F.lit("<no-vector>")).alias("neighbor"), F.when(F.col("score").isNull(), "").otherwise(F.format_string("%.4f", "score")).alias("score"))
    write_csv(out, path, sep="\t")


def write_vocabulary(spark: SparkSession, ids: dict[str, int], path: str) -> None:
    """A vocabulary as one JSON document; its size is bounded by its making."""
    spark.createDataFrame([(json.dumps(ids, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; a report's limit is a part of it."""
    cell = lambda x: "" if x is None else str(x).replace("\n", " ").replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(most).collect()])
