"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its content.  The ledger holds, for each blob and each version of
each rule, what was found; a scan looks only at the pairs that the ledger lacks, at one copy of each blob, and joins findings
back to all paths with that content.  A new rule version, or new content, costs just its own pairs.

Matches are located without a UDF: the gaps between matches (``split``) and the matches themselves (``regexp_extract_all``)
alternate, so that running sums of their lengths are positions in code points.

Defined results: a null text is an empty blob; rows with a null id are found like others; rows that repeat each get the
findings; spans that start alike come in the order of the rules; very long texts are matched whole, in the JVM; an empty table
gives an empty result, an empty ledger is like none; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import MOST_LARGE, cut, looked_up


@dataclass(frozen=True)
class Rule:
    """A pattern (case of letters as written), the group whose length counts, and the least length in characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same as runs of any length of which those under 24 are dropped
)


def blobs(versions: DataFrame) -> DataFrame:
    """id and blob, the content's address, of every version."""
    return versions.select(F.col("id").cast("long").alias("id"), F.unhex(F.sha2(_text(), 256)).alias("blob"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _pieces(rule: Rule, unseen: Column) -> Column:
    """For each match: its kind, the lengths of the gap before it and of itself, and whether it is long enough."""
    pattern = F.lit(rule.pattern)
    matches, measured = F.regexp_extract_all("text", pattern, F.lit(0)), F.regexp_extract_all("text", pattern, F.lit(rule.group))
    gaps = F.slice(F.split("text", rule.pattern, -1), 1, F.size(matches))
    long = F.transform(measured, lambda x: F.length(x) >= rule.least)
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("len"), long.alias("ok"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))
    none = F.array().cast("array<struct<kind:string,at:int,gap:int,len:int,ok:boolean>>")
    return F.when(unseen & F.col("text").rlike(rule.pattern), rows).otherwise(none)


def _one_copy(texts: DataFrame, todo: DataFrame, total: int) -> DataFrame:
    """``todo`` (blob, rep, copies, seen) with the text of each blob, from one of its versions with the id ``rep``.

    Rows without an id, or with a repeated one, may all hold one text.  Blobs of more than a MOST_LARGE-th of the versions are sent to
    all tasks, which give one copy each; their other copies move nowhere.
    """
    bound = max(1024, -(-total // MOST_LARGE))
    same = lambda c: F.col("id").eqNullSafe(F.col(f"{c}rep")) & (F.col("address") == F.col(f"{c}blob"))
    columns = ["blob", "rep", "copies", "seen", "text"]
    many = todo.where(F.col("copies") > bound)
    if total <= bound or many.isEmpty():
        return texts.join(todo.hint("shuffle_hash"), same("")).select(*columns)
    own = texts.join(F.broadcast(many), same("")).groupBy("blob").agg(*[F.first(c).alias(c) for c in columns[1:]])
    keys = F.broadcast(many.select(F.col("blob").alias("hot_blob")))
    few = texts.join(keys, F.col("address") == F.col("hot_blob"), "left_anti")
    return few.join(todo.where(F.col("copies") <= bound).hint("shuffle_hash"), same("")).select(*columns).unionByName(own)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(id, blob, spans) of every version, and the ledger's new rows (blob, kind, version, spans).

    ``versions`` has id and text; spans are arrays of struct<kind, start, end>, ends exclusive, in code points.
    """
    addressed = cut(blobs(versions), "blobs")
    first = addressed.groupBy("blob").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    wanted = [f"{r.kind}:{r.version}" for r in rules]
    if ledger is None:
        todo = first.withColumn("seen", F.array().cast("array<string>"))
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
        todo = first.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), "seen")) > 0)
    todo = cut(todo, "unseen")

    # one copy of each unseen blob: a text moves once, the hash tables hold the ids
    texts = versions.select(F.col("id").cast("long").alias("id"), F.unhex(F.sha2(_text(), 256)).alias("address"), _text().alias("text"))
    one = _one_copy(texts, todo, addressed.count())
    every = F.concat(*[_pieces(r, ~F.array_contains("seen", w)) for r, w in zip(rules, wanted, strict=True)])
    matches = one.select("blob", "rep", every.alias("m")).where(F.size("m") > 0).select("blob", F.explode("m").alias("m")).select("blob", "m.*").dropDuplicates(["blob", "kind", "at"])
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).where("ok")
    span = F.struct((F.col("end") - F.col("len")).alias("start"), F.col("end"))
    found = placed.groupBy("blob", "kind").agg(F.sort_array(F.collect_list(span)).alias("spans"))

    pairs = todo.select("blob", F.explode(F.array_except(F.array(*map(F.lit, wanted)), "seen")).alias("w"))
    pairs = pairs.select("blob", F.split("w", ":")[0].alias("kind"), F.split("w", ":")[1].cast("int").alias("version"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    fresh = cut(pairs.join(found, ["blob", "kind"], "left").withColumn("spans", F.coalesce("spans", empty)), "ledger")

    whole = fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns))
    whole = whole.where(F.size("spans") > 0).where(F.concat_ws(":", "kind", "version").isin(wanted))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    flat = whole.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end"))).alias("s"))
    of_blob = flat.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    of_blob = of_blob.select("blob", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    every = first.join(of_blob, "blob", "left").select(F.col("blob").alias("b"), "copies", F.coalesce("spans", none).alias("spans"))
    total = addressed.count()
    return looked_up(addressed, every, [("blob", "b")], "copies", total).select("id", "blob", "spans"), fresh


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings as counts for each kind, the spans as a string, and its SHA-256."""
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda k: k == r.kind), False)).cast("long").alias(f"n_{r.kind}") for r in rules]
    return found.select("id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
