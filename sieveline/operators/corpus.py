"""Building datasets: noise filter, near-duplicate removal, sampling, splitting, augmentation, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import FOREIGN_SCRIPTS, TAMIL_BLOCK, dedup_key, embedding_tokens, normalize, stop_word_hits, strip
from sieveline.scratch import fresh, numbered, small

#: Labels of offensive rows (fixed values).
OFFENSIVE_LABELS = (
    "Offensive_Untargetede",
    "Offensive_Targeted_Insult_Group",
    "Offensive_Targeted_Insult_Individual",
    "Offensive_Targeted_Insult_Other",
    "Misandry",
    "Misogyny",
    "Xenophobia",
    "Homophobia",
    "Transphobic",
    "abusive",
)
SEED = 13


def usable(pool: DataFrame) -> DataFrame:
    """text and label trimmed, null or blank texts dropped."""
    rows = pool.dropna(subset=["text", "label"]).withColumn("text", strip(F.col("text"))).withColumn("label", strip(F.col("label")))
    return rows.where("text != ''")


def noise_reason(text: Column, label: Column, least_hits: int = 3) -> Column:
    """Why a row is noise: its label, a foreign script, or French words without Tamil; the first reason counts."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.coalesce(label, F.lit("")).rlike("(?i)^not[-_ ]?tamil$"), "label")
        .when(t.rlike(FOREIGN_SCRIPTS), "script")
        .when(~t.rlike(TAMIL_BLOCK) & (stop_word_hits(t) >= least_hits), "french")
    )


def keep_first(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key.  Only the least of each task is shuffled."""
    whole = F.struct(*[f"`{c}`" for c in rows.columns])
    return rows.groupBy(key.alias("key")).agg(F.min_by(whole, F.struct(*order)).alias("first")).select("first.*")


def near_duplicates_removed(rows: DataFrame, text: str, order: list[Column], keep_marks: bool = False) -> DataFrame:
    return keep_first(rows, dedup_key(F.col(text), keep_marks), order)


def draw(*parts: Column | str, seed: int = SEED) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def uniform(*parts: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the draw."""
    return F.conv(F.substring(draw(*parts, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def quotas(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, size, quota): rounded shares of n, the drift on the largest stratum, none above its size."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    total = Window.partitionBy()
    share = counts.withColumn("total", F.sum("size").over(total)).withColumn("quota", F.bround(F.col("size") * n / F.col("total")).cast("long"))
    first = Window.orderBy(F.desc("size"), stratum)
    drift = F.lit(n) - F.sum("quota").over(total)
    share = share.withColumn("k", F.row_number().over(first)).withColumn("quota", F.col("quota") + F.when(F.col("k") == 1, drift).otherwise(0))
    return share.select(stratum, "size", F.when(F.col("total") <= n, F.col("size")).otherwise(F.least("quota", "size")).alias("quota"))


def first_drawn(rows: DataFrame, plan: DataFrame, stratum: str, key: str, chosen: str, seed: int = SEED) -> DataFrame:
    """``rows`` with a column ``chosen``: whether a row is among the first of its stratum, by the quota of ``plan`` (stratum, quota).

    Draws are counted in buckets of their first digits.  Rows of buckets before the one that the quota falls in are chosen as
    they are; only that bucket's rows are put in order, so that no task orders a stratum.
    """
    names = {c: fresh(rows, c) for c in ("bucket", "of", "cut", "need", "rank")}
    bucket = F.col(names["bucket"])
    rows = rows.withColumn(names["bucket"], F.substring(draw(key, seed=seed), 1, 4))
    counts = rows.groupBy(F.col(stratum).alias("s"), bucket.alias("b")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumn("sum", F.sum("n").over(upto)).join(plan.select(F.col(stratum).alias("t"), "quota"), F.col("s").eqNullSafe(F.col("t")))
    at = sums.where("sum >= quota").groupBy("s").agg(F.min(F.struct("b", (F.col("quota") - F.col("sum") + F.col("n")).alias("need"))).alias("x"))
    at = at.select(F.col("s").alias(names["of"]), F.col("x.b").alias(names["cut"]), F.col("x.need").alias(names["need"]))
    placed = rows.join(small(at), F.col(stratum).eqNullSafe(F.col(names["of"])), "left")
    split = bucket == F.col(names["cut"])
    order = Window.partitionBy(stratum).orderBy(draw(key, seed=seed), key)
    inside = placed.where(split).withColumn(names["rank"], F.row_number().over(order)).withColumn(chosen, F.col(names["rank"]) <= F.col(names["need"])).drop(names["rank"])
    outside = placed.where(~split | F.col(names["cut"]).isNull()).withColumn(chosen, F.coalesce(bucket < F.col(names["cut"]), F.lit(False)))
    return outside.unionByName(inside).drop(*[names[c] for c in ("bucket", "of", "cut", "need")])


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly n rows (all, if fewer) by stratum, in a seeded order; small strata are topped up from the rest."""
    chosen = fresh(rows, "chosen")
    drawn = first_drawn(rows, quotas(rows, stratum, n), stratum, key, chosen, seed)
    # chosen rows first, then the others: one cut at n gives the quota and the top-up
    return drawn.orderBy(F.desc(chosen), draw(key, seed=seed), key).limit(n).drop(chosen)


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: int = SEED) -> DataFrame:
    """A column ``split``: the first half of each stratum, in a seeded order, is dev, the rest test."""
    chosen = fresh(rows, "chosen")
    half = rows.groupBy(stratum).agg(F.floor(F.count("*") / 2).alias("quota"))
    return first_drawn(rows, half, stratum, key, chosen, seed).withColumn("split", F.when(F.col(chosen), "dev").otherwise("test")).drop(chosen)


def train_split(weak: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Weak rows whose id is not in gold."""
    return weak.join(gold.select(key).distinct(), key, "left_anti")


def oversampled(tokens: DataFrame, copies: int = 2, drop: float = 0.1, seed: int = SEED, bad: Column | None = None) -> DataFrame:
    """Noisy copies of each sentence with abuse: (sent_id, copy, pos, token, tag); O tokens are dropped now and then.

    ``bad``: whether a token's sentence has abuse, where its row tells; else the sentences are joined.
    """
    if bad is None:
        kept = tokens.join(tokens.where("tag = 'B-ABUSE'").select("sent_id").distinct(), "sent_id", "left_semi")
    else:
        kept = tokens.where(bad)
    each = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return each.where((F.col("tag") != "O") | (uniform("sent_id", "copy", "pos", seed=seed) >= drop))


def injected(words: DataFrame, fillers: list[str], most_before: int, least_before: int = 1, most_after: int = 2, seed: int = SEED) -> DataFrame:
    """(sent_id, tokens, tags) of each ``phrase`` (an array, with its ``id``) between seeded fillers; ids are disjoint."""
    pool = F.array(*map(F.lit, fillers))
    some = lambda tag, least, most: F.slice(F.array_sort(F.transform(pool, lambda w: F.struct(F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), F.col("id"), w)).alias("d"), w.alias("w")))), 1, F.lit(least) + F.floor(uniform("id", F.lit(tag), seed=seed) * (most - least + 1)).cast("int"))
    bare = lambda c: F.transform(c, lambda x: x["w"])
    rows = words.withColumn("pre", bare(some("pre", least_before, most_before))).withColumn("post", bare(some("post", 0, most_after)))
    o = lambda c: F.transform(c, lambda x: F.lit("O"))
    inner = F.transform("phrase", lambda x, i: F.when(i == 0, "B-ABUSE").otherwise("I-ABUSE"))
    return rows.select(F.col("id").alias("sent_id"), F.concat("pre", "phrase", "post").alias("tokens"), F.concat(o(F.col("pre")), inner, o(F.col("post"))).alias("tags"))


def final_tag(corrected: Column, weak: Column) -> Column:
    """The corrected tag if it is not blank, else the weak one."""
    return F.coalesce(F.nullif(strip(corrected), F.lit("")), strip(weak))


def leak_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of either side, and how many are on both."""
    both = left.select(key).intersect(right.select(key))
    return left.agg(F.countDistinct(key).alias("left_ids")).crossJoin(right.agg(F.countDistinct(key).alias("right_ids"))).crossJoin(both.agg(F.count("*").alias("shared")))


def pool_status(rows: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """``rows`` with clean, the normalised lower-case text, and status: empty, duplicate (of an earlier row), untrainable or kept."""
    clean = F.lower(normalize(F.col(text)))
    made = rows.withColumn("clean", F.explode(F.array(clean)))
    trainable = F.size(embedding_tokens(F.col("clean"))) > 0
    marked, row = numbered(made.withColumn("status", F.when(F.col("clean") == "", "empty").when(~trainable, "untrainable")))
    # what is no candidate is known by itself; of equal texts the first row in order is kept, found without ordering a group
    first = fresh(marked, "first")
    kept = marked.where("status IS NULL").groupBy("clean").agg(F.min_by(row, F.struct(*order, F.col(row))).alias(first)).select(first)
    out = marked.join(kept, F.col(row) == F.col(first), "left")
    return out.withColumn("status", F.coalesce("status", F.when(F.col(first).isNull(), "duplicate").otherwise("kept"))).drop(row, first)


def pool_statistics(status: DataFrame) -> DataFrame:
    """One row: how many texts there are, how many of each status, and the tokens of those that are kept."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    tokens = F.sum(F.when(F.col("status") == "kept", F.size(embedding_tokens(F.col("clean")))).otherwise(0)).alias("tokens")
    return status.agg(F.count("*").alias("raw"), n("empty"), n("duplicate"), n("untrainable"), n("kept"), tokens)


def constant_rows(texts: DataFrame, text: str, **constants) -> DataFrame:
    """Rows of generated sentences: the text and the same values beside each."""
    return texts.select(text, *[F.lit(v).alias(c) for c, v in constants.items()])


def attach_ids(rows: DataFrame, ids: DataFrame, key: str, id_: str) -> DataFrame:
    """The rows whose key has an id, with it; keys that have none are left out."""
    return rows.join(small(ids.select(key, id_)), key)


def checked(report: DataFrame, *rules: Column) -> DataFrame:
    """A one-row report, or an error that names the rule that it breaks."""
    for rule in rules:
        report = report.where(F.when(rule, F.lit(True)).otherwise(F.raise_error(F.lit(f"a check failed: {rule._jc.toString()}")).cast("boolean")))
    return report
