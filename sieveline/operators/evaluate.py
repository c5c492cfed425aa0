"""Evaluation: precision, recall and F1 by class, pooled and by sentence; errors; class weights; vocabulary ids."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.ordered import Ordered
from sieveline.scratch import fresh, ranked

#: Tags (fixed values).
TAGS = ("O", "B-ABUSE", "I-ABUSE")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, 0 where undefined."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return [p.alias("precision"), r.alias("recall"), zero(F.try_divide(2 * p * r, p + r)).alias("f1")]


def _counts(gold: Column, pred: Column) -> list[Column]:
    return [F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn")]


def token_metrics(rows: DataFrame, gold: str = "gold", pred: str = "pred", tags: tuple[str, ...] = TAGS) -> DataFrame:
    """One row per tag, from one pass over the tokens: label, tp, fp, fn, support, precision, recall, f1."""
    each = rows.select(gold, pred, F.explode(F.array(*map(F.lit, tags))).alias("label"))
    sums = each.groupBy("label").agg(*_counts(F.col(gold) == F.col("label"), F.col(pred) == F.col("label")))
    return sums.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def abuse_metrics(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """B and I pooled."""
    sums = rows.agg(*_counts(F.col(gold) != "O", F.col(pred) != "O"))
    return sums.select("tp", "fp", "fn", "tn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def overall_metrics(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """accuracy, macro_f1, and abuse_macro_f1 over the abuse tags that occur."""
    by = token_metrics(rows, gold, pred)
    macro = by.agg(F.avg("f1").alias("macro_f1"), F.coalesce(F.avg(F.when((F.col("label") != "O") & (F.col("support") > 0), F.col("f1"))), F.lit(0.0)).alias("abuse_macro_f1"))
    right = rows.agg(F.coalesce(F.try_divide(F.count_if(F.col(gold) == F.col(pred)), F.count("*")), F.lit(0.0)).alias("accuracy"))
    return right.crossJoin(macro)


def sentence_metrics(rows: DataFrame, key: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """A sentence is unsafe if any token is: confusion counts and PRF."""
    by = rows.groupBy(key).agg(F.bool_or(F.col(gold) != "O").alias("g"), F.bool_or(F.col(pred) != "O").alias("p"))
    sums = by.agg(*_counts(F.col("g"), F.col("p")))
    return sums.select("tp", "fp", "fn", "tn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def verdict_metrics(rows: DataFrame, gold: Column, pred: Column) -> DataFrame:
    sums = rows.agg(*_counts(gold, pred))
    return sums.select("tp", "fp", "fn", "tn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Each value with its count and percentage."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = fresh(counts, "total")
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias(total)))).withColumn("pct", F.col("n") * 100.0 / F.col(total)).drop(total)


def class_weights(counts: DataFrame, tags: tuple[str, ...] = TAGS, most: float = 20.0) -> DataFrame:
    """(tag, weight): inverse frequency over its mean, clamped; a tag that is absent has weight 1."""
    present = counts.where("n > 0")
    w = Window.partitionBy()
    raw = present.withColumn("w", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))
    scaled = raw.select("tag", (F.col("w") / F.avg("w").over(w)).alias("w"))
    all_ = counts.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    return all_.join(F.broadcast(scaled), "tag", "left").select("tag", F.least(F.coalesce("w", F.lit(1.0)), F.lit(most)).alias("weight"))


def _place(rows: DataFrame, first: list[str]) -> Column:
    """Columns in their order as one value: a decimal of whole numbers if they fit, nulls first.

    The least decimal of a group is found by hashing; for the least struct Spark sorts all rows, and spills them.
    """
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
    kinds = [dict(rows.dtypes)[c] for c in first]
    if not all(k in bits for k in kinds) or sum(bits[k] for k in kinds) > 96:
        return F.struct(*first)
    out = None
    for c, kind in zip(first, kinds, strict=True):  # digits: 0 for null, then the number counted from the least of its type
        whole = F.coalesce(F.col(c).cast("decimal(20,0)") + F.lit(Decimal(2 ** (bits[kind] - 1) + 1)), F.lit(Decimal(0))).cast("decimal(20,0)")
        out = whole if out is None else (out * F.lit(Decimal(2 ** bits[kind] + 1)) + whole).cast("decimal(38,0)")
    return out


def vocabulary_ids(tokens: DataFrame, token: str, first: list[str], least: int = 1, most: int | None = None, offset: int = 2) -> DataFrame:
    """(token, n, id): by falling count, then by first place; ids start after the special ones."""
    place = F.min(_place(tokens, first)).alias("first")
    counts = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n"), place).where(F.col("n") >= least)
    order = [F.desc("n"), F.col("first")]
    if most is not None:
        counts = counts.orderBy(*order).limit(most)
    return ranked(counts, order, "id").select("token", "n", (F.col("id") + offset - 1).alias("id"))


def error_rows(rows: DataFrame, limit: int = 20) -> DataFrame:
    """False positives, those of profane or sexual context first."""
    ranked = rows.where("gold = 'O' AND pred != 'O'").withColumn("context_rank", F.col("category").isin("profanity", "sexual").cast("int"))
    return ranked.orderBy(F.desc("context_rank"), F.desc("kind"), "token", "doc_id", "pos").limit(limit)


def missed_rows(rows: DataFrame, order: list[str], variants_only: bool = True, limit: int = 20) -> DataFrame:
    """False negatives in the order of the text, by default only those that are spelling variants of the lexicon."""
    missed = rows.where("gold != 'O' AND pred = 'O'")
    return (missed.where("kind = 'variant'") if variants_only else missed).orderBy(*order).limit(limit)


def error_counts(rows: DataFrame) -> DataFrame:
    """One row: false negatives, those of spelling variants, and false positives."""
    fn, fp = (F.col("gold") != "O") & (F.col("pred") == "O"), (F.col("gold") == "O") & (F.col("pred") != "O")
    return rows.agg(F.count_if(fn).alias("fn"), F.count_if(fn & (F.col("kind") == "variant")).alias("variant_fn"), F.count_if(fp).alias("fp"))


def top_error_tokens(rows: DataFrame, error: str, limit: int = 20) -> DataFrame:
    """(token, n) of the commonest tokens of an error: fn (variants only) or fp."""
    where = "gold != 'O' AND pred = 'O' AND kind = 'variant'" if error == "fn" else "gold = 'O' AND pred != 'O'"
    counts = rows.where(where).groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(limit)


def deltas(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """What a model adds to a baseline: precision, recall and f1 of two one-row results, less one another."""
    names = ("precision", "recall", "f1")
    one = lambda d, k: d.limit(1).select(F.lit(0).alias("one"), *[F.col(c).alias(f"{k}_{c}") for c in names])
    both = one(model, "model").join(F.broadcast(one(baseline, "baseline")), "one")
    return both.select(*[(F.col(f"model_{c}") - F.col(f"baseline_{c}")).alias(f"{c}_delta") for c in names])


def verdict_totals(rows: DataFrame) -> DataFrame:
    """One row: how many verdicts are safe and how many unsafe."""
    return rows.agg(F.count_if("safe").alias("n_safe"), F.count_if(~F.col("safe")).alias("n_unsafe"))


def with_best_so_far(log: DataFrame, order: str, metric: str, run: str | None = None) -> DataFrame:
    """An epoch log with the best value so far and how many epochs it has been stale: what early stopping reads.

    A log is read run by run, in the order of its epochs; a long run is dealt over parts of the order.
    """
    before, at, last = (fresh(log, c) for c in ("before", "at", "last"))
    made = Ordered(log, [run] if run else [], [order]).with_before(before, F.col(metric)).with_before(at, F.lit(1), "sum")
    improved = F.when(F.col(before).isNull() | (F.col(metric) > F.col(before)), F.col(at))
    made = made.with_before(last, improved)
    best = F.greatest(F.coalesce(before, metric), F.col(metric))
    stale = (F.col(at) - F.coalesce(improved, last)).cast("int")
    return made.result().withColumns({"best": best, "stale": stale}).drop(before, at, last)


def report(model: DataFrame, baseline: DataFrame, key: str, title: str = "Gold test evaluation") -> str:
    """A Markdown report of two systems' tags over the same tokens (gold, pred, kind, category and the key of the sentence).

    Aggregates alone come to the driver: classes, pooled and by sentence, what the model adds, and its commonest errors.
    """
    pct = lambda x: f"{100 * x:.2f}%"
    lines = [f"# {title}", ""]
    abuse, sentences = {}, {}
    for name, rows in (("Model", model), ("Lexicon baseline", baseline)):
        abuse[name], sentences[name] = abuse_metrics(rows).first(), sentence_metrics(rows, key).first()
        lines += [f"## {name}", "", "| class | precision | recall | f1 | support |", "|---|---:|---:|---:|---:|"]
        of = {r.label: r for r in token_metrics(rows).collect()}
        lines += [f"| {t} | {pct(of[t].precision)} | {pct(of[t].recall)} | {pct(of[t].f1)} | {of[t].support} |" for t in TAGS]
        a, s = abuse[name], sentences[name]
        lines += [f"| abuse, pooled | {pct(a.precision)} | {pct(a.recall)} | {pct(a.f1)} | {a.tp + a.fn} |", ""]
        lines += [f"Unsafe sentences: precision {pct(s.precision)}, recall {pct(s.recall)}, f1 {pct(s.f1)}, {s.tp + s.fn} unsafe, {s.fp + s.tn} safe.", ""]
    for what, by in (("Pooled abuse f1", abuse), ("Unsafe sentence f1", sentences)):
        lines.append(f"- {what}: {pct(by['Model'].f1 - by['Lexicon baseline'].f1)} more ({pct(by['Model'].f1)} against {pct(by['Lexicon baseline'].f1)})")
    e = error_counts(model).first()
    lines += ["", "## Errors of the model", "", f"- {e.fn} false negatives, {e.variant_fn} of them spelling variants; {e.fp} false positives.", ""]
    for head, error in (("Missed spelling variants", "fn"), ("False positives", "fp")):
        found = top_error_tokens(model, error).collect()
        lines += [f"### {head}", "", ", ".join(f"`{r.token}`: {r.n}" for r in found) or "None.", ""]
    return "\n".join(lines)
