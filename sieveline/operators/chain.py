"""Training of the tag chain: a linear-chain CRF over hashed features, by L-BFGS on gradients that Spark sums.

A token's emission is the sum of the weights of its features (its word and its neighbours', beginnings, ends and shape), each hashed
into one of SIZE buckets, so that the model has SIZE x tags weights and a few scores of the chain, however large the corpus is.  Each
evaluation is one job: a task runs forward-backward over its sentences and gives its partial sums, which are added by a group-by on
the parameter's number; sentences stay where they are, and the driver gets the model and nothing else.  Before the first evaluation
the sentences are packed once: in blocks of TOKENS tokens, by falling length and step by step, so that a step of the chain is a
stretch of an array, with what tokens share of their features held once for each distinct word of a block.  Class weights are added
to the emissions as logs in training only.  Training stops when the held-out F1 of the abuse tags has not risen for ``patience`` looks
at it, and gives the best chain seen.

Sentences without a token, or whose tags are not as many as the tokens, teach nothing and get no tags; unknown tags count as the
first one; sentences of any length take time in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.evaluate import TAGS, overall_metrics
from sieveline.scratch import cut

#: Buckets of hashed features, and features of a token.
SIZE, FEATURES = 1 << 14, 9
#: The features that come from the neighbours' words; the others come from the token's own.
BESIDE = (1, 2)
#: Tokens that a task runs together; a longer sentence is run alone.
TOKENS = 1 << 18
#: Such blocks that a file holds, of about five megabytes each.
BLOCKS = 8


@dataclass
class Chain:
    """Weights [SIZE, tags] and the scores of a chain's start, moves [from, to] and end."""

    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    end: np.ndarray
    tags: tuple[str, ...] = TAGS
    #: (round, loss, f1) of training; f1 is null where it was not looked at.
    log: list[tuple[int, float, float | None]] = field(default_factory=list)

    @classmethod
    def empty(cls, size: int = SIZE, tags: tuple[str, ...] = TAGS) -> Chain:
        k = len(tags)
        return cls(np.zeros((size, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k), tags)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.weights, self.start, self.moves, self.end)])

    def with_flat(self, x: np.ndarray) -> Chain:
        k, size = len(self.tags), len(self.weights)
        w, start, moves, end = np.split(x, np.cumsum([size * k, k, k * k]))
        return Chain(w.reshape(size, k), start, moves.reshape(k, k), end, self.tags, self.log)


def encoded(sequences: DataFrame, key: str = "sent_id", size: int = SIZE, tags: tuple[str, ...] = TAGS, tokens: str = "tokens", gold: str = "tags") -> DataFrame:
    """(key, features, tags) of sentences: FEATURES buckets a token, one after another, and the tags' numbers."""
    t = F.transform(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    before = F.concat(F.array(F.lit("<s>")), t)
    after = F.concat(F.slice(t, F.lit(2), F.size(t)), F.array(F.lit("</s>")))
    near = F.zip_with(F.zip_with(before, t, lambda a, b: F.struct(a.alias("before"), b.alias("own"))), after, lambda x, c: F.struct(x["before"].alias("before"), x["own"].alias("own"), c.alias("after")))

    def buckets(x: Column) -> Column:
        own = F.lower(x["own"])
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["own"], r"\p{Lu}+", "A"), r"[\p{L}&&[^A]]+", "a"), r"\p{N}+", "0")
        parts = [own, F.lower(x["before"]), F.lower(x["after"]), F.left(own, F.lit(3)), F.left(own, F.lit(4)), F.right(own, F.lit(2)), F.right(own, F.lit(3)), shape, F.lit("")]
        return F.array(*[F.pmod(F.xxhash64(F.lit(k), p), F.lit(size)).cast("int") for k, p in enumerate(parts)])

    numbers = F.create_map(*[x for k, tag in enumerate(tags) for x in (F.lit(tag), F.lit(k))])
    named = F.transform(F.col(gold), lambda g: F.coalesce(F.try_element_at(numbers, F.coalesce(g, F.lit(""))), F.lit(0))) if gold in sequences.columns else F.lit(None).cast("array<int>")
    whole = F.slice(near, F.lit(1), F.size(t))  # zip_with fills up the shorter list
    return sequences.select(key, F.flatten(F.transform(whole, buckets)).alias("features"), named.alias("tags"))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def expectations(em: np.ndarray, sizes: np.ndarray, gold: np.ndarray, start: np.ndarray, moves: np.ndarray, end: np.ndarray):
    """Log-likelihood of the gold tags of sentences that lie one after another, and its gradients by emissions, start, moves, end.

    Forward-backward, step by step over all sentences that are still long enough.
    """
    k = em.shape[1]
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    lasting = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]
    alpha, beta = np.empty_like(em), np.empty_like(em)
    alpha[begin] = start + em[begin]
    for t in range(1, len(lasting)):
        at = begin[: lasting[t]] + t
        alpha[at] = _logsumexp(alpha[at - 1][:, :, None] + moves, 1) + em[at]
    last = begin + length - 1
    beta[last] = end
    for t in range(len(lasting) - 1, 0, -1):
        at = begin[: lasting[t]] + t
        beta[at - 1] = _logsumexp(moves + (em[at] + beta[at])[:, None, :], 2)
    norm = np.empty(len(sizes))
    norm[order] = _logsumexp(alpha[last] + end, 1)
    each = np.repeat(norm, sizes)
    share = np.exp(alpha + beta - each[:, None])
    first = np.ones(len(em), bool)
    first[begin] = False
    to = np.flatnonzero(first)  # every token but a sentence's first, and the one before it
    pairs = np.exp(alpha[to - 1][:, :, None] + moves + (em[to] + beta[to])[:, None, :] - each[to][:, None, None]).sum(axis=0)
    is_gold = np.zeros_like(em)
    is_gold[np.arange(len(em)), gold] = 1
    counted = np.zeros((k, k))
    np.add.at(counted, (gold[to - 1], gold[to]), 1)
    score = em[np.arange(len(em)), gold].sum() + (counted * moves).sum() + start[gold[begin]].sum() + end[gold[last]].sum()
    return score - norm[order].sum(), is_gold - share, (is_gold - share)[begin].sum(axis=0), counted - pairs, (is_gold - share)[last].sum(axis=0)


def _lists(column: pa.Array, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths (in units of ``together``) of a column of lists; null is empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes // together


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Sentences by falling length, in groups of at most TOKENS tokens or of one sentence; those without a token are left out."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    ends = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, side="right")))
        yield order[at:upto]
        at = upto


def _steps(length: np.ndarray) -> np.ndarray:
    """How many of some sentences of falling length have a token at each step."""
    return np.searchsorted(-length, -np.arange(length[0]), side="left")


def _by_step(begin: np.ndarray, length: np.ndarray, lasting: np.ndarray) -> np.ndarray:
    """The places of sentences' tokens, step by step: of every sentence its first, then the second of those that have one."""
    starts = np.cumsum(lasting) - lasting
    return begin[np.arange(length.sum()) - np.repeat(starts, lasting)] + np.repeat(np.arange(len(lasting)), lasting)


#: Arrays of a block's tokens go as bytes, not as lists, which engines take apart number by number.
_BLOCK = "words binary, word binary, before binary, after binary, gold binary, sizes array<int>"


def packed(rows: DataFrame) -> DataFrame:
    """Sentences (features, tags) that have a tag for each token, as blocks: one row for about TOKENS tokens.

    A block has its sentences' lengths, falling, and its tokens step by step: the number of the word (a row of ``words``), the two
    features from beside it, and the tag.
    """
    own = [k for k in range(FEATURES) if k not in BESIDE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = _lists(batch.column(0), FEATURES)
            found, (gold, _) = found.reshape(-1, FEATURES), _lists(batch.column(1), 1)
            begins = np.cumsum(sizes) - sizes
            for some in _groups(sizes):
                length = sizes[some]
                at = _by_step(begins[some], length, _steps(length))
                words, word = np.unique(np.ascontiguousarray(found[at][:, own], np.int32).view(f"V{4 * len(own)}").ravel(), return_inverse=True)
                columns = [words.view(np.int32), word, found[at, BESIDE[0]], found[at, BESIDE[1]], gold[at]]
                made = [pa.array([np.ascontiguousarray(x, np.int32).tobytes()], pa.binary()) for x in columns]
                made.append(pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), pa.array(length.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, names=["words", "word", "before", "after", "gold", "sizes"])

    taught = rows.where(f"size(tags) > 0 AND size(features) = {FEATURES} * size(tags)").select("features", "tags")
    return taught.mapInArrow(run, _BLOCK)


def blocks_of(rows: DataFrame, name: str) -> DataFrame:
    """Sentences (features, tags) dealt evenly, packed and written once."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    return cut(packed(rows.select("features", "tags").repartition(parts)), name, BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """words, word, before, after, gold and sizes of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            made = [np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in range(5)]
            yield [made[0].reshape(-1, FEATURES - len(BESIDE)), *made[1:], batch.column(5)[k].values.to_numpy(zero_copy_only=False)]


def _emissions(chain: Chain, block: list[np.ndarray]) -> np.ndarray:
    """The emissions of a block's tokens, a row for each tag."""
    words, word, before, after, *_ = block
    em = np.empty((len(chain.tags), len(word)))
    for own, w in zip(em, np.ascontiguousarray(chain.weights.T), strict=True):
        np.take(sum(np.take(w, words[:, k]) for k in range(words.shape[1])), word, out=own)
        own += np.take(w, before)
        own += np.take(w, after)
    return em


#: Steps after which probabilities are scaled.
SCALED = 4


def scaled_expectations(em: np.ndarray, sizes: np.ndarray, gold: np.ndarray, start: np.ndarray, moves: np.ndarray, end: np.ndarray):
    """What ``expectations`` gives, of sentences of falling length whose tokens lie step by step.

    ``em`` and the gradient by it have a row for each tag.  Probabilities, scaled to a sum of 1 every few steps, stand in place of
    their logs; where they vanish, the logs are taken after all.
    """
    (k, every), n = em.shape, len(sizes)
    lasting = _steps(sizes)
    starts = np.cumsum(lasting) - lasting
    tops = em.max(axis=0)
    likely = np.exp(em - tops)
    top_start, top_moves, top_end = start.max(), moves.max(), end.max()
    first, move, final = np.exp(start - top_start), np.exp(moves - top_moves), np.exp(end - top_end)
    forth = np.ascontiguousarray(move.T)
    alpha, beta, scale = np.empty_like(em), np.empty_like(em), np.ones(every)
    pairs = np.zeros((k, k))
    spans = list(zip(starts.tolist(), lasting.tolist(), strict=True))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        now = first[:, None] * likely[:, :n]
        for t, (at, m) in enumerate(spans):
            if t:
                now = forth @ now[:, :m]
                now *= likely[:, at : at + m]
            if t % SCALED == 0:
                own = scale[at : at + m]
                now.sum(axis=0, out=own)
                now /= own
            alpha[:, at : at + m] = now
        last = starts[sizes - 1] + np.arange(n)
        ends = final @ alpha[:, last]
        beta[:, last] = final[:, None] / ends
        for t in range(len(spans) - 1, 0, -1):
            (at, m), before = spans[t], spans[t - 1][0]
            onward = beta[:, at : at + m] * likely[:, at : at + m]
            if t % SCALED == 0:
                onward /= scale[at : at + m]
            beta[:, before : before + m] = move @ onward
            pairs += alpha[:, before : before + m] @ onward.T
        total = np.log(scale).sum() + np.log(ends).sum()
        share = np.multiply(alpha, beta, out=beta)
    before = np.arange(n, every) - np.repeat(lasting[:-1], lasting[1:])  # where the token before each but the first ones lies
    if not (np.isfinite(total) and np.isfinite(share.sum()) and np.isfinite(pairs).all()):
        places = _by_step(np.cumsum(sizes) - sizes, sizes, lasting)
        apart, tags = np.empty((every, k)), np.empty_like(gold)
        apart[places], tags[places] = em.T, gold
        score, by_em, *rest = expectations(apart, sizes, tags, start, moves, end)
        return score, by_em[places].T, *rest
    total += tops.sum() + n * (top_start + top_end) + (every - n) * top_moves
    by_em = np.negative(share, out=share)
    by_em[gold, np.arange(every)] += 1
    counted = np.bincount(gold[before] * k + gold[n:], minlength=k * k).reshape(k, k)
    score = em[gold, np.arange(every)].sum() + (counted * moves).sum() + start[gold[:n]].sum() + end[gold[last]].sum()
    return score - total, by_em, by_em[:, :n].sum(axis=1), counted - pairs * move, by_em[:, last].sum(axis=1)


def _partial_rows(model, class_weights: np.ndarray):
    """Over blocks: (index, value) of a task's part of the likelihood (-1), the tokens (-2) and the gradient."""
    schema = pa.schema([("index", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = model.value
        k, sums = len(chain.tags), None
        likelihood = tokens = 0.0
        for block in _blocks(batches):
            words, word, before, after, gold, sizes = block
            own, by_em, start, moves, end = scaled_expectations(_emissions(chain, block) + np.log(class_weights)[:, None], sizes, gold, chain.start, chain.moves, chain.end)
            by_weight = np.empty((len(chain.weights), k))
            for j, by in enumerate(by_em):
                by_word = np.bincount(word, by, len(words))
                by_weight[:, j] = np.bincount(words.ravel(), np.repeat(by_word, words.shape[1]), len(chain.weights))
                by_weight[:, j] += np.bincount(before, by, len(chain.weights)) + np.bincount(after, by, len(chain.weights))
            made = np.concatenate([by_weight.ravel(), start, moves.ravel(), end])
            sums = made if sums is None else sums + made
            likelihood, tokens = likelihood + own, tokens + len(gold)
        if sums is not None:
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[likelihood, tokens], sums[some]]))], schema=schema)

    return run


def loss_and_gradient(rows: DataFrame, chain: Chain, class_weights: list[float] | None = None, decay: float = 1e-4) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood a token of ``rows`` (features and tags, or blocks of them), with ``decay`` times half the squared
    parameters, and its gradient: one job, which returns as many rows as the model has parameters."""
    weights = np.ones(len(chain.tags)) if class_weights is None else np.maximum(np.asarray(class_weights, float), 1e-6)
    model = rows.sparkSession.sparkContext.broadcast(chain)
    blocks = rows if "words" in rows.columns else packed(rows)
    parts = blocks.mapInArrow(_partial_rows(model, weights), "index long, value double").groupBy("index").agg(F.sum("value").alias("value"))
    found = parts.toArrow()
    model.destroy()
    index, value = found.column(0).to_numpy(), found.column(1).to_numpy()
    x = chain.flat()
    gradient, n = np.zeros(len(x)), max(float(value[index == -2].sum()), 1.0)
    gradient[index[index >= 0]] = -value[index >= 0] / n
    return -float(value[index == -1].sum()) / n + decay / 2 * float(x @ x), gradient + decay * x


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The L-BFGS direction from the last moves and changes of the gradient."""
    q, used = gradient.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(used), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def train(rows: DataFrame, held_out: DataFrame | None = None, chain: Chain | None = None, class_weights: list[float] | None = None, rounds: int = 30, every: int = 5, patience: int = 2, decay: float = 1e-4, memory: int = 8) -> Chain:
    """A chain that fits ``rows`` (features, tags), and its log.  ``held_out`` rows are looked at ``every`` so many rounds."""
    # each round goes over the sentences again, so they are dealt evenly and packed once
    rows = blocks_of(rows, "chain")
    held_out = blocks_of(held_out, "chain-held") if held_out is not None else None
    chain = chain or Chain.empty()
    x, steps, best = chain.flat(), [], (-1.0, chain)
    loss, gradient = loss_and_gradient(rows, chain, class_weights, decay)
    log: list[tuple[int, float, float | None]] = [(0, loss, None)]
    for number in range(1, rounds + 1):
        step, way = 1.0 if steps else min(1.0, 1.0 / max(np.linalg.norm(gradient), 1e-12)) * 5, _direction(gradient, steps)
        slope = float(way @ gradient)
        if slope > -1e-10:
            break
        while True:  # shorter steps until the loss falls as the slope says
            after = x + step * way
            new_loss, new_gradient = loss_and_gradient(rows, chain.with_flat(after), class_weights, decay)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 4
        if new_loss >= loss:
            break
        if (after - x) @ (new_gradient - gradient) > 1e-12:
            steps = [*steps, (after - x, new_gradient - gradient)][-memory:]
        x, loss, gradient = after, new_loss, new_gradient
        f1 = None
        if held_out is not None and number % every == 0:
            f1 = _abuse_f1(held_out, chain.with_flat(x))
            if f1 > best[0]:
                best = (f1, chain.with_flat(x))
        log.append((number, loss, f1))
        if f1 is not None and _stale(log) >= patience:
            break
    out = best[1] if best[0] >= 0 else chain.with_flat(x)
    out.log = log
    return out


def _stale(log: list[tuple[int, float, float | None]]) -> int:
    """For how many looks the best F1 has not risen: of a few numbers, which the driver has already."""
    seen = [f1 for *_, f1 in log if f1 is not None]
    return len(seen) - 1 - seen.index(max(seen))


def confusion(rows: DataFrame, chain: Chain) -> DataFrame:
    """(gold, pred, n): how often the chain gives a tag where another is right; of sentences (features, tags) or blocks of them."""
    model = rows.sparkSession.sparkContext.broadcast(chain)
    blocks = rows if "words" in rows.columns else packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Chain = model.value
        k, seen = len(own.tags), np.zeros(len(own.tags) ** 2, np.int64)
        for block in _blocks(batches):
            *_, gold, sizes = block
            path = best_paths(own, sizes, _emissions(own, block))
            seen += np.bincount(gold * k + path, minlength=k * k)
        names = list(own.tags)
        yield pa.RecordBatch.from_arrays([pa.array([names[x // k] for x in range(k * k)]), pa.array([names[x % k] for x in range(k * k)]), pa.array(seen)], names=["gold", "pred", "n"])

    return blocks.mapInArrow(run, "gold string, pred string, n long").groupBy("gold", "pred").agg(F.sum("n").alias("n"))


def _abuse_f1(held: DataFrame, chain: Chain) -> float:
    """The mean f1 of the abuse tags that occur, as ``evaluated`` has it, from the counts of tags alone."""
    counts = {(r.gold, r.pred): r.n for r in confusion(held, chain).collect()}
    found = []
    for tag in chain.tags:
        right, given, meant = counts.get((tag, tag), 0), sum(n for (_, p), n in counts.items() if p == tag), sum(n for (g, _), n in counts.items() if g == tag)
        if tag != "O" and meant:
            found.append(2 * right / (given + meant))
    return float(np.mean(found)) if found else 0.0


def best_paths(chain: Chain, sizes: np.ndarray, em: np.ndarray) -> np.ndarray:
    """The tags of the best path of sentences of falling length whose tokens lie step by step, as ``crf.decoded`` has them."""
    lasting = _steps(sizes)
    spans = list(zip((np.cumsum(lasting) - lasting).tolist(), lasting.tolist(), strict=True))
    (k, every), n = em.shape, len(sizes)
    back, path, tag = np.empty(em.shape, np.int8), np.empty(every, np.int64), np.empty(n, np.int64)
    now = chain.start[:, None] + em[:, :n]
    ending = lambda x: (x + chain.end[:, None]).argmax(axis=0)
    moves = chain.moves[:, :, None]
    for at, m in spans[1:]:
        if m < now.shape[1]:  # those that end here
            tag[m : now.shape[1]] = ending(now[:, m:])
        per = now[:, None, :m] + moves
        back[:, at : at + m] = per.argmax(axis=0)
        now = per.max(axis=0)
        now += em[:, at : at + m]
    tag[: now.shape[1]] = ending(now)
    rows = np.arange(n)
    for t in range(len(spans) - 1, -1, -1):
        at, m = spans[t]
        path[at : at + m] = tag[:m]
        if t:
            tag[:m] = back[tag[:m], at + rows[:m]]
    return path


def tagged(rows: DataFrame, chain: Chain, key: str | None = None) -> DataFrame:
    """``rows`` (features and other columns) with ``found``, the numbers of the best path's tags."""
    rest = [c for c in rows.columns if c != "features"]
    model = rows.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Chain = model.value
        for batch in batches:
            found, sizes = _lists(batch.column(batch.schema.get_field_index("features")), FEATURES)
            found, begins, path = found.reshape(-1, FEATURES), np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.int32)
            for some in _groups(sizes):
                at = _by_step(begins[some], sizes[some], _steps(sizes[some]))
                path[at] = best_paths(own, sizes[some], sum(np.take(own.weights.T, found[at, k], axis=1) for k in range(FEATURES)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(path, pa.int32()))], names=[*rest, "found"])

    kinds = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c != "features")
    return rows.mapInArrow(run, f"{kinds}found array<int>")


def token_rows(rows: DataFrame, chain: Chain) -> DataFrame:
    """(gold, pred): the names of the given and the found tag of every token."""
    name = lambda c: F.get(F.array(*map(F.lit, chain.tags)), F.col(c))
    both = tagged(rows.select("features", "tags"), chain).where("size(tags) = size(found)")
    return both.select(F.explode(F.arrays_zip("tags", "found")).alias("x")).select(name("x.tags").alias("gold"), name("x.found").alias("pred"))


def evaluated(rows: DataFrame, chain: Chain) -> DataFrame:
    """accuracy, macro_f1 and abuse_macro_f1 of the chain's tags."""
    return overall_metrics(token_rows(rows, chain))
