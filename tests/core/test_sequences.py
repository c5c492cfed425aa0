import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sieveline.operators import corpus, crf, evaluate, heuristic, neighbours, network, sequences, variants
from sieveline.plans import api
from sieveline.sources import lexicon
from sieveline.streaming import scan


def test_sequences_are_validated(spark):
    rows = spark.createDataFrame([(2, 1, " B ", "O"), (2, 0, "A", "B-ABUSE"), (1, 0, None, "O")], "sent_id int, pos int, token string, final_tag string")
    got = {r.sent_id: (r.tokens, r.tags) for r in sequences.bio_sequences(rows, "pos").collect()}
    assert got == {"2": (["a", "b"], ["B-ABUSE", "O"]), "1": ([""], ["O"])}
    with pytest.raises(ValueError):
        sequences.bio_sequences(rows.drop("final_tag"), "pos")
    with pytest.raises(ValueError):
        sequences.bio_sequences(rows.drop("token"), "pos")
    with pytest.raises(PySparkException, match="unknown tag"):
        sequences.bio_sequences(rows.withColumn("final_tag", F.lit("X")), "pos").collect()
    df = spark.createDataFrame([(["a"], ["b", "c"])], "x array<string>, y array<string>")
    with pytest.raises(PySparkException, match="different length"):
        df.select(sequences.zipped(F.col("x"), F.col("y"))).collect()


def test_batches_and_ids(spark):
    df = spark.createDataFrame([(i, list(range(i % 4))) for i in range(7)], "k int, ids array<int>")
    got = {r.batch: r.rows for r in sequences.mini_batches(df, "ids", ["k"], 3).collect()}
    assert sorted(got) == [0, 1, 2] and [x.length for x in got[0]] == [0, 1, 2] and [list(x.ids) for x in got[0]] == [[0, 0], [0, 0], [0, 1]]
    assert [list(x["mask"]) for x in got[0]] == [[False, False], [True, False], [True, True]] and len(got[2]) == 1
    out = sequences.renamed(df, {"ids": "numbers"}, ["numbers"], {"source": F.lit("x")})
    assert out.columns == ["numbers", "k", "source"]
    assert [r.pos for r in sequences.in_order(sequences.positions(df.withColumn("g", F.col("k") % 2), "g", ["k"]), "k").collect()] == [0, 0, 1, 1, 2, 2, 3]


def test_ranks_over_parts(spark):
    rng = random.Random(3)
    values = [rng.randrange(1000) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    got = {r.i: r["rank"] for r in evaluate.ranked(df, [F.desc("v"), F.col("i")]).collect()}
    want = sorted(range(500), key=lambda i: (-values[i], i))
    assert [got[i] for i in want] == list(range(1, 501))


def test_pool_status_and_checks(spark):
    rows = spark.createDataFrame([(3, "Good words"), (1, "good  WORDS"), (2, "!!"), (4, None), (5, "good words")], "k int, text string")
    status = corpus.pool_status(rows, "text", [F.col("k")])
    assert {r.k: r.status for r in status.collect()} == {1: "kept", 3: "duplicate", 5: "duplicate", 2: "untrainable", 4: "empty"}
    assert corpus.pool_statistics(status).first().asDict() == {"raw": 5, "empty": 1, "duplicate": 2, "untrainable": 1, "kept": 1, "tokens": 2}
    report = spark.createDataFrame([(1, 2)], "a int, b int")
    assert corpus.checked(report, F.col("a") < F.col("b")).count() == 1
    with pytest.raises(PySparkException, match="a check failed"):
        corpus.checked(report, F.col("a") > F.col("b")).collect()
    made = corpus.constant_rows(rows.where("k = 2"), "text", label="safe", n=1).first()
    assert made.asDict() == {"text": "!!", "label": "safe", "n": 1}


def test_stratified_draws_against_full_orders(spark):
    import hashlib

    rows = [(i, "abc"[i % 7 % 3]) for i in range(900)] + [(900 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, s string")
    got = {r.k: r.split for r in corpus.stratified_split(df, "s", "k").collect()}
    order = lambda k: (hashlib.md5(f"{corpus.SEED}:{k}".encode()).hexdigest(), k)
    for s in ("a", "b", "c", None):
        mine = sorted((k for k, x in rows if x == s), key=order)
        assert [got[k] for k in mine] == ["dev" if 2 * (i + 1) <= len(mine) else "test" for i in range(len(mine))]


def test_report_and_log(spark):
    rows = spark.createDataFrame([(1, 0, "bad", "B-ABUSE", "O", "variant", "x"), (1, 1, "ok", "O", "B-ABUSE", "", ""), (2, 0, "bad", "B-ABUSE", "B-ABUSE", "canonical", "x")], "doc_id int, pos int, token string, gold string, pred string, kind string, category string")
    text = evaluate.report(rows, rows.withColumn("pred", F.lit("O")), "doc_id")
    assert "| B-ABUSE | 50.00% | 50.00% | 50.00% | 2 |" in text and "50.00% more (50.00% against 0.00%)" in text and "`bad`: 1" in text and "1 false negatives, 1 of them spelling variants; 1 false positives" in text
    log = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.6), (4, 0.6), (5, 0.1)], "epoch int, f1 double")
    assert [(r.best, r.stale) for r in evaluate.with_best_so_far(log, "epoch", "f1").orderBy("epoch").collect()] == [(0.5, 0), (0.5, 1), (0.6, 0), (0.6, 1), (0.6, 2)]
    seeds = spark.createDataFrame([("a",), ("b",)], "canon string")
    assert sorted((r.canon, r.part) for r in variants.merged_seeds(seeds, spark.createDataFrame([("b",)], "canon string")).collect()) == [("a", 0), ("b", 1)]


def weights(rng, words=9, chars=7, c=4, hidden=5, tags=3):
    made = {"word": rng.normal(size=(words, 6)), "char": rng.normal(size=(chars, c))}
    for k in (3, 4, 5):
        made |= {f"conv{k}.w": rng.normal(size=(2, c, k)), f"conv{k}.b": rng.normal(size=2)}
    size = 12
    for layer in (0, 1):
        for way in ("fw", "bw"):
            made |= {f"lstm{layer}.{way}.wx": rng.normal(size=(4 * hidden, size)), f"lstm{layer}.{way}.wh": rng.normal(size=(4 * hidden, hidden)), f"lstm{layer}.{way}.b": rng.normal(size=4 * hidden)}
        size = 2 * hidden
    return made | {"emission.w": rng.normal(size=(tags, size)), "emission.b": rng.normal(size=tags), "crf.start": rng.normal(size=tags), "crf.transitions": rng.normal(size=(tags, tags)), "crf.end": rng.normal(size=tags)}


def slow_emissions(w, words, chars):
    """One sentence, one number at a time."""
    xs = []
    for word, letters in zip(words, chars):
        out = list(w["word"][word])
        for k in (3, 4, 5):
            pad = [np.zeros(w["char"].shape[1])] * (k // 2)
            line = [*pad, *(w["char"][i] for i in letters), *pad]
            for o in range(len(w[f"conv{k}.b"])):
                responses = [sum(line[s + j] @ w[f"conv{k}.w"][o, :, j] for j in range(k)) + w[f"conv{k}.b"][o] for s in range(len(line) - k + 1)]
                out.append(max(max(r, 0.0) for r in responses))
        xs.append(np.array(out))
    sig = lambda v: 1 / (1 + math.exp(-v))
    for layer in (0, 1):
        ways = []
        for way, order in (("fw", range(len(xs))), ("bw", range(len(xs) - 1, -1, -1))):
            wx, wh, b = (w[f"lstm{layer}.{way}.{k}"] for k in ("wx", "wh", "b"))
            size = wh.shape[1]
            h, c, found = np.zeros(size), np.zeros(size), {}
            for t in order:
                g = wx @ xs[t] + wh @ h + b
                c = np.array([sig(g[size + j]) * c[j] + sig(g[j]) * math.tanh(g[2 * size + j]) for j in range(size)])
                h = np.array([sig(g[3 * size + j]) * math.tanh(c[j]) for j in range(size)])
                found[t] = h
            ways.append(found)
        xs = [np.concatenate([ways[0][t], ways[1][t]]) for t in range(len(xs))]
    return np.array([w["emission.w"] @ x + w["emission.b"] for x in xs])


def test_network_against_slow_sums(spark, tmp_path):
    w = weights(np.random.default_rng(1))
    network.save_weights(w, spark, f"{tmp_path}/model")
    w = network.load_weights(spark, f"{tmp_path}/model")
    words, chars = {"aa": 2, "b": 3, "cab": 4}, {"a": 2, "b": 3, "c": 4}
    sentences = [["aa", "b", "zzzzzz"], [], ["cab"], ["b"] * 7, ["aa", "cab"]]
    flat = [t for s in sentences for t in s]
    together = network.emissions(w, np.array([words.get(t, 1) for t in flat]), network.char_matrix(flat, chars), np.array([len(s) for s in sentences]))
    width = network.char_matrix(flat, chars).shape[1]
    at = 0
    for s in sentences:
        if s:
            letters = [[chars.get(c, 1) for c in t] + [0] * (width - len(t)) for t in s]
            assert np.allclose(together[at : at + len(s)], slow_emissions(w, [words.get(t, 1) for t in s], letters))
        at += len(s)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "doc_id long, tokens array<string>")
    got = {r.doc_id: r.tags for r in network.tag_sentences(df, w, words, chars).collect()}
    path = crf.decoded(w["crf.start"], w["crf.transitions"], w["crf.end"], np.array([len(s) for s in sentences]), together)
    assert [evaluate.TAGS[k] for k in path] == [t for i in range(5) for t in got[i]]
    assert np.allclose(network.class_weighted(np.zeros((1, 3)), [1.0, math.e, 0.0]), [[0, 1, math.log(1e-6)]])
    vectors = spark.createDataFrame([("aa", [1.0, 2.0]), ("other", [3.0, 4.0])], "word string, vector array<double>")
    matrix = network.embedding_matrix({"aa": 2, "b": 3}, vectors, 2)
    assert matrix[0].tolist() == [0, 0] and matrix[2].tolist() == [1, 2] and 0 < abs(matrix[3]).max() < 1


def test_a_trained_tagger_finds_held_out_words(spark):
    rng = random.Random(2)
    rows = []
    for i in range(160):
        tokens = [rng.choice(["well", "then", "here", "now", "fine"]) for _ in range(6)]
        tags = ["O"] * 6
        if i % 2:
            at = rng.randrange(5)
            tokens[at : at + 2], tags[at : at + 2] = ["go", "die"], ["B-ABUSE", "I-ABUSE"]
        rows.append((str(i), tokens, tags))
    df = spark.createDataFrame(rows, "sent_id string, tokens array<string>, tags array<string>")
    train, test = df.where("cast(sent_id as int) < 120"), df.where("cast(sent_id as int) >= 120")
    chain = network.transition_counts(train)
    assert chain["crf.transitions"][0, 2] < chain["crf.transitions"][1, 2] and abs(np.exp(chain["crf.transitions"]).sum(1) + np.exp(chain["crf.end"]) - 1).max() < 1e-9
    model = network.fit_emissions(train, weights={"B-ABUSE": 2.0})
    found = crf.paths(network.logistic_emissions(model, test), *(chain[f"crf.{k}"].tolist() for k in ("start", "transitions", "end")))
    want = {r.sent_id: [evaluate.TAGS.index(t) for t in r.tags] for r in test.collect()}
    assert {r.doc_id: list(r.path) for r in found.collect()} == want
    vectors = neighbours.train_embeddings(df, size=8, rounds=1)
    assert vectors.getVectors().count() == 7


def test_responses_of_a_service(spark):
    bodies = [
        ("/predict", '{"text": "you idiot"}'), ("/predict?full=1", '{"nothing": 1}'), ("/predict", "no json"), ("/predict_batch", '{"texts": ["fine", "", null, "scum here"]}'),
        ("/predict_batch", '{"texts": "one"}'), ("/predict_batch", "{}"), ("/censor", '{"text": "you idiot", "mode": "tag"}'), ("/censor", '{"text": "a loser and idiot", "allowed_categories": ["threat"]}'),
        ("/health", None), ("/other", "{}"), ("/predict", '{"text": "id1ot", "sensitivity": "STRICT"}'), ("/predict_batch", '{"texts": []}'),
    ]
    df = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(bodies)], "id int, path string, body string")
    got = {r.id: (r.status, json.loads(r.response)) for r in api.respond(df, lexicon.from_rows(spark)).collect()}
    assert [got[i][0] for i in range(12)] == [200, 400, 400, 200, 400, 400, 200, 200, 200, 404, 200, 200]
    assert got[0][1]["safe"] is False and got[0][1]["flagged_words"] == ["idiot"] and "'text'" in got[1][1]["error"] and "list of strings" in got[4][1]["error"]
    assert [r["safe"] for r in got[3][1]["results"]] == [True, True, True, False] and got[3][1]["results"][1] == {"safe": True, "flagged_words": []}
    assert got[6][1]["censored"] == "you [REDACTED: PROFANITY]" and got[7][1]["censored"] == "a l***r and idiot" and got[8][1]["status"] == "ok"
    assert got[10][1]["safe"] is False and got[11][1] == {"results": []}


def test_heuristic_modes(spark):
    df = spark.createDataFrame([(0, "You  IDIOT!"), (1, "1d1ot"), (2, "fine"), (3, None)], "k int, text string")
    assert [r.safe for r in heuristic.detect(df).orderBy("k").collect()] == [False, True, True, True]
    assert [r.safe for r in heuristic.detect(df, sensitivity="strict").orderBy("k").collect()] == [False, False, True, True]
    plain = spark.createDataFrame([(0, "you idiot and scum")], "k int, text string")
    shown = {m: heuristic.censor(heuristic.detect(plain), mode=m).first().censored for m in ("partial", "tag", "block", "polite")}
    assert shown == {"partial": "you id*ot and s**m", "tag": "you [REDACTED: PROFANITY] and [REDACTED: PROFANITY]", "block": "you █████ and ████", "polite": "you [friend] and [friend]"}


def test_stream_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = scan.read_stream(spark, f"{tmp_path}/in", "id long", files=1)
    scan.scan_batches(stream, lambda rows, number: seen.append(rows.count()))
    assert seen == [10, 10, 10]


def test_nearest_holds_few_scores_at_once():
    """A part of 2048 queries and 16,384 vectors needs no matrix of them all; ties go to the first."""
    import tracemalloc

    import pandas as pd

    from sieveline.operators import neighbours

    rng = np.random.default_rng(2)
    v = pd.DataFrame({"id": np.arange(4000), "v": list(rng.integers(-2, 3, (4000, 4)).astype(float))})
    tracemalloc.start()
    got = neighbours._block_rows(3)(v[:1000], v)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.stack(v["v"])
    norms = np.sqrt((x**2).sum(1))
    for own in (0, 63, 64, 999):
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.nan_to_num(x[own] @ x.T / (norms[own] * norms), nan=-9.0)
        s[own] = -9.0
        want = np.sort(s)[::-1][:3] if norms[own] else []
        assert np.allclose(got[got["query"] == own]["score"], want)
    assert most < 30e6


def test_documents_are_whole_sentences_without_a_shuffle(spark):
    """Sequences and reviews of documents deal out no tokens; counts and copies shuffle no join."""
    from sieveline.plans import queries

    plan = lambda q: q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for q in (queries.e12_zipped_tags, queries.a12_sequences, queries.g2_sentences):
        assert "Exchange" not in plan(q)
    assert "Join" not in plan(queries.i11_oversample)


def test_whole_sequences_check_tags_and_keep_equal_ids_apart(spark):
    from sieveline.operators import sequences

    df = spark.createDataFrame([(1, [" A", None], ["O", "B-ABUSE"]), (1, ["c"], ["O"]), (2, [], []), (3, None, None)], "k int, tokens array<string>, tags array<string>")
    got = sequences.whole_sequences(df, "k").collect()
    assert sorted((r.sent_id, r.tokens, r.tags) for r in got) == [("1", ["a", ""], ["O", "B-ABUSE"]), ("1", ["c"], ["O"])]
    with pytest.raises(Exception, match="unknown tag"):
        sequences.whole_sequences(df.withColumn("tags", F.array(F.lit("X"))), "k").collect()


def test_copies_of_sentences_by_a_flag_are_those_by_a_join(spark):
    from sieveline.operators import corpus

    rows = [(s, p, "w", "B-ABUSE" if s % 2 and p == 1 else "O", s % 2 == 1) for s in range(20) for p in range(5)]
    df = spark.createDataFrame(rows, "sent_id int, pos int, token string, tag string, bad boolean")
    key = lambda d: sorted((r.sent_id, r.copy, r.pos, r.tag) for r in d.collect())
    assert key(corpus.oversampled(df)) == key(corpus.oversampled(df, bad=F.col("bad"))) != []
