import datetime as dt
import json

from pyspark.sql import functions as F

from sieveline.plans import api
from sieveline.sources import lexicon
from sieveline.streaming import scan, state

SCHEMA = "k string, ts timestamp"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def written(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_counters_survive_a_restart_and_leave_late_rows_out(spark, tmp_path):
    folder = f"{tmp_path}/in"
    run = lambda: state.updates(state.running_counts(scan.read_stream(spark, folder, SCHEMA, files=1), "k", late="1 hour"), f"{tmp_path}/state", f"{tmp_path}/out")
    written(spark, folder, [("a", at(1)), ("a", at(2)), ("b", at(2)), (None, at(2))])
    first = {r.k: r.n for r in state.last_counts(run(), "k").collect()}
    assert first == {"a": 2, "b": 1, None: 1}
    written(spark, folder, [("a", at(8)), ("c", at(8))])
    assert {r.k: r.n for r in state.last_counts(run(), "k").collect()} == {"a": 3, "b": 1, None: 1, "c": 1}
    written(spark, folder, [("a", at(3)), ("b", at(9))])  # the first is later than the watermark, 7:00
    assert {r.k: r.n for r in state.last_counts(run(), "k").collect()} == {"a": 3, "b": 2, None: 1, "c": 1}


def test_counters_expire(spark, tmp_path):
    folder = f"{tmp_path}/in"
    run = lambda: state.updates(state.running_counts(scan.read_stream(spark, folder, SCHEMA, files=1), "k", late="1 minute", expire_s=3600), f"{tmp_path}/state", f"{tmp_path}/out")
    written(spark, folder, [("a", at(1)), ("b", at(1)), ("b", at(2, 30))])
    run()
    written(spark, folder, [("c", at(3))])
    found = run()
    assert {r.k: r.n for r in state.last_counts(found, "k").collect()} == {"b": 2, "c": 1}
    assert [(r.k, r.n) for r in found.where("expired").collect()] == [("a", 1)]
    written(spark, folder, [("a", at(3, 10))])
    assert {r.k: r.n for r in state.last_counts(run(), "k").collect()} == {"a": 1, "b": 2, "c": 1}


def test_each_key_is_seen_once(spark, tmp_path):
    folder = f"{tmp_path}/in"
    run = lambda: state.updates(state.first_seen(scan.read_stream(spark, folder, SCHEMA, files=1), "k"), f"{tmp_path}/state", f"{tmp_path}/out")
    written(spark, folder, [("a", at(2)), ("a", at(1)), ("b", at(3))])
    run()
    written(spark, folder, [("a", at(4)), ("c", at(4))])
    ms = lambda h: int(at(h).replace(tzinfo=dt.UTC).timestamp() * 1000)
    assert sorted((r.k, r.first_ms) for r in run().collect()) == [("a", ms(1)), ("b", ms(3)), ("c", ms(4))]


def test_settings_change_while_a_query_runs(spark, tmp_path):
    folder, settings = f"{tmp_path}/in", f"{tmp_path}/settings"
    for k in range(3):
        written(spark, folder, [("a", at(k)), ("b", at(k))])
    schema = "k string, enabled boolean, version int"
    written(spark, settings, [("a", True, 1)], schema)

    def after(number):
        if number == 0:
            written(spark, settings, [("a", False, 2), ("b", True, 2)], schema)

    found = scan.with_live_config(scan.read_stream(spark, folder, SCHEMA, files=1), lambda: spark.read.schema(schema).parquet(settings), "k", after)
    assert sorted((r.k, r.ts.hour > 0, r.enabled) for r in found.collect() if r.enabled is not None) == [("a", False, True), ("a", True, False), ("a", True, False), ("b", True, True), ("b", True, True)]
    assert found.where("enabled IS NULL").count() == 1


def test_lines_are_moderated_in_every_sensitivity(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("you idiot\n\n1d1ot here\nfine day\n")
    entries = lexicon.from_rows(spark)
    words = {}
    for sensitivity in ("standard", "strict", "maximum"):
        found = scan.moderated(scan.read_lines_stream(spark, f"{tmp_path}/in"), entries, "doc_id", "value", sensitivity)
        words[sensitivity] = {r.value: (r.safe, list(r.flagged_words)) for r in found.collect()}
    assert words["standard"] == {"you idiot": (False, ["idiot"]), "1d1ot here": (True, []), "fine day": (True, [])}
    assert words["strict"]["1d1ot here"] == words["maximum"]["1d1ot here"] == (False, ["idiot"])


def test_any_number_of_kinds_of_requests(spark):
    """Masks are free text: each of 1,500 requests has its own, and all of them get their answer in one plan."""
    rows = [(i, "/censor", json.dumps({"text": "you idiot", "mode": "partial", "mask_char": f"<{i}>"})) for i in range(1500)]
    rows += [(2000, "/censor", json.dumps({"text": "trashy idiot", "mode": "tag", "severity_threshold": "high"})), (2001, "/censor", json.dumps({"text": "pathetic idiot", "allowed_categories": ["threat"], "mode": "block"}))]
    rows += [(2002, "/predict", json.dumps({"text": "1d1ot", "sensitivity": "strict"})), (2003, "/predict_batch", json.dumps({"texts": ["idiot", "", "fine"]})), (2004, "/censor", "{}"), (2005, "/censor", json.dumps({"text": "idiot", "mode": "none such"}))]
    found = {r.id: (r.status, json.loads(r.response)) for r in api.respond(spark.createDataFrame(rows, "id long, path string, body string"), lexicon.from_rows(spark)).collect()}
    assert len(found) == len(rows)
    for i in range(1500):
        assert found[i] == (200, found[i][1]) and found[i][1]["censored"] == f"you i<{i}><{i}><{i}>t"
    assert found[2000][1]["censored"] == "trashy [REDACTED: PROFANITY]" and found[2001][1]["censored"] == "pathetic idiot"
    assert found[2002][1]["flagged_words"] == ["idiot"] and [x["safe"] for x in found[2003][1]["results"]] == [False, True, True]
    assert found[2004][0] == 400 and found[2005][1]["censored"] == "i***t"


def test_highlights_after_capitals_with_a_dot(spark):
    from sieveline.operators import spans

    df = spark.createDataFrame([(1, "İİ bad word")], "k int, text string")
    assert [(r.start, r.end) for r in spans.match_intervals(df, "k", "text", ["bad"]).collect()] == [(3, 6)]


def test_columns_of_a_caller_are_left_alone(spark):
    from sieveline.operators import corpus, sequences

    df = spark.createDataFrame([("a", 1, "own"), ("a", 2, "other")], "t string, n int, __key string")
    assert [tuple(r) for r in corpus.keep_first(df, F.col("t"), [F.col("n")]).collect()] == [("a", 1, "own")]
    tokens = spark.createDataFrame([("a", "x", 5)], "token string, word string, known_id int")
    ids = spark.createDataFrame([("a", 7)], "token string, id int")
    assert sequences.token_ids(tokens, "token", ids).first().asDict() == {"token": "a", "word": "x", "known_id": 5, "id": 7}


def test_a_table_in_a_folder_of_files_streams_whole(spark, tmp_path):
    """Large tables are folders named like the files of small ones."""
    events = spark.range(0, 40, 1, 4).selectExpr("id AS event_id", "concat('k', id % 3) AS event_type", "timestamp_ntz '2024-01-01 00:00:00' AS ts")
    events.write.parquet(f"{tmp_path}/a/events.parquet")
    rows = events.toPandas()
    (tmp_path / "b").mkdir()
    rows.to_parquet(tmp_path / "b" / "events.parquet", coerce_timestamps="us")
    for folder in ("a", "b"):
        got = scan.finished(scan.running_counts(scan.events_stream(spark, f"{tmp_path}/{folder}"), "event_type"), "complete")
        assert sorted(map(tuple, got.collect())) == [("k0", 14), ("k1", 13), ("k2", 13)]
