"""Outcome log and request files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidings.operators import delivery as LOG
from tidings.sources import request_files as FILES

DAY = "2024-01-31"


def rows(spark, *data):
    return spark.createDataFrame(list(data), LOG.LOG_SCHEMA)


def states(spark, path):
    return sorted(tuple(r) for r in LOG.last_states(LOG.read_log(spark, path)).select("message_id", "attempt", "state", "detail").collect())


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    LOG.append(rows(spark, ("a", "push", 0, "ready", None), ("b", "reply", 0, "error", "no story"), ("c", "push", 0, "ready", None)), path, DAY, "ready")
    return path


def answers(spark, *data):
    return spark.createDataFrame(list(data), "message_id string, http_status int, body string")


def test_ready_failed_sent_is_one_row(spark, log):
    due = LOG.due(LOG.last_states(LOG.read_log(spark, log)), 3)
    assert sorted(r["message_id"] for r in due.collect()) == ["a", "c"]
    LOG.append(LOG.attempts(due, answers(spark, ("a", 500, "busy"), ("c", None, None))), log, DAY, "1")
    assert states(spark, log) == [("a", 1, "failed", "LINE API error: busy"), ("b", 0, "error", "no story"), ("c", 1, "failed", "Network error")]
    due = LOG.due(LOG.last_states(LOG.read_log(spark, log)), 3)
    LOG.append(LOG.attempts(due, answers(spark, ("a", 204, "ignored"))), log, DAY, "2")
    assert states(spark, log)[0] == ("a", 2, "sent", None)
    assert [r["message_id"] for r in LOG.due(LOG.last_states(LOG.read_log(spark, log)), 3).collect()] == ["c"]
    assert LOG.due(LOG.last_states(LOG.read_log(spark, log)), 1).isEmpty()


def test_order_and_repeats_change_nothing(spark, log):
    LOG.append(rows(spark, ("a", "push", 2, "sent", None)), log, DAY, "2")
    LOG.append(rows(spark, ("a", "push", 1, "failed", "x")), log, DAY, "1")
    want = states(spark, log)
    LOG.append(rows(spark, ("a", "push", 1, "failed", "x")), log, DAY, "1")
    LOG.append(rows(spark, ("a", "push", 1, "failed", "x")), log, DAY, "1 again")
    assert states(spark, log) == want and want[0] == ("a", 2, "sent", None)


def test_sent_wins_within_one_attempt(spark, log):
    LOG.append(rows(spark, ("a", "push", 1, "sent", None), ("a", "push", 1, "failed", "timeout")), log, DAY, "1")
    assert states(spark, log)[0] == ("a", 1, "sent", None)


def test_compaction_keeps_the_fold_wherever_it_is_killed(spark, log, monkeypatch):
    LOG.append(rows(spark, ("a", "push", 1, "failed", "x"), ("c", "push", 1, "sent", None)), log, DAY, "1")
    LOG.append(rows(spark, ("z", "push", 0, "ready", None)), log, "2024-02-01", "ready")
    want = states(spark, log)

    def killed(*args):
        raise RuntimeError("killed")
    # killed before the folded batch is written: nothing is there
    with monkeypatch.context() as m:
        m.setattr(LOG, "append", killed)
        with pytest.raises(RuntimeError):
            LOG.compact(spark, log, DAY)
    assert states(spark, log) == want
    # killed after the folded batch, before the old ones go: both are read
    LOG.append(LOG.last_states(LOG.read_log(spark, log).where(F.col("run_date") == DAY)), log, DAY, "compacted-by-a-killed-run")
    assert states(spark, log) == want
    # a half-written batch (no commit) is not read
    os.makedirs(f"{log}/run_date={DAY}/batch=torn/_temporary/0")
    assert states(spark, log) == want
    LOG.compact(spark, log, DAY)
    assert states(spark, log) == want
    day = LOG.read_log(spark, log).where(F.col("run_date") == DAY)
    assert day.count() == 3 and day.select("batch").distinct().count() == 1
    LOG.compact(spark, log, DAY)
    assert states(spark, log) == want and LOG.read_log(spark, log).count() == 4


def test_texts_by_channel(spark):
    due = rows(spark, *[(c, c, 0, "ready", None) for c in ("push", "reply", "broadcast")])
    got = LOG.attempts(due, answers(spark, *[(c, 400, None) for c in ("push", "reply", "broadcast")]))
    assert {r["message_id"]: r["detail"] for r in got.collect()} == {
        "push": "LINE API error: Unknown error", "reply": "LINE reply error: Unknown error", "broadcast": "LINE broadcast error: Unknown error"}


# request files ----------------------------------------------------------------------
def request_rows(spark):
    bodies = [(f"t{i % 2}", f'k"{i}\\', json.dumps({"n": i, "x": "é" * (i % 50), "nested": {"body": '"}'}})) for i in range(400)]
    bodies += [("t0", "long", json.dumps({"x": "y" * 5000})), ("t0", "long too", json.dumps({"x": "z" * 4000}))]
    return bodies, spark.createDataFrame(bodies, "task string, key string, body string").repartition(5)


def file_sizes(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_files_hold_their_bound_and_every_request(spark, tmp_path):
    bodies, requests = request_rows(spark)
    FILES.write_requests(requests, str(tmp_path), "r1", max_bytes=2000)
    got = FILES.read_requests(spark, str(tmp_path), "r1")
    assert sorted((r["task"], r["key"], r["body"]) for r in got.collect()) == sorted(bodies)
    for path, size in file_sizes(tmp_path).items():
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
        assert size <= 2000 or len(lines) == 1
        assert all(json.loads(x).keys() == {"key", "body"} for x in lines)
    per_file = got.groupBy("task", "file").count().count()
    assert per_file == len(file_sizes(tmp_path)) and per_file < 120


def test_a_rerun_writes_only_unanswered_keys(spark, tmp_path):
    bodies, requests = request_rows(spark)
    answered = spark.createDataFrame([(k,) for _, k, _ in bodies[:300]], "key string")
    for _ in range(2):  # the same run again replaces its files
        FILES.write_requests(requests, str(tmp_path), "r2", answered, max_bytes=2000)
        assert sorted(r["key"] for r in FILES.read_requests(spark, str(tmp_path), "r2").collect()) == sorted(k for _, k, _ in bodies[300:])
    everything = spark.createDataFrame([(k,) for _, k, _ in bodies], "key string")
    FILES.write_requests(requests, str(tmp_path), "r3", everything, max_bytes=2000)
    assert FILES.read_requests(spark, str(tmp_path), "r3").isEmpty()


def counting(spark):
    """A function of a text that returns it and counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x
    return calls, F.udf(same, "string").asNondeterministic()


def test_requests_are_worked_out_once(spark, tmp_path):
    calls, same = counting(spark)
    rows = spark.range(40).select(F.lit("t").alias("task"), F.col("id").cast("string").alias("key"), same(F.lit("{}")).alias("body"))
    FILES.write_requests(rows, str(tmp_path), "r", max_bytes=200)
    assert calls.value == 40
    assert FILES.read_requests(spark, str(tmp_path), "r").count() == 40


def test_request_files_search_a_page_once(spark, sf_dir, monkeypatch):
    from tidings.plans import registry as R
    calls, same = counting(spark)
    read = R.T.pages
    monkeypatch.setattr(R.T, "pages", lambda *a: read(*a).withColumn("html", same("html")))
    R.QUERIES["request_files"](spark, sf_dir).count()
    assert calls.value == read(spark, sf_dir).count()


def test_stories_of_arrays_are_the_stories_of_pages(spark):
    from tidings.operators import feeds as J1
    nav = "<nav><a href='/a'>A</a><a href='/b'>B</a></nav>"
    pages = spark.createDataFrame([(1, nav), (1, nav), (None, nav), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = J1.stories_of(J1.page_story_arrays(pages))
    assert got.columns == J1.page_stories(pages).columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, J1.page_stories(pages).collect()), key=str) != []
