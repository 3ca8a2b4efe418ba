"""Streams that are stopped and started again, and the state of conversations against a plain loop."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillstack.streaming import feedback

SAID = "conv_id string, kind string, message_id long, query string, answer string, action string, route_query string, ts timestamp"


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def log(spark, tmp_path):
    streams = [feedback.feedback_stream(spark, f"{tmp_path}/{v}", s) for v, s in (("v1", feedback.FEEDBACK_1), ("v2", feedback.FEEDBACK_2))]
    feedback.feedback_log(*streams, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()


def test_feedback_log_holds_each_line_once(spark, tmp_path):
    lines(tmp_path / "v1/1.json", [{"timestamp": "2026-01-01T10:00:00Z", "query": "q1", "feedback": "positive", "query_rewritten": True}])
    lines(tmp_path / "v2/1.json", [{"timestamp": "2026-01-02T10:00:00Z", "message_id": "m1", "feedback": "down", "query": "q2"}, {"message_id": "m2", "feedback": "odd"}])
    log(spark, tmp_path)
    log(spark, tmp_path)  # started again: nothing new
    lines(tmp_path / "v2/2.json", [{"timestamp": "2026-01-03T09:00:00Z", "message_id": f"m{k}", "feedback": "up"} for k in range(3, 6)])
    log(spark, tmp_path)
    got = spark.read.json(f"{tmp_path}/log")
    assert sorted((r.message_id or "", r.feedback or "", str(r.day)) for r in got.collect()) == [("", "up", "2026-01-01"), ("m1", "down", "2026-01-02"), ("m2", "", "null"), ("m3", "up", "2026-01-03"), ("m4", "up", "2026-01-03"), ("m5", "up", "2026-01-03")]
    assert feedback.compact_days(spark, f"{tmp_path}/log", f"{tmp_path}/days", "2026-01-03") == ["2026-01-01", "2026-01-02"]
    assert feedback.compact_days(spark, f"{tmp_path}/log", f"{tmp_path}/days", "2026-01-04") == ["2026-01-03"]
    assert feedback.compact_days(spark, f"{tmp_path}/log", f"{tmp_path}/days", "2026-01-04") == []
    assert spark.read.option("mergeSchema", True).parquet(f"{tmp_path}/days").count() == 5


KILLED = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from quillstack.streaming import feedback
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
at = sys.argv[1]
streams = [feedback.feedback_stream(spark, f"{at}/{v}", s) for v, s in (("v1", feedback.FEEDBACK_1), ("v2", feedback.FEEDBACK_2))]
def slow(x):
    import time
    time.sleep(0.4 if x and x.endswith("9") else 0)
    return x
streams[1] = streams[1].withColumn("message_id", F.udf(slow)("message_id"))
query = feedback.feedback_log(*streams, f"{at}/log", f"{at}/ck")
import time
while not (query.lastProgress or os.path.exists(f"{at}/ck/offsets/0")):
    time.sleep(0.1)
time.sleep(0.5)
os._exit(9)
"""


def test_killed_feedback_log_goes_on(spark, tmp_path):
    lines(tmp_path / "v1/1.json", [{"timestamp": "2026-01-01T10:00:00Z", "query": "q1", "feedback": "positive"}])
    for k in range(6):
        lines(tmp_path / f"v2/{k}.json", [{"timestamp": "2026-01-02T10:00:00Z", "message_id": f"m{k}{i}", "feedback": "up"} for i in range(30)])
    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], capture_output=True, timeout=300, env=dict(os.environ), check=False)
    assert done.returncode == 9
    log(spark, tmp_path)
    got = [r.message_id for r in spark.read.json(f"{tmp_path}/log").where("message_id is not null").collect()]
    assert sorted(got) == sorted(f"m{k}{i}" for k in range(6) for i in range(30))


def plain_loop(rows, turns):
    out = {}
    for r in sorted(rows, key=lambda r: (r["message_id"] is not None, r["message_id"] or 0)):
        s = out.setdefault(r["conv_id"], {"n_messages": 0, "n_turns": 0, "submitted": set(), "history": set()})
        if r["kind"] == "feedback":
            s["submitted"].add(r["message_id"])
            continue
        s["n_messages"] += 2
        if r["action"] != "reject":
            s["n_turns"] += 1
            s["history"].add((r["message_id"], r["query"] or "", r["answer"] or "", (r["route_query"] or "") if r["action"] == "search" else ""))
    for s in out.values():
        s["submitted"], s["history"] = sorted(s["submitted"])[-turns:], sorted(s["history"])[-turns:]
    return out


def states(spark, tmp_path, turns, late="2 hours"):
    latest = {}

    def keep(batch, _):
        for r in batch.collect():
            latest.setdefault(r.conv_id, []).append(r)

    stream = feedback.sessions(spark.readStream.schema(SAID).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), turns, idle=3600, late=late)
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    return latest


def same(row, want):
    assert (row.n_messages, row.n_turns, list(row.submitted)) == (want["n_messages"], want["n_turns"], want["submitted"])
    assert [tuple(t) for t in row.route_history] == want["history"] and row.last_query == (want["history"][-1][1] if want["history"] else "")


def test_sessions_are_what_a_plain_loop_gives(spark, tmp_path):
    """A conversation of over 10,000 rows, cut into Arrow batches and into two runs; rows in any order."""
    rng, turns = random.Random(4), 20
    rows = []
    for conv, n in (("hot", 12_000), ("c", 30), ("d", 1)):
        for i in range(n):
            rows.append({"conv_id": conv, "kind": "message", "message_id": i, "query": rng.choice(["q", None]) and f"q{i}", "answer": f"a{i}", "action": rng.choice(["search", "chat", "reject"]), "route_query": f"r{i}", "ts": f"2026-01-01T00:{i % 60:02d}:00Z"})
            if i % 3 == 0:
                rows += [{"conv_id": conv, "kind": "feedback", "message_id": i, "ts": "2026-01-01T00:30:00Z", "query": None, "answer": None, "action": None, "route_query": None}] * (1 + i % 2)
    rng.shuffle(rows)
    lines(tmp_path / "in/1.json", rows[:9000])
    first = states(spark, tmp_path, turns)
    want = plain_loop(rows[:9000], turns)
    assert set(first) == set(want)
    for conv, found in first.items():
        same(found[-1], want[conv])
    lines(tmp_path / "in/2.json", rows[9000:])  # the state outlives the query
    want = plain_loop(rows, turns)
    for conv, found in states(spark, tmp_path, turns).items():
        same(found[-1], want[conv])


def test_old_sessions_end(spark, tmp_path):
    row = lambda conv, i, ts: {"conv_id": conv, "kind": "message", "message_id": i, "query": "q", "answer": "a", "action": "search", "route_query": "r", "ts": ts}
    lines(tmp_path / "in/1.json", [row("old", 1, "2026-01-01T00:00:00Z")])
    states(spark, tmp_path, 5, "1 minute")
    lines(tmp_path / "in/2.json", [row("new", 1, "2026-01-01T09:00:00Z")])
    states(spark, tmp_path, 5, "1 minute")
    lines(tmp_path / "in/3.json", [row("new", 2, "2026-01-01T09:10:00Z"), row("old", 2, "2026-01-01T09:10:00Z")])
    found = states(spark, tmp_path, 5, "1 minute")
    assert found["old"][-1].n_turns == 1 and found["new"][-1].n_turns == 2  # what `old` had was forgotten


def test_upsert_stream_looks_into_buckets(spark, tmp_path):
    lines(tmp_path / "in/1.json", [{"chunk_id": f"c{i}"} for i in range(50)])
    for _ in range(2):
        feedback.upsert_stream(feedback.feedback_stream(spark, f"{tmp_path}/in", "chunk_id string"), f"{tmp_path}/t", f"{tmp_path}/ck{_}", buckets=8).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/t")
    assert got.count() == 50 and got.select("bucket").distinct().count() == 8
    assert {r.chunk_id for r in got.where(F.col("bucket").isNotNull()).collect()} == {f"c{i}" for i in range(50)}


def test_no_rows(spark, tmp_path):
    lines(tmp_path / "in/1.json", [])
    assert states(spark, tmp_path, 5) == {}


pytestmark = pytest.mark.filterwarnings("ignore")
