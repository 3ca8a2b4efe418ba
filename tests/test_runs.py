"""Runs that break off and go on: stages, write-through work, keyed merges."""

import json
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from quillstack.operators import images as I
from quillstack.operators import retrieval as R
from quillstack.sources import files
from quillstack.sources.stages import IMPORT, Runner, Stage
from reading import files_read


def stages(calls, fail=()):
    def stage(name, make):
        def run(rows):
            calls.append((name, sorted(r.doc for r in rows.select("doc").distinct().collect())))
            out = make(rows)
            # fails while its rows are written, as a lost executor would make it
            return out.withColumn("v", F.when(F.lit(name in fail), F.raise_error(F.lit(f"{name} broke"))).otherwise(F.col("v"))) if name in fail else out

        return Stage(name, run, nonempty=name == "parse")

    return [
        stage("parse", lambda rows: rows.where("doc <> 'blank'").select("doc", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))),
        stage("normalize", lambda rows: rows.select("doc", (F.col("v") * 10).alias("v"))),
        stage("embed", lambda rows: rows.select("doc", (F.col("v") + 1).alias("v"))),
    ]


def manuals(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "doc string")


def test_a_run_goes_on_after_the_stage_that_broke(spark, tmp_path):
    docs, calls = manuals(spark, "a", "b", None, "a"), []
    with pytest.raises(Exception, match="normalize broke"):
        Runner(spark, str(tmp_path), stages(calls, fail={"normalize"})).run(docs)
    assert [n for n, _ in calls] == ["parse", "normalize"]
    calls.clear()
    runner = Runner(spark, str(tmp_path), stages(calls))
    assert {(r.doc, r.stage) for r in runner.state().collect()} == {("a", "parse"), ("b", "parse")}
    assert runner.run(docs) == ["normalize", "embed"] == [n for n, _ in calls]
    assert sorted((r.doc, r.v) for r in runner.rows("embed").collect()) == [("a", 11), ("a", 21), ("b", 11), ("b", 21)]
    assert runner.run(docs) == []
    # a manual that comes later is run alone
    calls.clear()
    assert runner.run(manuals(spark, "a", "b", "c")) == ["parse", "normalize", "embed"] and {tuple(d) for _, d in calls} == {("c",)}
    assert runner.rows("embed").count() == 6


def test_restart_and_no_resume(spark, tmp_path):
    calls = []
    runner = Runner(spark, str(tmp_path), stages(calls))
    docs = manuals(spark, "a", "b")
    runner.run(docs)
    assert runner.run(docs, restart_from=" Normalize ") == ["normalize", "embed"]
    assert runner.run(manuals(spark, "a"), restart_from="embed") == ["embed"] and calls[-1] == ("embed", ["a"])
    assert runner.rows("embed").count() == 4
    assert runner.run(docs, resume=False) == ["parse", "normalize", "embed"]
    assert runner.rows("embed").count() == 4 and runner.run(docs) == []
    with pytest.raises(ValueError, match="unknown stage"):
        runner.run(docs, restart_from="print")
    with pytest.raises(ValueError, match="one name"):
        Runner(spark, str(tmp_path), [*stages([]), *stages([])])
    assert runner.run(docs.limit(0)) == [] and len(IMPORT) == 6


def test_empty_and_lost_products(spark, tmp_path):
    import shutil

    calls = []
    runner = Runner(spark, str(tmp_path), stages(calls))
    docs = manuals(spark, "a", "blank")
    assert runner.run(docs) == ["parse", "normalize", "embed"]
    # of `blank` nothing was made, so it isn't parsed, and no later stage takes it for done
    assert {r.doc for r in runner.state().collect()} == {"a"} and runner.run(docs) == ["parse", "normalize", "embed"]
    attempt = runner.state().where("stage = 'embed' and doc = 'a'").first().attempt
    shutil.rmtree(tmp_path / "embed" / attempt)
    calls.clear()
    assert runner.run(manuals(spark, "a")) == ["embed"]


KILLED = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from quillstack.sources.stages import Runner, Stage
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
parse = Stage("parse", lambda rows: rows.withColumn("v", F.lit(1)))
def die(rows):
    rows.write.parquet(sys.argv[1] + "/normalize/half")  # rows of an attempt that nothing names
    os._exit(9)
Runner(spark, sys.argv[1], [parse, Stage("normalize", die)]).run(spark.createDataFrame([("a",)], "doc string"))
"""


def test_a_killed_driver_loses_its_stage_only(spark, tmp_path):
    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], capture_output=True, timeout=300, env=dict(os.environ), check=False)
    assert done.returncode == 9
    runs = []
    runner = Runner(spark, str(tmp_path), [Stage("parse", lambda rows: runs.append("parse")), Stage("normalize", lambda rows: rows.withColumn("v", F.col("v") + 1))])
    assert runner.run(manuals(spark, "a")) == ["normalize"] and not runs
    assert [r.v for r in runner.rows("normalize").collect()] == [2]


def picky(run, bad=None):
    """An encoder that breaks on a text, and marks which run made a vector."""

    def make():
        terms = R.HashedTerms(4)

        def encode(texts):
            if bad in texts:
                raise ValueError("out of memory")
            return [([float(run)] * 4, s) for _, s in terms(texts)]

        return encode

    return make


def test_finished_parts_of_a_failed_job_stay(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(200)] + [("c7", "again"), (None, "nobody")], "chunk_id string, text string")
    work = lambda run, bad=None: lambda part: R.encode(part, picky(run, bad))
    with pytest.raises(Exception, match="out of memory"):
        files.write_through(rows, path, work(1, "text 150"), rows_a_part=10)
    kept = spark.read.parquet(path)
    n = kept.count()
    print("kept of a failed job:", n)
    assert 0 < n < 200 and "c150" not in {r.chunk_id for r in kept.collect()}
    got = {r.chunk_id: r.dense[0] for r in files.write_through(rows, path, work(2), rows_a_part=10).collect()}
    assert len(got) == 200 and sum(v == 1.0 for v in got.values()) == n  # only the rest was encoded anew
    assert {r.dense[0] for r in files.write_through(rows, path, work(3), rows_a_part=10).collect()} == {1.0, 2.0}
    assert files.write_through(rows.limit(0), str(tmp_path / "none"), work(1)).count() == 0


def test_captions_written_through(spark, tmp_path):
    """Rounds of two calls at a time; what a round has made stays."""
    path, paths = str(tmp_path / "captions"), spark.createDataFrame([(f"img/{i}.png",) for i in range(12)], "path string")
    made = files.write_through(paths, path, lambda part: I.caption(part, lambda p: f"figure {p}", wait=0.0, at_once=None), key="path", rows_a_part=3, at_once=2)
    assert {r.path: r.caption for r in made.collect()} == {f"img/{i}.png": f"figure img/{i}.png" for i in range(12)}
    assert I.pending(paths, made).count() == 0


def test_merge_looks_into_its_buckets(spark, tmp_path):
    path = str(tmp_path / "target")
    base = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.col("id").alias("v"))
    files.merge(base, path)
    files.merge(base, path)
    assert spark.read.parquet(path).count() == 20_000
    batch = spark.createDataFrame([("k5", -1), ("new1", -2), ("new1", -3), (None, -4), ("new2", -5)], "chunk_id string, v long")
    rows = batch.where("chunk_id is not null").withColumn("bucket", files.bucket_of(F.col("chunk_id")))
    every = files_read(spark.read.parquet(path).select("chunk_id"))
    assert files_read(files._held(spark, path, rows, "chunk_id")) <= 3 < every / 20
    for _ in range(2):
        files.merge(batch, path)
    got = {r.chunk_id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == spark.read.parquet(path).count() == 20_002 and got["k5"] == 5 and got["new1"] in (-2, -3) and got["new2"] == -5
    with pytest.raises(ValueError, match="256 buckets"):
        files.merge(batch, path, buckets=8)


def test_compacted_buckets(spark, tmp_path):
    path = str(tmp_path / "target")
    for k in range(5):
        files.merge(spark.range(k * 100, k * 100 + 100).select(F.col("id").alias("chunk_id")), path, buckets=4)
    before = files_read(spark.read.parquet(path))
    assert files.compact(spark, path, most=2) == 4 and files_read(spark.read.parquet(path)) == 4 < before
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == list(range(500))
    files.merge(spark.range(480, 510).select(F.col("id").alias("chunk_id")), path, buckets=4)
    assert spark.read.parquet(path).count() == 510 and files.compact(spark, path, most=2) == 0


def test_swapped_file_is_whole(spark, tmp_path):
    from quillstack.sources.store import read_text, swap_text

    path = f"{tmp_path}/now"
    assert read_text(spark, path) is None
    for text in ("one", json.dumps({"é": uuid.uuid4().hex})):
        swap_text(spark, path, text)
        assert read_text(spark, path) == text
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["now"]
