"""Queries on runs: stages, write-through work, keyed merges, and streams over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import retrieval as R
from ..sources.files import merge, table, write_through
from ..sources.stages import Runner, Stage
from ..sources.store import shared_dir
from ..streaming import feedback
from .retrieval import TOK

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def streamed(spark, d: str, name: str, columns: str):
    """A table as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]").select(*columns.split())


@query("t1_run_stages", f"SELECT source AS doc, doc_id, {TOK.format('text')} AS n_tokens, 2 AS run FROM documents WHERE {TOK.format('text')} >= 20 AND source NOT IN (SELECT source FROM documents WHERE doc_id < 10) UNION ALL SELECT source, doc_id, {TOK.format('text')}, 1 FROM documents WHERE {TOK.format('text')} >= 20 AND source IN (SELECT source FROM documents WHERE doc_id < 10)")
def t1(spark, d):
    """Every source is a manual. Those of the first ten documents are run first; the second run does the others only, which `run` tells."""
    docs = table(spark, d, "documents")
    manuals = docs.select(F.col("source").alias("doc")).distinct()

    def runner(run: int) -> Runner:
        parse = Stage("parse", lambda todo: todo.join(docs.select(F.col("source").alias("doc"), "doc_id", "text"), "doc"), nonempty=True)
        normalize = Stage("normalize", lambda rows: rows.select("doc", "doc_id", X.token_count(F.col("text")).alias("n_tokens")).where("n_tokens >= 20"))
        return Runner(spark, at, [parse, normalize, Stage("embed", lambda rows: rows.withColumn("run", F.lit(run)))])

    at = folder(spark, "stages")
    runner(1).run(docs.where("doc_id < 10").select(F.col("source").alias("doc")))
    second = runner(2)
    second.run(manuals)
    return second.rows("embed").select("doc", "doc_id", "n_tokens", "run")


@query("k2_encode_through", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) SELECT d.doc_id, CAST(count(t.term) AS DOUBLE) AS total FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY 1")
def k2(spark, d):
    """Even documents are encoded first; the second run encodes the rest and finds those."""
    docs, at = table(spark, d, "documents").select("doc_id", "text"), folder(spark, "encoded")
    work = lambda part: R.encode(part, key="doc_id")
    write_through(docs.where("doc_id % 2 = 0"), at, work, "doc_id")
    made = write_through(docs, at, work, "doc_id")
    return made.select("doc_id", F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("k3_merge_batches", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 2 END AS batch FROM documents")
def k3(spark, d):
    """Three batches that overlap; a key's first batch stays."""
    docs, at = table(spark, d, "documents").select("doc_id"), folder(spark, "merged")
    for batch, rows in enumerate((docs.where("doc_id % 3 > 0"), docs, docs), 1):
        merge(rows.withColumn("batch", F.lit(batch)), at, "doc_id", buckets=16)
    return spark.read.parquet(at).select("doc_id", "batch")


@query("t2_upsert_stream", "SELECT DISTINCT user_id FROM events")
def t2(spark, d):
    """The stream is run twice from its beginning; the second run finds every key there."""
    at = folder(spark, "upserts")
    for run in (1, 2):
        feedback.upsert_stream(streamed(spark, d, "events", "user_id"), f"{at}/target", f"{at}/checkpoint{run}", "user_id", buckets=16).awaitTermination()
    return spark.read.parquet(f"{at}/target").select("user_id")


@query("t3_feedback_log", """SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('click', 'purchase') THEN 'up' WHEN event_type IN ('view', 'error') THEN 'down' END AS feedback, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS n_messages FROM events GROUP BY ALL""")
def t3(spark, d):
    """Odd events are the older log's lines, even ones the newer's; the query is started twice with the same folders."""
    at = folder(spark, "feedback")
    said = lambda up, down: F.when(F.col("event_type").isin("click", "purchase"), up).when(F.col("event_type").isin("view", "error"), down)
    for _ in range(2):
        rows = [streamed(spark, d, "events", "event_id user_id event_type ts").where(f"event_id % 2 = {k}") for k in (0, 1)]
        v2 = rows[0].select(F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("message_id"), said("up", "down").alias("feedback"), F.lit("q").alias("query"), F.lit("a").alias("answer"))
        v1 = rows[1].select(F.col("ts").alias("timestamp"), F.lit("q").alias("query"), F.lit("a").alias("answer"), F.lit("s").alias("search_query"), F.lit(False).alias("query_rewritten"), said("positive", "negative").alias("feedback"))
        feedback.feedback_log(v1, v2, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.json(f"{at}/log").groupBy(F.to_date("day").alias("day"), "feedback").agg(F.count(F.lit(1)).alias("n"), F.count("message_id").alias("n_messages"))


@query("t4_sessions", """WITH m AS (SELECT * FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, count(*) AS judged, CAST(sum(turn) AS BIGINT) AS judged_sum FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'user') GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM m WHERE turn % 5 <> 4)
SELECT c.conv_id, coalesce(2 * n, 0) AS n_messages, coalesce(kept, 0) AS n_turns, coalesce(last, '') AS last_query, coalesce(judged, 0) AS judged, coalesce(judged_sum, 0) AS judged_sum, coalesce(routes, '') AS routes
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 5 <> 4) AS kept FROM m GROUP BY 1) USING (conv_id) LEFT JOIN f USING (conv_id) LEFT JOIN (SELECT conv_id, text AS last FROM k WHERE k = 1) USING (conv_id)
LEFT JOIN (SELECT conv_id, string_agg(CASE WHEN turn % 3 = 0 THEN 'r' || CAST(turn AS VARCHAR) ELSE '' END, ',' ORDER BY turn) AS routes FROM k GROUP BY 1) USING (conv_id)""")
def t4(spark, d):
    """Users' turns are questions, a fifth of them refused, a third of the rest searched; the others' turns are judgements."""
    at, k = folder(spark, "sessions"), F.col("turn")
    rows = streamed(spark, d, "conversations", "conv_id turn role text")
    action = F.when(k % 5 == 4, "reject").when(k % 3 == 0, "search").otherwise("chat")
    kind = F.when(F.col("role") == "user", "message").otherwise("feedback")
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), kind.alias("kind"), k.cast("long").alias("message_id"), F.col("text").alias("query"), F.lit("a").alias("answer"), action.alias("action"), F.concat(F.lit("r"), k.cast("string")).alias("route_query"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("ts"))
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.parquet(f"{at}/states/{n}")
    stream = feedback.sessions(rows, turns=100)
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(f"{feedback.SESSION}, batch long").parquet(f"{at}/states/*")
    last = states.where("not ended").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("batch").desc()))).where("k = 1")
    total = F.aggregate("submitted", F.lit(0).cast("long"), lambda s, x: s + x)
    return last.select(F.col("conv_id").cast("long").alias("conv_id"), "n_messages", "n_turns", "last_query", F.size("submitted").cast("long").alias("judged"), total.alias("judged_sum"), F.array_join("route_history.route_query", ",").alias("routes"))
