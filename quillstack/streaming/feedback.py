"""Unbounded inputs: idempotent upserts, the feedback log and the state of conversations. The windowed counts are an extension."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.reports import unite_feedback
from ..sources.files import BUCKETS, merge
from ..sources.store import exists

if TYPE_CHECKING:
    import pandas as pd

#: Fields of the two feedback logs, the older one's without an id of the message.
FEEDBACK_1 = "timestamp timestamp, query string, answer string, search_query string, query_rewritten boolean, feedback string"
FEEDBACK_2 = "timestamp timestamp, message_id string, feedback string, query string, answer string"


def feedback_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """T3"""
    return spark.readStream.schema(schema).json(path)


def once_per_message(stream: DataFrame, key: str = "message_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """A message counts once; keys older than the watermark are forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def feedback_log(v1: DataFrame, v2: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Both logs' streams (FEEDBACK_1 and FEEDBACK_2) in one schema, written to target as JSON lines in a folder a day, each line once.

    The sink's own record tells which files of which batch are whole, and the checkpoint which lines were read, so a query that is stopped or killed and started again with the same two folders neither loses nor repeats a
    line. Read target with spark.read.json, which goes by that record. Judgements that are neither kind are null; lines without a time are of the day `null`.
    """
    both = unite_feedback(v1, v2).withColumn("day", F.coalesce(F.to_date("timestamp").cast("string"), F.lit("null")))
    return both.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start()


def compact_days(spark: SparkSession, target: str, into: str, before: str) -> list[str]:
    """Days of a feedback log that are over (earlier than `before`) as Parquet in time order, a file a day, where `into` hasn't got them; their names. A run that is repeated adds nothing, and one that broke off is made up for."""
    log = spark.read.json(target)
    days = [r["day"] for r in log.select(F.col("day").cast("string").alias("day")).distinct().where(F.col("day") < before).collect()]
    missing = sorted(d for d in days if not exists(spark, f"{into}/day={d}/_SUCCESS"))
    for day in missing:
        rows = log.where(F.col("day").cast("string") == day).drop("day")
        rows.repartition(1).sortWithinPartitions("timestamp").write.mode("overwrite").parquet(f"{into}/day={day}")
    return missing


SESSION = "conv_id string, n_messages long, n_turns long, last_query string, submitted array<long>, route_history array<struct<message_id: long, query: string, answer: string, route_query: string>>, ended boolean"
_TURN = "message_id long, query string, answer string, route_query string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sessions(StatefulProcessor):
    """Everything kept is the same in whatever order a conversation's rows come, so rows need no sorting within a batch or across Arrow batches."""

    def __init__(self, turns: int, idle: int):
        self.turns, self.idle = turns, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n_messages long, n_turns long, until long")
        self.history = handle.getListState("history", _TURN)
        self.judged = handle.getMapState("judged", "message_id long", "seen boolean")

    def _row(self, key: Any, counts: tuple, history: list, ended: bool) -> pd.DataFrame:
        import pandas as pd

        told = [dict(zip(("message_id", "query", "answer", "route_query"), t, strict=True)) for t in history]
        submitted = sorted(int(k[0]) for k in self.judged.keys())
        return pd.DataFrame({"conv_id": [key[0]], "n_messages": [counts[0]], "n_turns": [counts[1]], "last_query": [history[-1][1] if history else ""], "submitted": [submitted], "route_history": [told], "ended": [ended]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        messages, turns, until = self.counts.get() if self.counts.exists() else (0, 0, 0)
        history = [tuple(t) for t in self.history.get()] if self.history.exists() else []
        last = 0
        for part in rows:
            last = max(last, int(part["ts"].max().timestamp() * 1000))
            judged = part.loc[part["kind"] == "feedback", "message_id"].dropna()
            for k in judged.drop_duplicates().nlargest(self.turns):
                self.judged.updateValue((int(k),), (True,))
            said = part[part["kind"] != "feedback"]
            kept = said[(said["action"] != "reject") & said["message_id"].notna()]
            messages, turns = messages + 2 * len(said), turns + int((said["action"] != "reject").sum())
            text = lambda v: v if isinstance(v, str) else ""
            new = [(int(r.message_id), text(r.query), text(r.answer), text(r.route_query) if r.action == "search" else "") for r in kept.nlargest(self.turns, "message_id", keep="all").itertuples()]
            history = sorted(set(history) | set(new))[-self.turns :]
        for k in sorted(int(k[0]) for k in self.judged.keys())[: -self.turns]:
            self.judged.removeKey((k,))
        if last + self.idle > until:
            if until:
                self.handle.deleteTimer(until)
            until = last + self.idle
            self.handle.registerTimer(until)
        self.counts.update((messages, turns, until))
        self.history.put(history) if history else self.history.clear()
        yield self._row(key, (messages, turns), history, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        counts = self.counts.get()
        if counts is None or expiredTimerInfo.getExpiryTimeInMs() < counts[2]:
            return
        yield self._row(key, counts, [tuple(t) for t in self.history.get()], True)
        self.counts.clear()
        self.history.clear()
        self.judged.clear()

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, turns: int = 50, idle: int = 1800, late: str = "10 minutes") -> DataFrame:
    """T4: a conversation's state after each batch that has rows of it: messages and turns counted, its last question, messages judged (each once), the last turns and what they were searched as.

    stream: conv_id, kind (message or feedback), message_id, query, answer, action, route_query, ts. A question is two messages; a refused one (action `reject`) is no turn of the history, and only a search has a route query.
    What is kept of a conversation is bounded: counts, the last `turns` turns by message_id, and the `turns` last of the messages judged. A repeated judgement changes nothing; rows of equal message_id stand in the order of
    their texts; order doesn't matter else, however many batches a conversation's rows are cut into, but rows that come later than `late` behind the watermark are dropped. Null texts are empty, a null message_id counts but isn't kept.

    `idle` seconds after its last row, by the watermark, a conversation's state is given once more as ended and forgotten. The session's state store is set to RocksDB, which keeps such state.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = stream.select("conv_id", "kind", "message_id", "query", "answer", "action", "route_query", "ts").where("conv_id is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("conv_id").transformWithStateInPandas(_Sessions(turns, idle * 1000), SESSION, "Update", "EventTime")


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str = "chunk_id", buckets: int = BUCKETS) -> StreamingQuery:
    """Each batch's new keys are added to a target in buckets; a batch that is run again adds nothing, and each looks into its own buckets only."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch, target, key, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, kind: str, time: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts by tumbling window and kind; the same plan over a batch or a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
