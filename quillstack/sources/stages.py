"""Runs the stages of an import over many manuals, and goes on where a run has broken off.

A stage's rows are written to a folder of their own for each attempt. What is done is a table (doc, stage, attempt, finished_at), written anew after each stage; a small file that
names the table's present version is swapped atomically. So rows of an attempt that broke off are never taken for a stage's, and a stage that is done isn't done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists, read_text, swap_text

#: The stages of an import in their order.
IMPORT = ("parse", "normalize", "vlm", "inject", "embed", "upload")
STATE = "doc string, stage string, attempt string, finished_at timestamp"


@dataclass
class Stage:
    """run makes a stage's rows (with doc) from those of the stage before, of the manuals that need it; the first is given the manuals. nonempty: a manual of which it made no row isn't done."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    nonempty: bool = False


class Runner:
    def __init__(self, spark: SparkSession, folder: str, stages: list[Stage]):
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages
        self.names = [s.name for s in stages]
        if len(set(self.names)) < len(stages):
            raise ValueError("two stages of one name")

    def _path(self, stage: str, attempt: str) -> str:
        return f"{self.folder}/{stage}/{attempt}"

    def state(self) -> DataFrame:
        """(doc, stage, attempt, finished_at) of what is done. An attempt whose rows are gone doesn't count."""
        version = read_text(self.spark, f"{self.folder}/current")
        if version is None:
            return self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(STATE).parquet(f"{self.folder}/state/{version.strip()}")
        attempts = rows.select("stage", "attempt").distinct().collect()  # a row a run and stage
        gone = [r["attempt"] for r in attempts if not exists(self.spark, f"{self._path(r['stage'], r['attempt'])}/_SUCCESS")]
        return rows.where(~F.col("attempt").isin(gone)) if gone else rows

    def _swap(self, state: DataFrame) -> None:
        version = uuid.uuid4().hex[:12]
        state.write.parquet(f"{self.folder}/state/{version}")
        swap_text(self.spark, f"{self.folder}/current", version)

    def restart_from(self, stage: str, docs: DataFrame | None = None) -> None:
        """What is done of this stage and those after it counts no more, of all manuals or of the given ones (doc)."""
        wanted = stage.strip().lower()
        if wanted not in self.names:
            raise ValueError(f"unknown stage {stage!r}; allowed: {', '.join(self.names)}")
        late = F.col("stage").isin(self.names[self.names.index(wanted) :])
        state = self.state()
        if docs is not None:
            state = state.join(docs.select("doc", F.lit(True).alias("again")).distinct(), "doc", "left")
            late = late & F.coalesce("again", F.lit(False))
        self._swap(state.where(~late).select("doc", "stage", "attempt", "finished_at"))

    def rows(self, stage: str, state: DataFrame | None = None) -> DataFrame | None:
        """The rows that a stage has made of each manual in the attempt that counts; nothing if it never ran."""
        done = (self.state() if state is None else state).where(F.col("stage") == stage)
        attempts = [r["attempt"] for r in done.select("attempt").distinct().collect()]
        found = None
        for attempt in sorted(attempts):
            part = self.spark.read.parquet(self._path(stage, attempt)).join(done.where(F.col("attempt") == attempt).select("doc"), "doc", "left_semi")
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        return found

    def run(self, docs: DataFrame, restart_from: str | None = None, resume: bool = True) -> list[str]:
        """Runs each stage for those of docs (doc, one row a manual) of which it isn't done, all of them in one job; the names of the stages that had to be run.

        restart_from: what is done of these manuals from this stage on counts no more. resume=False: nothing that is done counts, though what stages keep themselves, as caches of captions, still serves. A stage that
        fails raises; what was done before it stays done. Null manuals take no part; an empty table runs nothing.
        """
        docs = docs.where(F.col("doc").isNotNull()).dropDuplicates(["doc"])
        if restart_from is not None:
            self.restart_from(restart_from, docs)
        state = self.state()
        if not resume:
            state = state.join(docs.select("doc"), "doc", "left_anti")
        ran: list[str] = []
        for i, stage in enumerate(self.stages):
            done = state.where(F.col("stage") == stage.name)
            todo = docs.join(done.select("doc"), "doc", "left_anti")
            if todo.isEmpty():
                continue
            given = todo if not i else self.rows(self.stages[i - 1].name, state)
            if given is None:  # the stage before made nothing that counts
                continue
            if i:
                given = given.join(todo.select("doc"), "doc", "left_semi")
            attempt = uuid.uuid4().hex[:12]
            stage.run(given).write.parquet(self._path(stage.name, attempt))
            if i:  # a manual that the stage before isn't done with stays behind
                todo = todo.join(state.where(F.col("stage") == self.stages[i - 1].name).select("doc"), "doc", "left_semi")
            if stage.nonempty:
                todo = todo.join(self.spark.read.parquet(self._path(stage.name, attempt)).select("doc").distinct(), "doc", "left_semi")
            finished = todo.select(F.col("doc").cast("string").alias("doc"), F.lit(stage.name).alias("stage"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("finished_at"))
            self._swap(state.unionByName(finished))
            state = self.state()
            ran.append(stage.name)
        return ran
