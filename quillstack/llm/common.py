"""Plumbing that the operators share: prefix sums, connected components, names that are free. Tables go to the shared folder by the library's store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import freed, stored

__all__ = ["components", "freed", "numbered_columns", "running_start", "slices", "stored", "table"]


def numbered_columns(df: DataFrame) -> DataFrame:
    """df under plain column names, in order: functions over Arrow batches look columns up by names, and would take a dot in one for a field."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to `rows` rows: a worker that turns texts into Python's holds no more of them, and hands no more back, at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_start(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows_per_bucket: int = 5000) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come before.

    A window over a hot key would put its rows into one task, so each key's rows are first dealt to buckets by a hash of the
    order columns, about rows_per_bucket rows a bucket; sums are taken inside buckets, then over each key's bucket totals
    (a row per bucket). The order is therefore bucket first, `order` inside: arbitrary but the same at every run.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    n = n.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.ceil(F.col("__n") / rows_per_bucket).alias("__b"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    dealt = df.join(n, cond).drop(*[f"__k_{k}" for k in keys]).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.col("__b"))).drop("__b")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = dealt.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__t"))
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__start", F.coalesce(F.sum("__t").over(across), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__kb"), "__start")
    back = dealt.join(totals, cond & (F.col("__bucket") == F.col("__kb")))
    return back.withColumn(out, (F.col("__in") + F.col("__start")).cast("long")).drop("__in", "__start", "__kb", "__bucket", *[f"__k_{k}" for k in keys])


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (u > v): each node hands the least node it sees to its larger (or, if small, its smaller) neighbours."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").where((F.col("b") > F.col("a")) & (F.col("m") < F.col("b"))).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str, nodes: int) -> DataFrame:
    """(node, component) of every node with an edge, component the least node reachable; nodes: about how many there are.

    Alternating large and small stars: each round is group-bys with map-side minima and joins that adaptive execution may
    split, and is written to the shared folder; only a count comes to the driver. Ends when the edges are stars.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    while True:
        now = stored(_stars(_stars(now, small=False), small=True), "stars", nodes)
        seen = now.select(F.col("u").alias("n"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        wrong = seen.groupBy("n").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where((F.col("above") > 1) | ((F.col("above") > 0) & (F.col("below") > 0)))
        if wrong.isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
