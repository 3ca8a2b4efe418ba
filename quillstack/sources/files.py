"""Scans: tables, JSON arrays and lines, embedding caches, images; and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import exists, read_text, stored, swap_text

STR, INT = T.StringType(), T.IntegerType()
CHUNK = T.StructType([
    *[T.StructField(n, STR) for n in ("chunk_id", "pdf_name", "title_h1", "title_h2", "title_h3")], T.StructField("page_start", INT), T.StructField("page_end", INT), T.StructField("text", STR),
    T.StructField("image_paths", T.ArrayType(STR)), *[T.StructField(n, STR) for n in ("prev_chunk_id", "next_chunk_id", "split_group_id")],
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_files(spark: SparkSession, path: str, manual: str | None = None, last_wins: bool = True) -> DataFrame:
    """JSON arrays of chunks; of equal chunk_ids the one of the last (or first) file, by name, stays. The filter acts before."""
    rows = spark.read.schema(CHUNK).option("multiLine", True).json(path).withColumn("file", F.input_file_name()).where("chunk_id is not null")
    if manual is not None:
        rows = rows.where(F.col("pdf_name") == manual)
    return unique_chunks(rows, last_wins)


def unique_chunks(rows: DataFrame, last_wins: bool = True) -> DataFrame:
    order = [F.col("file").desc()] if last_wins else [F.col("file")]
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).where("__k = 1").drop("__k")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines and lines that are no object of the schema are dropped; bad_lines() tells which."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, line, error) of the lines that json_lines() drops, but for blank ones: what isn't JSON, is no object, or has a field of another type."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = T.StructType([*fields.fields, T.StructField("__bad", STR)])
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    parsed = F.from_json("line", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    whole = F.try_parse_json("line")
    error = F.when(whole.isNull(), "no JSON").when(~F.ltrim("line").startswith("{"), "no object").when(parsed["__bad"].isNotNull(), "a field of another type")
    return rows.withColumn("error", error).where("error is not null")


def valid_embeddings(rows: DataFrame, key: str, dense: str, sparse: str | None = None) -> DataFrame:
    """Rows with a key, a vector without nulls and, where the column is named, a sparse map."""
    fine = F.col(key).isNotNull() & F.col(dense).isNotNull() & (F.size(dense) > 0) & ~F.exists(dense, lambda x: x.isNull())
    return rows.where(fine if sparse is None else fine & F.col(sparse).isNotNull())


def uploaded_ids(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """Only the key column is read."""
    return spark.read.parquet(path).select(key)


def binary_files(spark: SparkSession, path: str, pattern: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """Files with size and hash. Only what is asked for is read: without content and hash, a listing.

    only: a condition on a file's name; the folder is listed first, without opening a file, and those that the condition holds for are opened alone. Their paths go through the driver.
    """
    reader = lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    rows = reader().load(path)
    if only is not None:
        name = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"[^/]*\z", 0), r"\+", "%2B"))
        chosen = [r["path"] for r in rows.select("path").where(only(name)).collect()]
        rows = reader().load([_globless(p) for p in chosen]) if chosen else rows.limit(0)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def _globless(path: str) -> str:
    """A path whose signs of a pattern stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _per_file(files: DataFrame, read: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """path, the fields of each row that read() makes of a file's bytes, and error: a file that fails is one row with its error and no fields."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [{"path": path, "error": None, **row} for row in read(bytes(content))]
                except Exception as e:  # a damaged file mustn't end the scan; its row says what was wrong
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=["path", "error", *names]).astype(object)

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]], schema: str, pattern: str = "*.pdf", manual: str | None = None) -> DataFrame:
    """A row per page of each file, by a given parser of its bytes, with the fields of schema; files that can't be parsed are a row with their error. manual: a file's name or a part of it; other files aren't opened."""
    return _per_file(binary_files(spark, path, pattern, None if manual is None else (lambda name: name.contains(manual))), parser, schema)


def image_size(content: bytes) -> tuple[int, int]:
    """Width and height as the header of a PNG, GIF or JPEG states them."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content):
        if content[at] != 0xFF:
            break
        kind = content[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header, not a table's
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 if kind == 0x01 or 0xD0 <= kind <= 0xD7 else 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    raise ValueError("no size in the header")


def image_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,gif}") -> DataFrame:
    """Images with size, hash, width and height; an image that can't be read has its error."""
    files = binary_files(spark, path, pattern)
    sizes = _per_file(files, lambda c: [dict(zip(("width", "height"), image_size(c), strict=True))], "width int, height int")
    return files.drop("content").join(sizes, "path")


def write_chunks(rows: DataFrame, path: str) -> None:
    """K1, K4: by manual, sorted by page inside files, with Bloom filters on the titles, so that filters on any of the four prune files or row groups."""
    writer = rows.repartition("pdf_name").sortWithinPartitions("page_start").write.mode("overwrite").partitionBy("pdf_name")
    for c in ("title_h1", "title_h2"):
        if c in rows.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


#: A task's files are moved to the target when the task is done, and stay there if the job fails later.
_TASK_BY_TASK = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_through(todo: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "chunk_id", rows_a_part: int = 2048, at_once: int | None = None) -> DataFrame:
    """K2: work() of the rows whose key isn't at path yet, kept part by part; returns what is there then, a row a key.

    A part of about rows_a_part rows is a task, and its rows stay as soon as it is done: if the job fails or its driver is lost, the next run works on the rest only. work() must keep the key and its
    rows' partitions, as functions over Arrow batches do. at_once bounds the parts that are worked on at a time; they are then done in rounds. Rows with a null key take no part; of rows of one key one is worked on.
    """
    spark = todo.sparkSession
    rows = todo.where(F.col(key).isNotNull())
    if exists(spark, path):
        rows = rows.join(spark.read.schema(work(rows).schema).parquet(path).select(key), key, "left_anti")
    rows = rows.dropDuplicates([key])
    parts = -(-rows.count() // rows_a_part)
    schema = work(rows).schema
    rounds = -(-parts // at_once) if at_once else min(parts, 1)
    for r in range(rounds):
        share = rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(rounds)) == r) if rounds > 1 else rows
        work(share.repartition(at_once or parts, key)).write.mode("append").option(*_TASK_BY_TASK).parquet(path)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).dropDuplicates([key])


#: Folders that a keyed target's rows are dealt to by a hash of the key.
BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _held(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame | None:
    """The keys at path in the buckets that rows of new fall into; other folders aren't opened."""
    if not exists(spark, path):
        return None
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
    names = T.StructType([new.schema[key], T.StructField("bucket", INT)])
    return spark.read.schema(names).parquet(path).where(F.col("bucket").isin(touched)).select(key)


def merge(new: DataFrame, path: str, key: str = "chunk_id", buckets: int = BUCKETS) -> None:
    """K3: rows whose key isn't at path are added, so a repeated batch changes nothing; of rows of one key in a batch one is added, null keys take no part.

    The target lies in folders by a hash of the key, sorted by it inside files, with Bloom filters on it: a batch reads the keys of its own buckets only. The number of buckets is the target's for good;
    path/buckets tells it, and another one is an error.
    """
    spark = new.sparkSession
    told = f"{path.rstrip('/')}/_buckets"
    if (known := read_text(spark, told)) is not None and int(known) != buckets:
        raise ValueError(f"{path} has {known} buckets")
    rows = new.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", bucket_of(F.col(key), buckets))
    held = _held(spark, path, rows, key)
    if held is not None:
        rows = rows.join(held, key, "left_anti")
    writer = rows.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("append").partitionBy("bucket")
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    if known is None:
        swap_text(spark, told, str(buckets))


def compact(spark: SparkSession, path: str, key: str = "chunk_id", most: int = 8) -> int:
    """Buckets of more than `most` files become one file each; their number. What they hold is copied to the shared folder first, then each bucket's folder is replaced when all is written."""
    rows = spark.read.parquet(path)
    files = rows.select("bucket", F.input_file_name().alias("file")).distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    full = [r["bucket"] for r in files.collect()]
    if full:
        copy = stored(rows.where(F.col("bucket").isin(full)), "compacted")
        writer = copy.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    return len(full)


def upsert(new: DataFrame, path: str, key: str = "chunk_id") -> None:
    """K3 over a target without buckets: rows whose key isn't there are appended. Every key there is read; merge() reads its buckets' only."""
    spark = new.sparkSession
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.dropDuplicates([key]).write.mode("append").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """K5"""
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, folder: str, name: str, when: datetime | None = None) -> str:
    """K6: a report under a name with the time, as one JSON file's folder; its path."""
    path = f"{folder.rstrip('/')}/{name}_{(when or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    rows.coalesce(1).write.mode("overwrite").json(path)
    return path
