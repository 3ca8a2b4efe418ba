"""Images of pages and their captions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAILED, MARK = "CAPTION_FAILED", "[IMG_CAPTION]"


def in_body(boxes: DataFrame) -> DataFrame:
    """I1"""
    return boxes.where((F.col("y0") >= F.col("margin_top")) & (F.col("y0") <= F.col("height") - F.col("margin_bottom")))


def cluster_boxes(boxes: DataFrame, gap: float = 50.0) -> DataFrame:
    """Boxes of a page by (y0, x0); one that begins `gap` or more below all before it opens a cluster; the cluster's box is their union."""
    w = Window.partitionBy("doc", "page").orderBy("y0", "x0", "box")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("new", F.coalesce(F.col("y0") - reach >= gap, F.lit(True)).cast("int")).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc", "page", "cluster").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("boxes"))


def clip(boxes: DataFrame, padding: float = 140.0, scale: float = 2.0) -> DataFrame:
    """Wider by the scaled padding, inside the page."""
    pad = padding / scale
    return boxes.withColumn("x0", F.greatest(F.col("x0") - pad, F.lit(0.0))).withColumn("x1", F.least(F.col("x1") + pad, F.col("width"))).withColumn("y0", F.greatest("y0", F.lit(0.0))).withColumn("y1", F.least("y1", F.col("height")))


def solid(pixels: Column, least: float = 5.0) -> Column:
    """I4: whether an array of channel values varies so little that the image is one colour."""
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v) / n
    return F.sqrt(F.aggregate(pixels, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n) < least


def owners(images: DataFrame, markers: DataFrame) -> DataFrame:
    """An image belongs to the lowest marker strictly above it (the larger index on ties), else to the page's smallest; a page without markers drops it.

    An as-of join as one sort: images and markers of a page in one order, images before markers of the same height, and the last marker met so far.
    """
    marker = F.struct("marker_y", "idx", "chunk_id")
    both = markers.select("doc", "page", F.col("marker_y").alias("y"), F.lit(1).alias("kind"), F.col("idx").alias("n"), marker.alias("m"), F.lit(None).cast(images.schema["img"].dataType).alias("img"))
    both = both.unionByName(images.select("doc", "page", F.col("img_y").alias("y"), F.lit(0).alias("kind"), F.col("img").alias("n"), F.lit(None).cast(both.schema["m"].dataType).alias("m"), "img"))
    page = Window.partitionBy("doc", "page").orderBy("y", "kind", "n")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    above, nth = F.last("m", ignorenulls=True).over(so_far), F.count("img").over(so_far)
    first = F.first("m", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = both.select("doc", "page", "img", F.col("y").alias("img_y"), "kind", F.coalesce(above, first).alias("o"), nth.alias("nth")).where("kind = 0 and o is not null")
    return rows.select("doc", "page", "img", "img_y", F.col("o.chunk_id").alias("chunk_id"), F.format_string("%s_p%d_%d", "doc", "page", "nth").alias("name"))


def tidy_path(c: Column) -> Column:
    """I6"""
    return F.regexp_replace(F.trim(F.replace(c, F.lit("\\"), F.lit("/"))), r"\A(\./)+", "")


def referenced(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The different image paths of chunks, and whether the file is there."""
    paths = chunks.select(F.explode("image_paths").alias("path")).select(tidy_path(F.col("path")).alias("path")).distinct()
    return paths.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def pending(paths: DataFrame, cache: DataFrame) -> DataFrame:
    """I8: paths without a caption that isn't the mark of a failure."""
    return paths.join(cache.where(F.col("caption") != FAILED), "path", "left_anti")


def caption(paths: DataFrame, captioner: Callable[[str], str], tries: int = 3, at_once: int | None = 2, wait: float = 5.0) -> DataFrame:
    """Captions by a given function; a failure is tried again after wait seconds, then twice that and so on; empty and failed ones are marked. at_once bounds the calls that run at a time.

    None leaves that to the partitions: files.write_through(), which keeps what is made part by part, has its own bound.
    """

    def one(path: str) -> str:
        for k in range(tries):
            try:
                return (captioner(path) or "").strip() or FAILED
            except Exception:  # the caller's function may fail in any way; the mark says so
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return FAILED

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "caption": [one(p) for p in batch["path"]]})

    narrow = paths.select("path")
    return (narrow.repartition(at_once) if at_once else narrow).mapInPandas(run, "path string, caption string")


def encoded(files: DataFrame, to_jpeg: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(path, base64) of image files (path, content) as JPEG. to_jpeg re-encodes an image; without it the bytes go as they are, which is right only for files that are JPEG."""
    if to_jpeg is None:
        return files.select("path", F.base64("content").alias("base64"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [to_jpeg(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary").select("path", F.base64("content").alias("base64"))


def inject(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Each good caption of a chunk's images, in order, on a line of its own after the text; missing ones are counted."""
    rows = chunks.select("chunk_id", F.posexplode("image_paths").alias("pos", "path")).join(cache, "path", "left")
    line = F.when(F.col("caption").isNotNull() & (F.col("caption") != FAILED), F.struct("pos", F.concat(F.lit(f"\n{MARK} "), "caption").alias("line")))
    got = rows.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "").alias("lines"), F.count_if(F.col("caption").isNull()).alias("missing"))
    return chunks.join(got, "chunk_id", "left").withColumn("text", F.concat("text", F.coalesce("lines", F.lit("")))).withColumn("missing", F.coalesce("missing", F.lit(0))).drop("lines")


def captions_of(c: Column) -> Column:
    """I12"""
    lines = F.filter(F.split(c, "\n"), lambda x: x.startswith(MARK))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"\A\[IMG_CAPTION\]\s*(.*)\z", 1))


def first_images(rows: DataFrame, limit: int = 5, files: DataFrame | None = None) -> DataFrame:
    """A group's different paths in order of first use, `limit` at most; with a listing of files, only those that exist count."""
    rows = rows.withColumn("path", F.trim("path")).where("path <> ''")
    if files is not None:
        rows = rows.join(files.select("path").distinct(), "path", "left_semi")
    first = rows.groupBy("id", "path").agg(F.min("pos").alias("pos"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("pos", "path"))).where(F.col("k") <= limit)
