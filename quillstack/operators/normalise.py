"""Cleaning and splitting chunks by token budget. `counts` is how tokens are counted (N1): None by a pattern, or text.model_counts() of a tokenizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.store import stored
from .structure import chased, relink

LEAST, MOST, TARGET = 20, 3500, 1500


def garbage(chunks: DataFrame, least: int = LEAST, counts: X.Counts | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by tokens. N3: the kept ones' own links are followed past removed chunks where they have any, else they are linked in order."""
    rows = stored(chunks.withColumn("n_tokens", X.count_of(F.col("text"), counts)), "counted")
    gone = F.col("n_tokens") < least
    kept = chased(rows.withColumn("__gone", gone), "__gone").drop("__gone") if {"prev_chunk_id", "next_chunk_id"} <= set(rows.columns) else relink(rows.where(~gone))
    return kept, rows.where(gone)


def packed(parts: Column, target: int = TARGET, counts: X.Counts | None = None) -> Column:
    """Parts joined greedily: a new piece begins when the current one isn't empty and the next part would pass the target.

    Each part is counted once, before; the rest is a fold over one text's counts, so it needs no shuffle. It carries only the places of the cuts, so it is linear in the text.
    """
    sizes = X.counts_of(parts, counts)
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(s: Column, n: Column) -> Column:
        full = (s["n"] > 0) & (s["n"] + n > target)
        return F.struct(F.when(full, F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]).alias("cuts"), F.when(full, n).otherwise(s["n"] + n).alias("n"), (s["i"] + 1).alias("i"))

    def pieces(s: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), s["cuts"], F.array(s["i"]))
        between = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: X.strip(F.array_join(F.slice(parts, a + 1, b - a), "")))
        return F.filter(between, lambda p: p != "")

    return F.aggregate(sizes, start, step, pieces)


def split_large(chunks: DataFrame, most: int = MOST, target: int = TARGET, counts: X.Counts | None = None) -> DataFrame:
    """Chunks above `most` tokens become parts with their data and a split_group_id, be it one; all are linked anew in order (ord, part).

    The parts are stored, so that the links are made of ids alone and texts are met again by an even join.
    """
    large = X.count_of(F.col("text"), counts) > most
    rows = chunks.withColumn("__s", F.when(large, X.sentences(F.col("text"))))
    pieces = F.when(F.col("__s").isNotNull(), packed(F.col("__s"), target, counts)).otherwise(F.array("text"))
    rows = rows.select("*", F.posexplode(pieces).alias("part", "piece")).withColumn("split_group_id", F.when(F.col("__s").isNotNull(), F.col("chunk_id"))).withColumn("text", F.col("piece"))
    part_id = F.concat("chunk_id", F.lit("_part"), F.col("part").cast("string"))
    rows = rows.withColumn("chunk_id", F.when(F.col("__s").isNotNull(), part_id).otherwise(F.col("chunk_id"))).drop("__s", "piece", "prev_chunk_id", "next_chunk_id")
    return relink(stored(rows, "parts"), "doc", "ord", "part")


def split_audit(rows: DataFrame, counts: X.Counts | None = None) -> DataFrame:
    """Pieces of each split chunk and their tokens in order."""
    g = rows.where("split_group_id is not null").select("split_group_id", "part", X.count_of(F.col("text"), counts).alias("n")).groupBy("split_group_id")
    return g.agg(F.count(F.lit(1)).alias("pieces"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda s: s["n"].cast("string")), ",").alias("tokens"))


#: What begins a step, a title and a list line, and where a sentence ends.
STEP = r"^\s*(?:\d+[\.、]|步骤\s*\d+)"
TITLE = r"^\s*(?:第[一二三四五六七八九十0-9]+[章节部分]|[0-9]+(?:\.[0-9]+){1,3})"
LIST = r"^\s*(?:[-•●]|[（(]?[0-9一二三四五六七八九十]+[)）])"
SENTENCE_END = r"(?<=[。！？!?；;])\s+"


def blocks(text: Column, *starts: str) -> Column:
    """Lines grouped so that each line that begins as one of `starts` opens a block: one scan that cuts at the line ends before such lines."""
    ahead = "|".join(s.removeprefix("^").replace(r"\s", r"[^\S\n]") for s in starts)
    return F.split(F.array_join(X.lines(text), "\n"), rf"(?U)\n(?={ahead})")


def splitters(text: Column) -> dict[str, Column]:
    """Five ways to split a text; parts are stripped, blank ones dropped."""
    solid = lambda parts: F.filter(F.transform(parts, X.strip), lambda p: p != "")
    text = F.coalesce(text, F.lit(""))
    return {
        "paragraph": solid(F.split(text, r"\n\n")), "line": solid(F.split(text, r"\n")), "step": solid(blocks(text, STEP)), "title_list": solid(blocks(text, TITLE, LIST)),
        "sentence": solid(F.split(F.translate(text, "\n", " "), "(?U)" + SENTENCE_END)),
    }


def affected_links(rows: DataFrame, least: int = LEAST, counts: X.Counts | None = None) -> DataFrame:
    """The different (kept before, kept after) around removed chunks."""
    r = rows.select("doc", "ord", "chunk_id", (X.count_of(F.col("text"), counts) < least).alias("gone"))
    w = Window.partitionBy("doc").orderBy("ord")
    before = F.last(F.when(~F.col("gone"), F.col("chunk_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the last one in reverse order: a frame to the end would be gone through anew for each row
    back = Window.partitionBy("doc").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(~F.col("gone"), F.col("chunk_id")), ignorenulls=True).over(back)
    return r.withColumn("prev_kept", F.coalesce(before, F.lit(""))).withColumn("next_kept", F.coalesce(after, F.lit(""))).where("gone").select("prev_kept", "next_kept").distinct()
