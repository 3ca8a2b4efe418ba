"""Stored indexes and the searches that read only what they need of them.

Both are dealt to folders by manual, so that questions about some manuals open those folders alone. Postings lie in blocks that know how much a text of theirs could score at most;
vectors lie in cells around centres. A search first reads what is likely best, which gives each question a floor, and then only blocks or cells that could still pass it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.store import stored
from .retrieval import PREFETCH, QUERIES_AT_ONCE, VECTORS_AT_ONCE, blocks_of, counted_terms, scan, solid, top, unit

#: Folders that manuals are dealt to, postings of a block at most (about), different manuals that a batch may ask for before its filter becomes a join.
PARTS, BLOCK, ASKED = 32, 128, 2000
#: Tasks that a folder's blocks may be dealt to.
LANES = 16
#: Cells are about the root of the number of vectors, up to CELLS; their centres come from at most SAMPLE vectors.
CELLS, SAMPLE, ROUNDS, PROBES = 1024, 40_000, 8, 8


def part_of(grp: Column, parts: int = PARTS) -> Column:
    """The folder of a manual."""
    return F.pmod(F.xxhash64(F.coalesce(grp.cast("string"), F.lit(""))), F.lit(parts)).cast("int")


def by_manual(rows: DataFrame, tag: str, *order: str, ranged: bool = True) -> DataFrame:
    """rows (with grp) stored in folders by manual, in order inside. ranged: files and row groups hold ranges of it, for which rows are sampled first; else, for rows that are dear to make, a folder's rows go to as many tasks as adaptive execution finds even."""
    parts = rows.withColumn("part", part_of(F.col("grp")))
    dealt = parts.repartitionByRange("part", *order) if ranged else parts.hint("rebalance", F.col("part"))
    return stored(dealt.sortWithinPartitions("part", *order), tag, by="part")


def of_manuals(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of an index whose manual is among wanted (column wanted, nulls aside). Up to ASKED manuals the filter is a list, which opens their folders alone; beyond, a join."""
    asked = [r[0] for r in wanted.where("wanted is not null").select("wanted").distinct().limit(ASKED + 1).collect()]
    if len(asked) > ASKED:
        return index.join(wanted.select(F.col("wanted").alias("grp")).distinct(), "grp", "left_semi")
    return pruned(index, asked)


def pruned(index: DataFrame, asked: list) -> DataFrame:
    kept = index.where(F.col("grp").isin(asked))
    # of literals, so it is a constant by the time folders are listed
    return kept.where(F.col("part").isin(*[part_of(F.lit(g)) for g in asked])) if "part" in index.columns and asked else kept


def weighed(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """E3 with a text's length as a vector of its terms' counts: (key, grp, norm, term, weight). rows: key, text, grp. The length is found inside a row, so postings are shuffled once."""
    sorted_terms = F.array_sort(X.terms(F.col(text)))
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(t == s["last"], s["run"]).otherwise(0)  # (run + 1)^2 - run^2 is 2 run + 1
        return F.struct(t.alias("last"), (run + 1).alias("run"), (s["total"] + 2 * run + 1).alias("total"))

    counted = rows.select(F.col(key).alias("id"), F.col("grp"), sorted_terms.alias("t")).withColumn("norm", F.sqrt(F.aggregate("t", start, step, lambda s: s["total"])))
    return counted.select("id", "grp", "norm", F.explode("t").alias("term")).groupBy("id", "grp", "norm", "term").agg(F.count(F.lit(1)).alias("weight"))


def block_index(rows: DataFrame, key: str = "chunk_id", text: str = "text", tag: str = "blocks") -> DataFrame:
    """Postings of rows (key, text, grp) in blocks (grp, term, level, norm, n, has array<struct<id, weight>>), stored by manual in term order.

    A block holds a term's postings of texts of one manual, one level and one slot. Levels are quarter powers of two of the texts' lengths, norm the largest length in the block; slots deal a manual's
    texts of a level by a hash, about BLOCK to each, so no block grows with a term's frequency.
    """
    norm = F.sqrt(F.aggregate("weights", F.lit(0).cast("long"), lambda n, w: n + w * w))
    texts = counted_terms(rows.select(F.col(key).alias("id"), F.col(text).alias("text"), "grp"), "id").where(F.size("terms") > 0).withColumn("norm", norm)
    texts = stored(texts.withColumn("level", F.floor(4 * F.log2("norm")).cast("int")).withColumn("part", part_of(F.col("grp"))), "weighed")
    # a row a manual and level, stored so that its size is known and texts don't move to meet it
    sizes = stored(texts.groupBy(F.col("grp").alias("g"), F.col("level").alias("l")).agg(F.approx_count_distinct("id").alias("texts")), "levels")
    slot = F.pmod(F.xxhash64("id"), F.ceil(F.col("texts") / BLOCK))
    dealt = texts.join(sizes, F.col("grp").eqNullSafe(F.col("g")) & (F.col("level") == F.col("l"))).select("part", "grp", "level", slot.alias("slot"), "norm", "id", "terms", "weights")
    # texts of a slot go to one task whole, a folder's to LANES of them, so their postings need no further shuffle
    dealt = dealt.withColumn("lane", F.pmod(F.xxhash64("level", "slot"), F.lit(LANES))).repartition("part", "lane")
    one = dealt.select("part", "lane", "grp", "level", "slot", "norm", "id", F.explode(F.arrays_zip("terms", "weights")).alias("p"))
    made = one.groupBy("part", "lane", "grp", F.col("p.terms").alias("term"), "level", "slot").agg(F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id", F.col("p.weights").alias("weight"))).alias("has"))
    return stored(made.select("grp", "term", "level", "norm", "n", "has", "part").sortWithinPartitions("part", "term", "level"), tag, by="part")


def _met(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of the questions' terms. A question with a manual meets that manual's alone, read from its folder; one without meets all."""
    q = queries.select("query_id", "term", F.col("weight").alias("qw"), "wanted")
    q = q.join(q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("length")), "query_id")
    q = stored(q, "asked_terms", narrow=True)  # of known size, so that blocks don't move to meet a few questions
    free = blocks.join(q.where("wanted is null").drop("wanted"), "term")
    some = q.where("wanted is not null")
    bound = of_manuals(blocks, some).join(some.withColumnRenamed("wanted", "grp"), ["term", "grp"])
    columns = ["query_id", "term", "qw", "length", "level", "norm", "n", "has"]
    return free.select(*columns).unionByName(bound.select(*columns))


def _scores(met: DataFrame, k: int) -> DataFrame:
    scored = met.select("query_id", "qw", F.inline("has")).groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    return top(scored, ["query_id"], k, F.col("score").desc(), F.col("id"))


def block_passes(queries: DataFrame, blocks: DataFrame, k: int = PREFETCH) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What block_top_k does: the blocks of its first pass, the best of them, the blocks of its second pass, and all that the questions' terms have (query_id, term, n, ...)."""
    met = _met(queries, blocks)
    # texts of a level that some term of the question has, at least; the levels from the highest down that hold k of them are read first
    had = met.groupBy("query_id", "term", "level").agg(F.sum("n").alias("n")).groupBy("query_id", "level").agg(F.max("n").alias("n"))
    down = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0))
    levels = had.withColumn("so_far", down).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("so_far") >= k, F.col("level"))), F.min("level")).alias("first"))
    levels = stored(levels, "first_levels", narrow=True)
    first = met.join(levels, "query_id").where(F.col("level") >= F.col("first"))
    best = stored(_scores(first, k), "first_best", narrow=True)
    floors = stored(levels.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "query_id", "left"), "floors", narrow=True)
    # a text scores its length times the question's at most; the margin covers the rounding of both
    reach = F.col("length") * F.col("norm") * (1 + 1e-9) >= F.coalesce("floor", F.lit(0))
    return first, best, met.join(floors, "query_id").where((F.col("level") < F.col("first")) & reach), met


def block_top_k(queries: DataFrame, blocks: DataFrame, k: int = PREFETCH) -> DataFrame:
    """(query_id, id, score, rank) by dot product over shared terms, the same rows as a full read gives. queries: query_id, term, weight, wanted (a manual, or null for all).

    A text's terms all lie in blocks of its level. The highest levels that hold k texts of a term of the question are read whole, which gives their texts' scores and a floor, the k-th of them; of
    the lower ones only blocks whose longest text could reach the floor.
    """
    _, best, rest, _ = block_passes(queries, blocks, k)
    both = best.select("query_id", "id", "score").unionByName(_scores(rest, k).select("query_id", "id", "score"))
    return top(both, ["query_id"], k, F.col("score").desc(), F.col("id"))


@dataclass
class Cells:
    """Vectors (cell, id, v, grp) in folders by cell, the cells' centres, and the least cosine of a vector of each cell to its centre."""

    vectors: DataFrame
    centres: np.ndarray
    least: np.ndarray


def centres_of(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit vectors, by rounds of assignment and mean from spread-out starts; a centre without vectors stays."""
    rng = np.random.default_rng(1)
    c = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(vectors @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
    return c


def cell_index(vectors: DataFrame, rows: int, cells: int | None = None, sample: int = SAMPLE, tag: str = "cells") -> Cells:
    """R2: an inverted file of vectors (id, vector, grp): each goes to the nearest of the centres, which a bounded sample gives. rows: about how many there are.

    Null, zero and non-finite vectors, and those of another width than the sample's first, aren't in it. An empty table gives an index without cells.
    """
    v = vectors.select("id", F.col("vector").cast("array<double>").alias("v"), "grp").where(solid("v"))
    drawn = [r["v"] for r in v.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()]
    width = len(drawn[0]) if drawn else 0
    v = v.where(F.size("v") == width)
    made = centres_of(unit(np.array([d for d in drawn if len(d) == width])), cells or min(CELLS, max(1, math.isqrt(rows)))) if drawn else np.zeros((0, 0))
    schema = "cell int, cosine double, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, VECTORS_AT_ONCE):
                batch = whole.slice(k, VECTORS_AT_ONCE)
                near = unit(np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, width)) @ made.T
                of = np.argmax(near, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(near[np.arange(len(of)), of]), *batch.columns], ["cell", "cosine", "id", "v", "grp"])

    told = stored(v.mapInArrow(run, schema).repartition("cell").sortWithinPartitions("cell"), tag, by="cell")
    least = np.ones(len(made))
    for r in told.groupBy("cell").agg(F.min("cosine").alias("least")).collect():  # a row a cell
        least[r["cell"]] = r["least"]
    return Cells(told.select("cell", "id", "v", "grp"), made, least)


def _reachable(q: np.ndarray, index: Cells, floor: np.ndarray) -> np.ndarray:
    """Of each question and cell, whether a vector of the cell could have the floor's cosine: not if the cell lies farther off than its own radius and the floor's angle together."""
    angle = np.arccos(np.clip(q @ index.centres.T, -1, 1)) - np.arccos(np.clip(index.least, -1, 1))[None, :]
    return np.cos(np.maximum(angle, 0)) >= floor[:, None] - 1e-6  # scores are rounded to six digits


def cell_top_k(queries: DataFrame, index: Cells, k: int = PREFETCH, probes: int = PROBES, exact: bool = False, seen: Callable[[int, int], None] | None = None) -> DataFrame:
    """R2: (query_id, id, score, rank) by cosine as dense_top_k gives it, from each question's nearest `probes` cells only; exact: and then from all cells that could hold a vector better than the k-th so far.

    queries: query_id, qv, wanted (filtered before the top k; null: all). Questions are taken QUERIES_AT_ONCE at a time, one after another; a pass opens the folders of its questions' cells alone, and only a
    task's best k are shuffled. seen(cells opened, cells) is called for each pass.
    """
    width = index.centres.shape[1] if index.centres.size else 0
    q = queries.select(F.col("query_id").cast("long"), F.col("qv").cast("array<double>"), "wanted").where(solid("qv") & (F.size("qv") == width))
    out: DataFrame | None = None

    def one(asked: list[Row], allowed: np.ndarray) -> DataFrame:
        opened = np.flatnonzero(allowed.any(axis=0))
        if seen:
            seen(len(opened), allowed.shape[1])
        found = scan(asked, index.vectors.where(F.col("cell").isin(opened.tolist())), k, allowed)
        return stored(top(found, ["query_id"], k, F.col("score").desc(), F.col("id")), "found", narrow=True)

    for asked in blocks_of(q, QUERIES_AT_ONCE):
        x = unit(np.array([r["qv"] for r in asked], dtype=float))
        near = x @ index.centres.T
        allowed = np.zeros(near.shape, bool)
        np.put_along_axis(allowed, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
        found = one(asked, allowed)
        if exact:
            kth = {r["query_id"]: r["score"] for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}  # a number a question of the block
            more = _reachable(x, index, np.array([kth.get(r["query_id"], -2.0) for r in asked])) & ~allowed
            if more.any():
                found = found.unionByName(one(asked, more))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.vectors.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return top(out.drop("rank"), ["query_id"], k, F.col("score").desc(), F.col("id"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answer's rows (query_id, id) that were found; 1 if there are none."""
    n, hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count(F.lit(1)), F.count("hit")).first()
    return hit / n if n else 1.0
