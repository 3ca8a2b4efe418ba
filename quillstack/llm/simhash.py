"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints at 3 or fewer differing bits have a segment at 1 or
fewer, so each segment's table is probed with the small Hamming ball of radius 1 around the segment; matches are verified on
all 64 bits. Of two segments that differ in one bit one has a 0 there, so only flips of 0 to 1 are probed: a pair is still met.

Buckets that hold many different fingerprints would give pairs in the square of their size. There the other segment decides:
for members of one bucket, the points at 1 bit or less around each member's other segment (2 or less for the wider reach) are
keys, and every key links its members to its smallest one. All those links are true links (1+1, 1+2 bits), every true link has
such a key, and the rows grow with the members, not with their pairs. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, slices, stored, table

SEED, WORDS, RADIUS = 42, 3, 3
#: Different fingerprints with one segment in common from which the links are found by keys, not by pairs.
CROWDED = 24
_OFFSETS = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of `words` words with repeats."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    shingles = iter([b" ".join(w)]) if len(w) <= words else map(b" ".join, zip(*(islice(w, i, None) for i in range(words)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=max(1, len(w) - words + 1))
    ones = np.zeros((8, 256), dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.bincount((part + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (ones @ _BITS).ravel() * 2 > len(h)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, row): fp is the fingerprint as a signed long, row a hash of the text. Null and empty texts, and texts of white space only, get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(x or b"", words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), batch.column(2)], ["id", "fp", "row"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("b"), F.xxhash64(text_col).alias("row"))
    return source.mapInArrow(run, "id long, fp long, row long")


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if k else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _flips(value: Column) -> Column:
    """The 32-bit values with one 0 bit of value set."""
    bits = F.array(*[F.lit(1 << i) for i in range(32)])
    return F.transform(F.filter(bits, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m))


def _ball(value: Column, radius: int) -> Column:
    """The 32-bit values at `radius` or fewer differing bits of value (radius 0, 1 or 2)."""
    masks = [0] + [1 << i for i in range(32)] * (radius > 0) + [(1 << i) | (1 << j) for i in range(32) for j in range(i)] * (radius > 1)
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, nodes: int, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between the different fingerprints of column fp whose closure is that of all pairs at RADIUS bits or less.

    The merge hints keep Spark from broadcasting sides whose size it guesses from before they are exploded.
    """
    tables = [fps.select(F.lit(k).alias("seg"), _half(F.col("fp"), k).alias("key"), _half(F.col("fp"), 1 - k).alias("other"), "fp") for k in (0, 1)]
    entries = tables[0].unionByName(tables[1])
    full = stored(entries.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("seg", "key"), "crowded", nodes // crowded if crowded else nodes)
    sparse = entries.join(full, ["seg", "key"], "left_anti")
    probes = entries.select("seg", F.explode(F.concat(F.array("key"), _flips(F.col("key")))).alias("key"), F.col("key").alias("own"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS
    pairs = probes.join(sparse.hint("merge"), ["seg", "key"]).where(near & ((F.col("own") != F.col("key")) | (F.col("a") < F.col("fp")))).select("a", F.col("fp").alias("b"))

    def by_keys(centres: DataFrame, rest: DataFrame) -> DataFrame:
        """Each key (seg, key, point) links the members that hold it to its smallest centre."""
        least = centres.groupBy("seg", "key", "point").agg(F.min("fp").alias("b"))
        members = centres.unionByName(rest)
        return members.join(least.hint("merge"), ["seg", "key", "point"]).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()

    dense = stored(entries.join(full, ["seg", "key"], "left_semi"), "dense", 2 * nodes)
    spread = lambda df, r: df.select("seg", "key", F.explode(_ball(F.col("other"), r)).alias("point"), "fp")
    inside = by_keys(spread(dense, 1), spread(dense, 2))
    visitors = probes.where(F.col("own") != F.col("key")).join(full, ["seg", "key"], "left_semi").select("seg", "key", "a")
    visitors = visitors.select("seg", "key", F.explode(_ball(F.when(F.col("seg") == 0, _half(F.col("a"), 1)).otherwise(_half(F.col("a"), 0)), 1)).alias("point"), F.col("a").alias("fp"))
    return pairs.unionByName(inside).unionByName(by_keys(spread(dense, 1), visitors))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, row, component): a row per row of docs; component is the smallest id reachable over links of RADIUS bits or less.

    Exact copies share a fingerprint and are one node. An empty table gives an empty one. Rows with a null id take part in no
    component (component null). Only the id and text columns are read, so other columns may have any name.
    """
    fps = stored(fingerprints(docs, id_col, text_col, words), "fingerprints", narrow=True)
    n = fps.count()
    nodes = stored(fps.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("least")), "nodes", n)
    # components() names a component by its least fingerprint; its least document is found over the nodes
    joined = components(stored(links(nodes.select("fp"), n), "links", n), "a", "b", n).withColumnsRenamed({"node": "fp"})
    of = nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("least").alias("first"))
    of = of.join(least, "component").select("fp", "first")
    return fps.join(of, "fp", "left").select("id", "fp", "row", F.when(F.col("id").isNotNull(), F.col("first")).alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id (of several, that of the least text hash). Rows with a null id stay.

    An empty table gives an empty one; texts of any length are read whole. docs' columns travel as one struct, so they may have any name.
    """
    found = near_duplicates(docs, id_col, text_col).where(F.col("id") == F.col("component"))
    kept = found.groupBy(F.col("id").alias("kept")).agg(F.min("row").alias("first"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("own_row"))
    first = keyed.where(F.col("own").isNotNull()).join(kept, (F.col("own") == F.col("kept")) & (F.col("own_row") == F.col("first")), "left_semi").dropDuplicates(["own", "own_row"])
    return first.unionByName(keyed.where(F.col("own").isNull())).select("doc.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
