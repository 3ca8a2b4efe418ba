"""Mixing sources to target weights.

Each source's words, its documents laid end to end, are cut into blocks of a fixed length. The mix is a row of slots in output
shards; each shard draws its sources from a multinomial over the target shares (one pseudorandom draw a slot), and the slots of a source,
counted through all shards, are mapped to block indexes by pseudorandom permutations of that source's own, a new one for each pass. Blocks are joined by index.
Where the draws give a source more slots than its target needs, the last ones stay empty; where they give fewer, a settling
shard adds them. The last slot of a source is cut so that its words meet the target to the word; no block comes more often than passes do.

All of it is DataFrame expressions. Only (id, source, size) is shuffled. Offsets inside a source come from two-level sums, and slots and
blocks join by (source, block), so that a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_start, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Words in a block, slots in an output shard.
BLOCK, SHARD, SEED = 64, 4096, 7
#: Rounds of a permutation; slots that a task fills.
ROUNDS, SLOTS_A_TASK = 24, 100_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds `target` to (source, source_size): weight shares of `share` times all sizes, none above `most` times its source's size.

    Sources in code point order, null last, take the weights in turn. Water filling in closed form: sorted by size/weight, the
    sources that stop are a prefix; level c solves sum(min(most*size, c*weight)) = share*total. If all stop, all have `most` times.
    The windows see one row a source, and sources are names, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    s = s.withColumn("want", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("stopped", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("want") - F.col("stopped")) / F.col("weight_left"))
    # the level that holds is that of the first source in order that doesn't stop at it
    s = s.withColumn("level", F.min(F.when(F.col("limit") >= F.col("level") * F.col("w"), F.struct(F.col("limit") / F.col("w"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w"))).alias("target"))


def permuted(index: Column, size: Column, key: list[Column], inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. size-1, chosen by key, or its inverse, by swap-or-not rounds.

    A round pairs x with (k - x) mod size and swaps the pair if a hash of its larger member says so; each is its own inverse.
    """
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def swap_or_not(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), i, *key), size) - x, size)
        return F.when(F.xxhash64(F.greatest(x, other), i, *key).bitwiseAND(F.lit(1)) == 0, x).otherwise(other)

    return F.aggregate(rounds, index.cast("long"), swap_or_not)


def _drawn(sources: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """(shard, sid, n): each output shard's multinomial counts. A slot's draw meets its source by an equi-join on a grid over the shares."""
    grid = 4 * n_sources + 1024
    order = Window.orderBy("sid")
    s = sources.select("sid", (F.sum("target").over(order) / F.sum("target").over(Window.partitionBy())).alias("hi"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn("hi", F.when(F.lead("hi").over(order).isNull(), 2.0).otherwise(F.col("hi")))
    cells = s.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.floor(F.least("hi", F.lit(1.0)) * grid))).alias("cell"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("id")), 11) / F.lit(float(1 << 53))).alias("u")
    slots = sources.sparkSession.range(n_slots).select((F.col("id") / SHARD).cast("long").alias("shard"), draw).withColumn("cell", F.floor(F.col("u") * grid))
    hit = slots.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return hit.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def mix(sizes: DataFrame, keys: list[str], block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, taken) for rows of (keys, source, size).

    documents: keys, size, sid, start (words of the source before it). sources: sid, source, source_size, target.
    taken: a row per filled slot: shard (null: settled afterwards), sid, pass, block, words (its first words, all of them but in a source's last slot).
    Documents of no words have no block. Sources of no words have target 0. Equal rows count one by one.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    sources = stored(targets(per_source, weights, share, most).withColumn("sid", F.row_number().over(order)), "sources")
    n_sources, words = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    named = sources.select(F.col("source").alias("__s"), "sid")
    docs = sizes.join(named, F.col("source").eqNullSafe(F.col("__s"))).select(*keys, "size", "sid")
    docs = stored(running_start(docs, ["sid"], [*keys, "size"], "size", "start"), "offsets", sizes.count())

    whole = sources.where(F.col("source_size") > 0).select("sid", "source_size", F.floor(F.col("target") + 0.5).cast("long").alias("goal"))
    whole = whole.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("last", F.col("source_size") - (F.col("blocks") - 1) * block)
    whole = whole.withColumn("need", F.floor(F.col("goal") / F.col("source_size")) * F.col("blocks") + F.ceil(F.pmod("goal", "source_size") / block) + 1)
    counts = running_start(_drawn(sources, math.ceil(words / block), n_sources), ["sid"], ["shard"], "n", "first") if words else None
    if counts is None:
        counts = sources.sparkSession.createDataFrame([], "shard long, sid int, n long, first long")
    counts = stored(counts, "draws", math.ceil(words / block / SHARD) * n_sources)
    short = whole.select("sid", "need").join(counts.groupBy("sid").agg(F.sum("n").alias("first")), "sid", "left")
    short = short.select(F.lit(None).cast("long").alias("shard"), "sid", (F.col("need") - F.coalesce("first", F.lit(0))).alias("n"), F.coalesce("first", F.lit(0)).alias("first"))
    # what is missing is dealt out in rows of a shard's length, so that no row makes more slots than that
    short = short.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SHARD).cast("int"))))
    short = short.select("shard", "sid", F.least(F.lit(SHARD), F.col("n") - F.col("k") * SHARD).alias("n"), (F.col("first") + F.col("k") * SHARD).alias("first"))
    # dealt to as many tasks as the slots call for: these rows are few, but each makes many
    dealt = counts.select("shard", "sid", "n", "first").unionByName(short).repartition(max(1, math.ceil(words / block / SLOTS_A_TASK)), "shard", "sid", "first")
    slots = dealt.join(whole, "sid")
    slots = slots.select("shard", "sid", "source_size", "goal", "blocks", "last", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    slots = slots.withColumn("pass", F.floor(F.col("j") / F.col("blocks"))).withColumn("at", F.pmod("j", "blocks"))
    chosen = [F.col("sid"), F.col("pass")]
    slots = slots.withColumn("block", permuted(F.col("at"), F.col("blocks"), chosen))
    passes = whole.select("sid", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("need") / F.col("blocks")))).alias("pass"), "blocks")
    slots = slots.join(passes.select("sid", "pass", permuted(F.col("blocks") - 1, F.col("blocks"), chosen, inverse=True).alias("last_at")), ["sid", "pass"])
    before = F.col("pass") * F.col("source_size") + F.col("at") * block - F.when(F.col("at") > F.col("last_at"), block - F.col("last")).otherwise(0)
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last")).otherwise(block)
    taken = slots.select("shard", "sid", "pass", "block", F.least(length, F.col("goal") - before).alias("words")).where(F.col("words") > 0)
    return docs, sources, taken


def overlaps(docs: DataFrame, taken: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, size, sid, start, pass, lo, hi): the words lo .. hi-1 of a document that a filled slot takes; pass null where none takes any."""
    pieces = docs.where("size > 0").select(*keys, "size", "sid", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    joined = pieces.join(taken.select("sid", "pass", "block", "words"), ["sid", "block"], "left")
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
    return joined.select(*keys, "size", "sid", "start", F.when(hi > lo, F.col("pass")).alias("pass"), lo.alias("lo"), hi.alias("hi"))


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row of docs; null texts have size 0.

    A null source is a source; equal rows, and rows with a null id, count one by one; an empty table gives an empty one. Only the three named columns are
    read, so others may have any name. Texts of any length are counted whole; a document's words may lie in many blocks.
    """
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), "sizes", narrow=True)
    dealt, sources, taken = mix(sizes, ["id"])
    some = overlaps(dealt, taken, ["id"]).groupBy("id", "size", "sid", "start").agg(F.sum(F.when(F.col("pass").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0)).alias("taken"))
    none = dealt.where("size = 0").select("id", "size", "sid", "start", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).join(sources, "sid").select("id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of docs' columns: a row per document and pass that takes of it, its text the words taken (white space kept).

    A row that is taken whole keeps its text as it is; n_chars, where there is one, is set anew. Documents of no words are part of no mix, so an empty table gives an empty one.
    Equal rows are dealt one by one. docs' columns travel as one struct, so they may have any name.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    sizes = stored(docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), "sizes", narrow=True)
    dealt, _, taken = mix(sizes, ["id", "row"])
    parts = overlaps(dealt, taken, ["id", "row"]).where(F.col("pass").isNotNull())
    parts = parts.groupBy("id", "row", "size", "sid", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
    parts = parts.select("id", "row", "ranges", (F.col("got") == F.col("size")).alias("whole"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("own"), row.alias("own_row")).dropDuplicates(["own", "own_row"])
    joined = keyed.join(parts, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_row") == F.col("row"))).select("doc", "ranges", "whole")
    text = F.col(f"doc.`{text_col}`")
    joined = joined.withColumn("words", F.when(~F.col("whole"), F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))))
    cut = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(F.col("words"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), "")
    joined = joined.withColumn("taken", F.when(F.col("whole"), text).otherwise(cut))
    made = {text_col: F.col("taken")} | ({"n_chars": F.length("taken").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
