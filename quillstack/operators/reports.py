"""Statistics, evaluation, sampling, pipeline state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .images import FAILED, captions_of, tidy_path
from .normalise import STEP, splitters
from .retrieval import crop


def token_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """A1: per group and over all (group null): exact percentiles, interpolated."""
    p = lambda q: F.percentile(value, F.lit(q))
    aggs = [F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(p(0.5), 4).alias("median"), F.round(F.avg(value), 4).alias("mean"), F.round(p(0.25), 4).alias("p25"), F.round(p(0.75), 4).alias("p75")]
    return rows.groupingSets([[F.col(group)], []], F.col(group)).agg(*aggs)


BUCKETS = ["<100", "100-200", "200-500", "500-800", ">800"]


def bucket(n: Column) -> Column:
    """A2"""
    return F.when(n < 100, BUCKETS[0]).when(n < 200, BUCKETS[1]).when(n < 500, BUCKETS[2]).when(n <= 800, BUCKETS[3]).otherwise(BUCKETS[4])


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """A2: every bucket with its count and share, empty ones too."""
    counts = rows.groupBy(bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    joined = every.join(F.broadcast(counts), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return joined.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def outliers(rows: DataFrame, value: str, low: int = 100, high: int = 800) -> DataFrame:
    """A3"""
    side = F.when(F.col(value) < low, "small").when(F.col(value) > high, "large")
    return rows.withColumn("side", side).where("side is not null").withColumn("preview", X.preview(F.col("text")))


def large_structure(rows: DataFrame, most: int = 800, examples: int = 5, counts: X.Counts | None = None) -> DataFrame:
    """A4: paragraphs, lines and first step lines of large texts, and whether paragraphs alone would split them."""
    big = rows.withColumn("n_tokens", X.count_of(F.col("text"), counts)).where(F.col("n_tokens") > most)
    parts = X.counts_of(splitters(F.col("text"))["paragraph"], counts)
    steps = F.transform(F.slice(F.filter(X.lines(F.col("text")), lambda x: x.rlike("(?U)" + STEP)), 1, examples), X.strip)
    big = big.withColumn("__p", parts).withColumn("paragraphs", F.size("__p")).withColumn("longest", F.array_max("__p")).withColumn("lines", F.size(X.lines(F.col("text")))).withColumn("steps", steps)
    return big.withColumn("splittable", F.coalesce(F.col("longest") < most, F.lit(False))).drop("__p")


def splittable_share(structure: DataFrame, group: str) -> DataFrame:
    """A4: large texts of each group, those that paragraphs split, and their share in percent."""
    g = structure.groupBy(group).agg(F.count(F.lit(1)).alias("large"), F.count_if("splittable").alias("splittable"))
    return g.withColumn("percent", F.round(100 * F.col("splittable") / F.col("large"), 2))


def splitter_report(rows: DataFrame, ways: dict[str, Column], least: int = 800, counts: X.Counts | None = None) -> DataFrame:
    """A5: of texts above `least` tokens, each way's pieces, largest and mean, and the share of texts all of whose pieces fit; ranked by share, then mean largest."""
    large = rows.where(X.count_of(F.col("text"), counts) > least)
    sizes = [F.struct(F.lit(k).alias("method"), X.counts_of(v, counts).alias("sizes")) for k, v in ways.items()]
    long = large.select(F.explode(F.array(*sizes)).alias("m")).select("m.method", F.size("m.sizes").alias("pieces"), F.coalesce(F.array_max("m.sizes"), F.lit(0)).alias("longest"))
    fits = (F.col("pieces") > 0) & (F.col("longest") < least)
    got = long.groupBy("method").agg(F.sum("pieces").alias("pieces"), F.max("longest").alias("longest"), F.round(F.avg("longest"), 4).alias("mean_longest"), F.round(100 * F.count_if(fits) / F.count(F.lit(1)), 4).alias("effective"))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.col("effective").desc(), "mean_longest", "method")))


#: Tokens that an image costs, and dollars a million of them.
TOKENS_AN_IMAGE, DOLLARS_A_MILLION = 300, 0.15


def file_stats(files: DataFrame, small: int = 50) -> DataFrame:
    """Totals, size buckets, images under `small` pixels either way, different hashes and paths, and what describing each different image costs. files: bytes, hash, path, width, height."""
    kb = F.col("bytes") / 1024
    tidy = F.lower(F.regexp_replace(F.trim(F.replace("path", F.lit("\\"), F.lit("/"))), r"\A\./", ""))
    got = files.agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(kb < 5).alias("small"), F.count_if((kb >= 5) & (kb <= 50)).alias("middle"), F.count_if(kb > 50).alias("large"),
        F.count_if((F.col("width") < small) | (F.col("height") < small)).alias("tiny"), F.countDistinct("hash").alias("hashes"), F.countDistinct(tidy).alias("paths"),
    )
    tokens = F.col("hashes") * TOKENS_AN_IMAGE
    return got.withColumn("image_tokens", tokens).withColumn("dollars", F.round(tokens / 1e6 * DOLLARS_A_MILLION, 6))


def font_sizes(spans: DataFrame, shown: int = 5, longest: int = 40) -> DataFrame:
    """Spans of each size (hundredths, half to even) and the manual's median; of sizes above it the first five texts, cut short, and whether each is bold (16 in its flags)."""
    s = spans.withColumn("text", X.collapse(F.col("text"))).where("text <> ''").withColumn("size", F.bround("size", 2))
    cut = F.when(F.length("text") <= longest, F.col("text")).otherwise(F.concat(F.substring("text", 1, longest - 3), F.lit("...")))
    first = s.select("doc", "size", cut.alias("text"), (F.col("flags").bitwiseAND(F.lit(16)) != 0).alias("bold"), F.row_number().over(Window.partitionBy("doc", "size").orderBy("ord")).alias("k")).where(F.col("k") <= shown)
    first = first.groupBy("doc", "size").agg(F.array_sort(F.collect_list(F.struct("k", "text", "bold"))).alias("samples"))
    sizes = s.groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_seen")).join(first, ["doc", "size"])
    sizes = sizes.join(s.groupBy("doc").agg(F.percentile("size", F.lit(0.5)).alias("median")), "doc")
    return sizes.withColumn("samples", F.when(F.col("size") > F.col("median"), F.col("samples")))


def heading_sizes(sizes: DataFrame, least: int = 10) -> DataFrame:
    """The body's size is the most frequent (first seen on ties); the three largest above it are headings."""
    some = sizes.where(F.col("n") >= least)
    body = some.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("first_seen"))).alias("body"))
    rows = some.join(body, "doc").where(F.col("size") > F.col("body"))
    return rows.withColumn("level", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.col("size").desc()))).where("level <= 3").select("doc", "body", "level", "size")


def heading_settings(sizes: DataFrame, least: int = 10) -> DataFrame:
    """A row a manual, its body size and the least size of each heading level (a point under it), and a row `default` with the medians of all manuals."""
    some = sizes.where(F.col("n") >= least)
    bodies = some.groupBy("doc").agg(F.round(F.max_by("size", F.struct("n", -F.col("first_seen"))), 2).alias("body"))
    levels = heading_sizes(sizes, least).groupBy("doc").agg(*[F.max(F.when(F.col("level") == k, F.round(F.col("size") - 1.0, 2))).alias(f"h{k}_min") for k in (1, 2, 3)])
    own = bodies.join(levels, "doc", "left").select("doc", "body", "h1_min", "h2_min", "h3_min")
    default = own.agg(*[F.round(F.percentile(c, F.lit(0.5)), 2).alias(c) for c in ("body", "h1_min", "h2_min", "h3_min")]).where("body is not null")
    return own.unionByName(default.withColumn("doc", F.lit("default")))


def link_kinds(links: DataFrame, scanned: int = 15) -> DataFrame:
    """Links on contents pages among a manual's first `scanned` pages: all, those to a page that is there, to none, to addresses, others; a row a page, and one a manual (page null)."""
    rows = links.where(F.col("has_keyword") & (F.col("page") <= scanned))
    goto, uri = F.col("kind") == "goto", F.col("kind") == "uri"
    counts = {"links": F.lit(True), "goto_with_page": goto & F.col("target_page").isNotNull(), "goto_without_page": goto & F.col("target_page").isNull(), "uri": uri, "other": ~goto & ~uri}
    return rows.groupingSets([["doc", "page"], ["doc"]], "doc", "page").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def span_widths(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """Of each manual the chunks, the widest span of pages and its first chunk, the last chunk's width, and the pages after the last start."""
    width = F.col("page_end") - F.col("page_start")
    got = chunks.groupBy("doc").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(width).alias("widest"), F.min_by("ord", F.struct(-width, "ord")).alias("widest_at"), F.max_by(width, "ord").alias("last_width"),
        F.max("page_start").alias("last_start"), F.countDistinct("page_start").alias("different_starts"),
    )
    return got.join(totals, "doc").withColumn("pages_after", F.col("total") - F.col("last_start")).drop("total", "last_start")


def toc_summary(toc: DataFrame, shown: int = 10, longest: int = 60) -> DataFrame:
    """A10: of each manual and source the entries, the deepest level and the first entries, a line each, long titles cut. shown = 20 is the dump of bookmarks or links."""
    title = F.when(F.length("title") <= longest, F.col("title")).otherwise(F.concat(F.substring("title", 1, longest - 3), F.lit("...")))
    line = F.format_string("[H%d] %s -> p.%d", F.col("level"), title, F.col("page"))
    first = F.when(F.col("__k") <= shown, F.struct("__k", line.alias("line")))
    rows = toc.withColumn("__k", F.row_number().over(Window.partitionBy("doc", "source").orderBy("ord")))
    return rows.groupBy("doc", "source").agg(F.count(F.lit(1)).alias("entries"), F.max("level").alias("deepest"), F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda s: s["line"]), "\n").alias("first"))


def match_rectangles(blocks: DataFrame, placements: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Blocks of a page from its top (y0, id) each take the nearest placement left, no corner farther than the tolerance (ties: the smaller id); one that is taken is gone.

    Grid cells of four times the tolerance turn the theta join into an equi-join on cells, each block probing the one to four cells that it can reach. What is near goes to its page's task once. The taking
    is a fold over the blocks of a page that have any placement near.
    """
    size, reach = 4 * tolerance, tolerance + 1e-6  # distances are rounded to six digits
    cell = lambda c: F.floor(c / size)
    probed = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    probes = blocks.withColumn("cx", probed("x0")).withColumn("cy", probed("y0"))
    table = placements.select("doc", "page", cell(F.col("x0")).alias("cx"), cell(F.col("y0")).alias("cy"), F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"o_{c}")) for c in ("x0", "y0", "x1", "y1")])
    hit = probes.join(table, ["doc", "page", "cx", "cy"]).withColumn("far", F.round(far, 6)).where(F.col("far") <= tolerance)
    hit = hit.select("doc", "page", "id", "y0", "far", "other").repartition("doc", "page")
    own = hit.groupBy("doc", "page", "id", "y0").agg(F.array_sort(F.collect_list(F.struct("far", "other"))).alias("near"))
    page = own.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "id", "near"))).alias("b"))
    match = f"array<struct<id:{blocks.schema['id'].dataType.simpleString()},far:double,other:{placements.schema['id'].dataType.simpleString()}>>"

    def take(done: Column, block: Column) -> Column:
        best = F.get(F.filter(block["near"], lambda p: ~F.exists(done, lambda d: d["other"] == p["other"])), F.lit(0))
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(F.struct(block["id"].alias("id"), best["far"].alias("far"), best["other"].alias("other")))))

    return page.select("doc", "page", F.explode(F.aggregate("b", F.array().cast(match), take)).alias("m")).select("doc", "page", "m.*")


def page_dump(blocks: DataFrame, images: DataFrame, longest: int = 40) -> DataFrame:
    """A page's blocks (kind text or image) from the top, a line each, its image blocks, the images that the page lists, and whether the two counts agree."""
    text = X.collapse(F.coalesce("text", F.lit("")))
    short = F.when(F.length(text) <= longest, text).otherwise(F.concat(F.substring(text, 1, longest - 3), F.lit("...")))
    line = F.concat(F.lit("["), F.upper("kind"), F.format_string("] y0=%.1f y1=%.1f", F.col("y0"), F.col("y1")), F.when(F.col("kind") == "text", F.concat(F.lit(" | "), short)).otherwise(""))
    g = blocks.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "id", line.alias("line")))), lambda s: s["line"]), "\n").alias("dump"), F.count_if(F.col("kind") == "image").alias("image_blocks"))
    listed = images.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("listed"))
    return g.join(listed, ["doc", "page"], "left").withColumn("listed", F.coalesce("listed", F.lit(0))).withColumn("agree", F.col("image_blocks") == F.col("listed"))


def hit_ranks(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """V1: the first place of a right answer, null if there is none."""
    hit = ranked.join(truth, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return truth.select("query_id").distinct().join(hit, "query_id", "left")


def judged(questions: DataFrame, ranked: DataFrame, ranks: DataFrame, n: int, least: float) -> DataFrame:
    """V2: questions (query_id, in_scope) with hit_rank and passed: a hit in the first n, or, out of scope, nothing found or a best score under `least`."""
    best = ranked.where("rank = 1").select("query_id", "score")
    rows = questions.join(ranks, "query_id", "left").join(best, "query_id", "left")
    rejected = F.col("score").isNull() | (F.col("score") < least)
    return rows.withColumn("passed", F.when(F.col("in_scope"), F.coalesce(F.col("hit_rank") <= n, F.lit(False))).otherwise(rejected))


def hit_rate(rows: DataFrame, seconds: str | None = None) -> DataFrame:
    """V2: totals of judged() by class, hit and reject rates; with a column of seconds also their sum, mean and the slowest question (ties: the last by id)."""
    inside, passed = F.col("in_scope"), F.col("passed")
    counts = {"questions": F.lit(True), "passed": passed, "failed": ~passed, "in_scope": inside, "hits": inside & passed, "misses": inside & ~passed, "out_of_scope": ~inside, "rejected": ~inside & passed, "accepted": ~inside & ~passed}
    rate = lambda part, whole: F.round(F.try_divide(F.count_if(part), F.count_if(whole)), 6)
    aggs = [*[F.count_if(c).alias(n) for n, c in counts.items()], rate(inside & passed, inside).alias("hit_rate"), rate(~inside & passed, ~inside).alias("reject_rate")]
    if seconds is not None:
        aggs += [F.round(F.sum(seconds), 3).alias("seconds"), F.round(F.avg(seconds), 4).alias("mean_seconds"), F.max_by("query_id", F.struct(seconds, "query_id")).alias("slowest"), F.max(seconds).alias("slowest_seconds")]
    return rows.agg(*aggs)


def chain_report(chunks: DataFrame) -> DataFrame:
    """V3: per manual heads, tails and links that don't exist or don't point back."""
    ids = chunks.select("doc", F.col("chunk_id").alias("o"), F.col("prev_chunk_id").alias("op"), F.col("next_chunk_id").alias("on"))
    nxt = chunks.join(ids.select("doc", F.col("o").alias("next_chunk_id"), F.col("op").alias("back"), F.lit(1).alias("has_next")), ["doc", "next_chunk_id"], "left")
    both = nxt.join(ids.select("doc", F.col("o").alias("prev_chunk_id"), F.col("on").alias("forth"), F.lit(1).alias("has_prev")), ["doc", "prev_chunk_id"], "left")
    wrong = lambda link, there, back: F.col(link).isNotNull() & (F.col(there).isNull() | ~F.col(back).eqNullSafe(F.col("chunk_id")))
    return both.groupBy("doc").agg(F.count_if(F.col("prev_chunk_id").isNull()).alias("heads"), F.count_if(F.col("next_chunk_id").isNull()).alias("tails"), F.sum(wrong("next_chunk_id", "has_next", "back").cast("long") + wrong("prev_chunk_id", "has_prev", "forth").cast("long")).alias("broken"))


def missing_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """V4"""
    empty = lambda f: F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")
    return rows.agg(*[F.count_if(empty(f)).alias(f) for f in fields])


def coverage(disk: DataFrame, used: DataFrame, least: float = 0.95) -> DataFrame:
    """V5: files referenced, orphans, references without a file, and whether enough is covered (an empty disk is)."""
    a, b = disk.select("path").distinct().withColumn("d", F.lit(1)), used.select("path").distinct().withColumn("u", F.lit(1))
    got = a.join(b, "path", "full").agg(F.count("d").alias("files"), F.count_if(F.col("d").isNotNull() & F.col("u").isNotNull()).alias("covered"), F.count_if(F.col("u").isNull()).alias("orphans"), F.count_if(F.col("d").isNull()).alias("missing"))
    return got.withColumn("passed", F.when(F.col("files") == 0, True).otherwise(F.col("covered") / F.col("files") > least))


def caption_coverage(chunks: DataFrame, cache: DataFrame, before: DataFrame, covered: float = 0.9, failed: float = 0.1) -> DataFrame:
    """V6: chunks with images and with captions in their text, different images, cached and failed captions, rows before and after and manuals where these differ, and the three rules.

    chunks, before: doc; chunks also image_paths and text; cache: path, caption.
    """
    has, told = F.size("image_paths") > 0, F.size(captions_of(F.col("text"))) > 0
    totals = chunks.agg(F.count_if(has).alias("with_images"), F.count_if(told).alias("with_captions"))
    images = chunks.select(F.explode("image_paths").alias("p")).select(tidy_path(F.col("p")).alias("p")).agg(F.countDistinct("p").alias("images"))
    kept = cache.agg(F.count(F.lit(1)).alias("cached"), F.count_if(F.col("caption") == FAILED).alias("failed"))
    count = lambda df, n: df.groupBy("doc").agg(F.count(F.lit(1)).alias(n))
    rows = count(chunks, "a").join(count(before, "b"), "doc", "full").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("manuals_differ"))
    got = totals.join(F.broadcast(images)).join(F.broadcast(kept)).join(F.broadcast(rows))  # a row each
    got = got.withColumn("covered_enough", F.coalesce(F.try_divide("with_captions", "with_images") > covered, F.lit(False)))
    return got.withColumn("few_failed", (F.col("images") > 0) & (F.col("failed") < F.col("images") * failed)).withColumn("same_rows", F.col("manuals_differ") == 0)


def run_summary(runs: DataFrame) -> DataFrame:
    """V7: per type; blank types are `unknown`."""
    kind = F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("unknown"))
    return runs.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.round(F.avg("cost"), 6).alias("mean_cost"), F.sum("tokens").alias("tokens"))


def budget_stats(rows: DataFrame, budget: int) -> DataFrame:
    """V9: texts cut by a budget, tokens and characters removed (against the cropped text)."""
    sized = rows.select("text", X.token_count(F.col("text")).alias("n"))
    over = F.greatest(F.col("n") - budget, F.lit(0))
    chars = F.when(F.col("n") > budget, F.length("text") - F.length(crop(F.col("text"), budget))).otherwise(0)
    return sized.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > budget).alias("touched"), F.sum(over).alias("removed"), F.sum(chars).alias("removed_chars"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.15, price_out: float = 0.60) -> Column:
    """V8"""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def lot(key: Column, seed: int) -> Column:
    """A row's place in a seeded drawing; md5, so that any engine draws the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """M1: n rows, drawn by lot."""
    return rows.orderBy(lot(F.col(key), seed), key).limit(n)


def quota_sample(rows: DataFrame, group: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """M2: equal quotas, the remainder to the first groups; places that small groups leave go to others by lot."""
    g = rows.select(group).distinct()
    groups = g.withColumn("__g", F.row_number().over(Window.orderBy(group))).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()))
    groups = groups.withColumn("__quota", F.floor(F.lit(total) / F.col("__m")) + (F.col("__g") <= total % F.col("__m")).cast("int"))
    h = lot(F.col(key), seed)
    ranked = rows.join(groups, group).withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(h, key)))
    # only `total` rows of each group can be wanted at all, so the last ordering sees few
    few = ranked.where(F.col("__k") <= total).withColumn("__extra", F.col("__k") > F.col("__quota"))
    return few.orderBy("__extra", h, key).limit(total).drop("__g", "__m", "__quota", "__k", "__extra")


def first_per_group(rows: DataFrame, group: str, order: str, k: int, total: int) -> DataFrame:
    """M4"""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("k") <= k).orderBy(group, order).limit(total)


def stratified_sample(rows: DataFrame, total: int = 13, least_chars: int = 150, seed: int = 42) -> DataFrame:
    """M3: long enough texts, groups of three or more first, two of a group at most, unseen second titles first, by lot."""
    h = lot(F.col("id"), seed)
    some = rows.where(F.length("text") >= least_chars).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("title_h1")))
    some = some.withColumn("seen", F.row_number().over(Window.partitionBy("title_h1", "title_h2").orderBy(h, "id")))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("title_h1").orderBy(F.col("seen") > 1, h, "id"))).where("k <= 2")
    return some.orderBy(F.col("size") < 3, "k", h, "id").limit(total).drop("size", "seen", "k")


def stages_to_run(plan: DataFrame, state: DataFrame, restart_from: int | None = None) -> DataFrame:
    """Stages (doc, stage, ord) that aren't done with an artifact there, and all from the one to restart from."""
    rows = plan.join(state.select("doc", "stage", "done", "artifact"), ["doc", "stage"], "left")
    skip = F.coalesce(F.col("done") & F.col("artifact"), F.lit(False))
    if restart_from is not None:
        skip = skip & (F.col("ord") < restart_from)
    return rows.where(~skip).select("doc", "stage", "ord")


def unite_feedback(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Both logs in one schema; positive and up are one, negative and down."""
    both = v1.unionByName(v2, allowMissingColumns=True)
    return both.withColumn("feedback", F.when(F.col("feedback").isin("positive", "up"), "up").when(F.col("feedback").isin("negative", "down"), "down"))
