"""From tables of contents to ordered, linked chunks. Windows are partitioned by manual; numbers and links of a large one are made part by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..functions import text as X
from ..sources.store import stored


def by(key: str = "doc", *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*(order or ("ord",)))


#: Rows of a manual that one task puts in order; a larger one is cut at CUTS places of its order.
ROWS_A_PART, CUTS = 200_000, 255


def in_order(rows: DataFrame, doc: str, order: list[str], columns: list[str]) -> DataFrame:
    """rows with `number` from 1 in a manual's order, and `before` and `after`, structs of the columns in the rows around each (null at the ends).

    Manuals are counted first, by a job of their own. If one has more than ROWS_A_PART rows, rows, which should be narrow, are stored, and such manuals cut into parts at places of their order, which must begin with a number
    for that: so their windows are many tasks; a second window, over a row a part, gives each part its start and the rows at its borders. Else a window a manual does.
    """
    told, name = F.struct(*columns), F.col(doc)
    numeric = isinstance(rows.schema[order[0]].dataType, T.NumericType)
    large = rows.groupBy(name.alias("__d")).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > ROWS_A_PART).select("__d")
    if not numeric or large.isEmpty():
        w = Window.partitionBy(doc).orderBy(*order)
        return rows.select("*", F.row_number().over(w).cast("long").alias("number"), F.lag(told).over(w).alias("before"), F.lead(told).over(w).alias("after"))

    rows, large = stored(rows, "places", narrow=True), stored(large, "large_manuals", narrow=True)
    places = F.percentile_approx(order[0], F.array(*[F.lit(k / (CUTS + 1)) for k in range(1, CUTS + 1)]), F.lit(20 * CUTS))
    cuts = rows.join(large, name.eqNullSafe(F.col("__d")), "left_semi").groupBy(name.alias("__d")).agg(F.array_distinct(places).alias("__cuts"))
    part = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(order[0]))))
    dealt = rows.join(cuts, name.eqNullSafe(F.col("__d")), "left").withColumn("__part", part).drop("__d", "__cuts")
    inside, place = Window.partitionBy(doc, "__part").orderBy(*order), F.struct(*order)
    here = dealt.select("*", F.row_number().over(inside).alias("__n"), F.lag(told).over(inside).alias("__lag"), F.lead(told).over(inside).alias("__lead"))
    ends = dealt.groupBy(name.alias("__d"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__size"), F.min_by(told, place).alias("__first"), F.max_by(told, place).alias("__last"))
    across = Window.partitionBy("__d").orderBy("__p")
    start = F.coalesce(F.sum("__size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("__d", "__p", "__size", start.alias("__start"), F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after"))
    met = here.join(ends, name.eqNullSafe(F.col("__d")) & (F.col("__part") == F.col("__p")))
    before, after = F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__lag")), F.when(F.col("__n") == F.col("__size"), F.col("__after")).otherwise(F.col("__lead"))
    return met.select(*rows.columns, (F.col("__start") + F.col("__n")).cast("long").alias("number"), before.alias("before"), after.alias("after"))


def collapse_bookmarks(toc: DataFrame) -> DataFrame:
    """Label entries go; of adjacent equal titles the one with the largest page stays, the later on ties."""
    kept = toc.where(~F.lower(X.collapse(F.col("title"))).isin(X.TOC_LABELS))
    new = F.lag("title").over(by()).isNull() | (F.lag("title").over(by()) != F.col("title"))
    islands = kept.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    best = islands.groupBy("doc", "island").agg(F.max_by(F.struct("ord", "level", "title", "page"), F.struct("page", "ord")).alias("e"))
    return best.select("doc", "e.*")


def toc_pages(pages: DataFrame, least_links: int = 5, scanned: int = 25) -> DataFrame:
    """From the first of the scanned pages with the keyword, the consecutive pages with enough links."""
    first = F.min(F.when(F.col("has_keyword") & (F.col("page") <= scanned), F.col("page"))).over(Window.partitionBy("doc"))
    after = pages.withColumn("first", first).where(F.col("page") >= F.col("first"))
    broken = F.min(F.when(F.col("links") < least_links, F.col("page"))).over(Window.partitionBy("doc"))
    return after.withColumn("broken", broken).where(F.col("broken").isNull() | (F.col("page") < F.col("broken"))).select("doc", "page", "links")


def link_entries(links: DataFrame) -> DataFrame:
    """Internal links as entries: 1-based page, clean title, indent rounded to tens (half to even)."""
    rows = links.where("target_page is not null").withColumn("title", X.clean_title(F.col("label"))).where("title <> ''")
    return rows.select("doc", "ord", "title", (F.col("target_page") + 1).alias("page"), (F.bround(F.col("x0") / 10) * 10).cast("int").alias("x0_bucket"))


def indent_levels(entries: DataFrame) -> DataFrame:
    """The rank of an entry's indent among its manual's, 3 at most."""
    return entries.withColumn("level", F.least(F.dense_rank().over(by("doc", "x0_bucket")), F.lit(3)))


def first_of(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """P5 and other dedups: the first row of each key in order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def with_fallback(bookmarks: DataFrame, links: DataFrame) -> DataFrame:
    """A manual's bookmarks, or its links where it has none; tagged with the source."""
    columns = ["doc", "ord", "level", "title", "page"]
    rest = links.join(bookmarks.select("doc").distinct(), "doc", "left_anti")
    return bookmarks.select(*columns, F.lit("bookmark").alias("source")).unionByName(rest.select(*columns, F.lit("links").alias("source")))


def fill_headings(toc: DataFrame) -> DataFrame:
    """Headings of levels 1 to 3 carried down; moving up clears the deeper ones."""
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    rows = toc.where("level <= 3").withColumn("i1", F.count_if(F.col("level") <= 1).over(upto)).withColumn("i2", F.count_if(F.col("level") <= 2).over(upto))
    last = lambda level, *keys: F.coalesce(F.last(F.when(F.col("level") == level, F.col("title")), ignorenulls=True).over(Window.partitionBy("doc", *keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)), F.lit(""))
    return rows.select("doc", "ord", "level", "page", last(1).alias("title_h1"), last(2, "i1").alias("title_h2"), last(3, "i2").alias("title_h3"))


def page_ranges(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """An entry ends on the next one's page (shared), inside the manual, not before its start."""
    narrow = in_order(rows.select("doc", "ord", "page"), "doc", ["ord"], ["page"]).join(totals, "doc")
    following = F.coalesce("after.page", F.col("total"))
    ends = narrow.select("doc", "ord", F.col("page").alias("page_start"), F.greatest("page", F.least(following, F.col("total"))).alias("page_end"))
    return _with(rows, ends, ["doc", "ord"])


def chain(rows: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """Ids `{doc}_{number}` in order, with those before and after. (doc, order) is a row's place, so no two rows share it."""
    ids = in_order(rows.select(doc, order), doc, [order], [order])
    name = lambda n: F.format_string("%s_%04d", F.col(doc), n)
    around = [F.when(F.col(side).isNotNull(), name(F.col("number") + step)).alias(f"{way}_chunk_id") for side, step, way in (("before", -1, "prev"), ("after", 1, "next"))]
    return _with(rows, ids.select(doc, order, name(F.col("number")).alias("chunk_id"), *around), [doc, order])


def _with(rows: DataFrame, narrow: DataFrame, keys: list[str]) -> DataFrame:
    """rows and the narrow columns of the same rows: windows sort ids alone, and wide columns meet them by a join that no hot manual makes uneven."""
    rest = [c for c in rows.columns if c in keys or c not in narrow.columns]
    return rows.select(*rest).join(narrow, keys) if set(rest) - set(keys) else narrow


def relink(rows: DataFrame, doc: str = "doc", *order: str) -> DataFrame:
    """The chain over the rows there are. rows are read twice, so what is dear to make should be stored before."""
    order = order or ("ord",)
    links = in_order(rows.select(doc, *order, "chunk_id"), doc, list(order), ["chunk_id"])
    return _with(rows, links.select(doc, *order, "chunk_id", *_links()), [doc, *order])


def _links() -> list[Column]:
    return [F.col("before.chunk_id").alias("prev_chunk_id"), F.col("after.chunk_id").alias("next_chunk_id")]


def chased(rows: DataFrame, gone: str, doc: str = "doc") -> DataFrame:
    """The rows that aren't gone, their links followed through rows that are. A link to an id that isn't there stays; one that never leaves a cycle is null.

    Pointers of gone rows are doubled: each round a pointer that lands on a gone row takes over that row's, so runs of n rows take log n joins.
    """
    out = rows.where(F.col(gone))
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.col(f"{k}_chunk_id").alias("to")) for k in ("prev", "next")]))
    jumps = stored(out.select(F.col(doc).alias("d"), F.col("chunk_id").alias("from"), ways.alias("w")).select("d", "from", "w.*"), "jumps")
    n = jumps.count()
    for _ in range(max(1, n).bit_length() + 1):
        landed = jumps.select(F.col("d").alias("d2"), F.col("way").alias("way2"), F.col("from").alias("at"), F.col("to").alias("on"))
        met = jumps.join(landed, (F.col("d") == F.col("d2")) & (F.col("way") == F.col("way2")) & (F.col("to") == F.col("at")), "left")
        if met.where("at is not null").isEmpty():
            break
        jumps = stored(met.select("d", "from", "way", F.when(F.col("at").isNull(), F.col("to")).otherwise(F.col("on")).alias("to")), "jumps")
    ids = out.select(F.col(doc).alias("d"), F.col("chunk_id").alias("to"), F.lit(True).alias("cyclic"))
    jumps = jumps.join(ids, ["d", "to"], "left").select("d", "from", "way", F.when(F.col("cyclic").isNull(), F.col("to")).alias("to"))
    narrow = rows.where(~F.col(gone)).select(doc, "chunk_id", "prev_chunk_id", "next_chunk_id")
    for way in ("prev", "next"):
        link, of = f"{way}_chunk_id", jumps.where(F.col("way") == way).select(F.col("d").alias(doc), F.col("from").alias(f"{way}_chunk_id"), "to", F.lit(True).alias("passed"))
        narrow = narrow.join(of, [doc, link], "left").withColumn(link, F.when(F.col("passed"), F.col("to")).otherwise(F.col(link))).drop("to", "passed")
    return _with(rows.where(~F.col(gone)), narrow, [doc, "chunk_id"])


def with_margins(manuals: DataFrame, margins: DataFrame, default: float = 55.0) -> DataFrame:
    """A manual's own margins, else those of the row `default`, else 55."""
    own = margins.where("name <> 'default'")
    fallback = margins.where("name = 'default'").agg(F.first("margin_top").alias("dt"), F.first("margin_bottom").alias("db"))
    joined = manuals.join(own, manuals["doc"] == own["name"], "left").join(F.broadcast(fallback))
    pick = lambda a, b: F.coalesce(a, b, F.lit(default)).alias(a)
    return joined.select("doc", pick("margin_top", "dt"), pick("margin_bottom", "db"))


def locate_titles(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """The line that holds the title (white space aside) and lies inside the margins, top and bottom: largest font, then highest; else the top margin."""
    l = lines.select("doc", "page", "y0", "y1", "size", X.squeeze(F.col("text")).alias("flat"))
    hit = titles.withColumn("want", X.squeeze(F.col("title"))).join(l, ["doc", "page"])
    hit = hit.where((F.col("y0") >= F.col("margin_top")) & (F.col("y1") <= F.col("height") - F.col("margin_bottom")) & F.col("flat").contains(F.col("want")))
    best = hit.groupBy("doc", "page", "title").agg(F.max(F.struct("size", -F.col("y0"))).alias("b")).select("doc", "page", "title", (-F.col("b.col2")).alias("found"))
    return titles.join(best, ["doc", "page", "title"], "left").select("doc", "page", "title", F.coalesce("found", "margin_top").cast("double").alias("y"))


def title_place(text: Column, title: Column) -> Column:
    """Where a title first begins in a text, white space in either aside; 0 if it doesn't occur."""
    letters = F.regexp_replace(X.squeeze(title), r"(?s)(.)", r"\\Q$1\\E\\s*")
    return F.regexp_instr(text, F.concat(F.lit("(?U)"), letters))


def fill_text(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of a chunk's pages inside the body, page by page: the first page's from its title's place, the last one's up to the next title's.

    chunks: doc, chunk_id, title, page_start, page_end, y_start, y_end (null: to the body's end), margin_top, body_bottom. A first page's text is cut from the title's
    first occurrence; a title that isn't in it leaves nothing of the page. Pages of a chunk are exploded, so chunks and lines meet by an equi-join on (doc, page).
    """
    pages = chunks.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    top = F.greatest("margin_top", F.when(F.col("page") == F.col("page_start"), F.col("y_start")).otherwise(F.col("margin_top")))
    cut = (F.col("page") == F.col("page_end")) & F.col("y_end").isNotNull()
    bottom = F.when(cut, F.greatest(top, F.least("y_end", "body_bottom") - 0.5)).otherwise(F.col("body_bottom"))
    inside = pages.join(lines, ["doc", "page"]).where((F.col("y0") >= top) & (F.col("y1") <= bottom))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda s: s["text"]), "\n")
    texts = inside.groupBy("doc", "chunk_id", "page", "page_start", "title").agg(said.alias("t")).withColumn("t", X.strip(F.col("t")))
    titled = (F.col("page") == F.col("page_start")) & (X.squeeze(F.col("title")) != "")
    at = title_place(F.col("t"), F.col("title"))
    texts = texts.withColumn("t", F.when(~titled, F.col("t")).when(at > 0, X.strip(F.substr("t", at))).otherwise("")).where("t <> ''")
    out = texts.groupBy("doc", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda s: s["t"]), "\n").alias("text"))
    return chunks.select("doc", "chunk_id").join(out, ["doc", "chunk_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _left_linked(chunks: DataFrame, narrow: DataFrame) -> DataFrame:
    """The chunks whose place (doc, ord) narrow still has, linked anew; narrow: doc, ord, chunk_id."""
    return _with(chunks, in_order(narrow.select("doc", "ord", "chunk_id"), "doc", ["ord"], ["chunk_id"]).select("doc", "ord", "chunk_id", *_links()), ["doc", "ord"])


def _said(name: str) -> Column:
    return X.strip(F.coalesce(F.col(name), F.lit("")))


def drop_stubs(chunks: DataFrame, longest: int = 120, lines: int = 3) -> DataFrame:
    """A short text without a third heading goes if the next chunk begins on its page; the rest is linked anew. Space around texts and headings doesn't count, nulls are empty."""
    text = _said("text")
    short = (_said("title_h3") == "") & (F.length(text) <= longest) & (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < lines)
    narrow = in_order(chunks.select("doc", "ord", "chunk_id", "page_start", short.alias("short")), "doc", ["ord"], ["page_start"])
    narrow = narrow.withColumn("stub", F.coalesce(F.col("short") & (F.col("after.page_start") == F.col("page_start")), F.lit(False)))
    return _left_linked(chunks, narrow.where("not stub"))


def drop_title_only(chunks: DataFrame) -> DataFrame:
    """A text that says nothing but one of its titles goes; the rest is linked anew. A blank text stays."""
    text = _said("text")
    same = lambda h: (X.collapse(text) == X.collapse(h)) | (X.squeeze(text) == X.squeeze(h))
    only = F.exists(F.filter(F.array(*[_said(f"title_h{k}") for k in (1, 2, 3)]), lambda h: h != ""), same) & (text != "")
    return _left_linked(chunks, chunks.select("doc", "ord", "chunk_id", only.alias("only")).where("not only"))


def drop_empty(chunks: DataFrame) -> DataFrame:
    """P18"""
    return chunks.where(_said("text") != "")


def leaf_title(h1: Column, h2: Column, h3: Column) -> Column:
    """The deepest title that isn't blank, without space around it."""
    return F.coalesce(*[F.nullif(X.strip(h), F.lit("")) for h in (h3, h2, h1)], F.lit(""))


def merge_titles(chunks: DataFrame) -> DataFrame:
    """P20: chunks of one leaf title (runs of space alike) become one, at the place and with the attributes of the first, blank texts left out; untitled ones stay, and so does the text of a title that stands alone."""
    rows = chunks.withColumn("leaf", X.collapse(leaf_title(F.col("title_h1"), F.col("title_h2"), F.col("title_h3"))))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    titled = rows.where("leaf <> ''").groupBy("doc", "leaf").agg(
        F.min("ord").alias("ord"), F.min_by("chunk_id", "ord").alias("chunk_id"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), texts.alias("texts"),
    )
    joined = F.array_join(F.filter(F.transform("texts", X.strip), lambda t: t != ""), "\n\n")
    titled = titled.withColumn("text", F.when(F.size("texts") > 1, joined).otherwise(F.get("texts", F.lit(0))))
    columns = ["doc", "ord", "chunk_id", "page_start", "page_end", "text"]
    return titled.select(*columns).unionByName(rows.where("leaf = ''").select(*columns))
