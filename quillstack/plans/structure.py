"""Queries on structure and images. The TOC is made of parts, page lines and boxes of line items, links of page anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import images as I
from ..operators import structure as S
from ..sources.files import table

TOC = """toc AS (SELECT p_brand AS doc, CAST(p_partkey AS BIGINT) AS ord, CAST(1 + p_partkey % 4 AS INTEGER) AS level,
  CASE WHEN p_partkey % 17 = 0 THEN ' Contents ' ELSE 'Section ' || CAST(p_size % 3 AS VARCHAR) END AS title, CAST(1 + floor(p_partkey / 7) AS BIGINT) AS page FROM part)"""
LINES = """lines AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc, CAST(l_orderkey % 9 AS BIGINT) AS page, l_extendedprice % 800 AS y0, l_extendedprice % 800 + 10 AS y1, l_discount * 100 AS size,
  l_returnflag || ' ' || l_linestatus || ' ' || CAST(l_linenumber AS VARCHAR) AS text, l_quantity AS x0, l_orderkey * 10 + l_linenumber AS box FROM lineitem)"""
HEADS = """h AS (SELECT *, count(*) FILTER (level <= 1) OVER w AS i1, count(*) FILTER (level <= 2) OVER w AS i2 FROM toc WHERE level <= 3 WINDOW w AS (PARTITION BY doc ORDER BY ord)),
filled AS (SELECT doc, ord, level, page,
  coalesce(last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord), '') AS title_h1,
  coalesce(last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc, i1 ORDER BY ord), '') AS title_h2,
  coalesce(last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER (PARTITION BY doc, i2 ORDER BY ord), '') AS title_h3 FROM h)"""
CHUNKS = """chunks AS (SELECT doc_id AS ord, source AS doc, lang, text, n_chars, printf('%s_%04d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS chunk_id FROM documents)"""
QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def toc(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 17 == 0, " Contents ").otherwise(F.concat(F.lit("Section "), (F.col("p_size") % 3).cast("string")))
    return table(spark, d, "part").select(F.col("p_brand").alias("doc"), k.alias("ord"), (1 + k % 4).cast("int").alias("level"), title.alias("title"), (1 + F.floor(k / 7)).alias("page"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("l_extendedprice") % 800
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc"), (F.col("l_orderkey") % 9).alias("page"), y.alias("y0"), (y + 10).alias("y1"), (F.col("l_discount") * 100).alias("size"), text.alias("text"), F.col("l_quantity").alias("x0"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("doc"), "lang", "text", "n_chars")
    return S.chain(rows)


def filled(spark: SparkSession, d: str) -> DataFrame:
    rows = S.page_ranges(S.fill_headings(toc(spark, d)), toc(spark, d).groupBy("doc").agg(F.max("page").alias("total")))
    return S.chain(rows).withColumn("text", F.concat_ws(" ", "title_h1", "title_h2", "title_h3"))


FILLED = f"""{TOC}, {HEADS}, t AS (SELECT doc, max(page) AS total FROM toc GROUP BY doc),
full_chunks AS (SELECT f.doc, ord, level, title_h1, title_h2, title_h3, page AS page_start, greatest(page, least(coalesce(lead(page) OVER w, total), total)) AS page_end,
  printf('%s_%04d', f.doc, row_number() OVER w) AS chunk_id, concat_ws(' ', title_h1, title_h2, title_h3) AS text FROM filled f JOIN t ON f.doc = t.doc WINDOW w AS (PARTITION BY f.doc ORDER BY ord))"""


@query("p1_collapse_bookmarks", f"""WITH {TOC}, k AS (SELECT * FROM toc WHERE lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) NOT IN ('目录', 'contents', 'content')),
l AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY doc ORDER BY ord) = title THEN 0 ELSE 1 END AS new FROM k), i AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY ord) AS island FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, island ORDER BY page DESC, ord DESC) AS k FROM i) SELECT doc, ord, level, title, page FROM r WHERE k = 1""")
def p1(spark, d):
    return S.collapse_bookmarks(toc(spark, d))


@query("p2_toc_pages", f"""WITH p AS (SELECT CAST(page_id % 5 AS BIGINT) AS doc, CAST(floor(page_id / 5) AS BIGINT) AS page, contains(html, 'ad 1') AS has_keyword, CAST(len(regexp_extract_all(html, '<a href')) AS INTEGER) AS links FROM pages),
f AS (SELECT *, min(CASE WHEN has_keyword AND page <= 25 THEN page END) OVER (PARTITION BY doc) AS first FROM p), a AS (SELECT * FROM f WHERE page >= first),
b AS (SELECT *, min(CASE WHEN links < 5 THEN page END) OVER (PARTITION BY doc) AS broken FROM a) SELECT doc, page, links FROM b WHERE broken IS NULL OR page < broken""")
def p2(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 5).alias("doc"), F.floor(F.col("page_id") / 5).alias("page"), F.col("html").contains("ad 1").alias("has_keyword"), F.regexp_count("html", F.lit("<a href")).alias("links"))
    return S.toc_pages(p)


ANCHORS = r"""a AS (SELECT page_id AS doc, unnest(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1), 1) AS k FROM pages),
e0 AS (SELECT doc, CAST(k - 1 AS INTEGER) AS ord, trim(regexp_replace(trim(regexp_replace(label, '\s+', ' ', 'g')), '[\d\s.。…]+$', '')) AS title, CAST(k + 4 AS INTEGER) AS page, CAST(round_even((length(label) * 3.0) / 10, 0) * 10 AS INTEGER) AS x0_bucket FROM a),
e AS (SELECT * FROM e0 WHERE title <> '')"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a href="/[^"]*">([^<]*)</a>'), F.lit(1))
    rows = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.posexplode(found).alias("ord", "label"))
    return S.link_entries(rows.withColumn("target_page", F.col("ord") + 4).withColumn("x0", F.length("label") * 3.0))


@query("p3_link_entries", f"WITH {ANCHORS} SELECT * FROM e")
def p3(spark, d):
    return entries(spark, d)


@query("p4_indent_levels", f"WITH {ANCHORS} SELECT *, CAST(least(dense_rank() OVER (PARTITION BY doc ORDER BY x0_bucket), 3) AS INTEGER) AS level FROM e")
def p4(spark, d):
    return S.indent_levels(entries(spark, d))


@query("p5_dedup_entries", f"WITH {TOC}, r AS (SELECT *, row_number() OVER (PARTITION BY title, page ORDER BY ord) AS k FROM toc) SELECT doc, ord, level, title, page FROM r WHERE k = 1")
def p5(spark, d):
    return S.first_of(toc(spark, d), ["title", "page"], "ord")


@query("p6_clean_titles", r"""SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1) || ' ... 12', '\s+', ' ', 'g')), '[\d\s.。…]+$', '')) AS title FROM pages""")
def p6(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_title(F.concat(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" ... 12"))).alias("title"))


@query("p7_source_fallback", f"""WITH {TOC}, b AS (SELECT * FROM toc WHERE level <= 2 AND doc <> 'Brand#1' AND right(doc, 1) <> '3'), l AS (SELECT * FROM toc WHERE level > 2)
SELECT *, 'bookmark' AS source FROM b UNION ALL SELECT *, 'links' AS source FROM l WHERE doc NOT IN (SELECT doc FROM b)""")
def p7(spark, d):
    t = toc(spark, d)
    return S.with_fallback(t.where("level <= 2 and doc <> 'Brand#1' and right(doc, 1) <> '3'"), t.where("level > 2"))


@query("p8_fill_headings", f"WITH {TOC}, {HEADS} SELECT * FROM filled")
def p8(spark, d):
    return S.fill_headings(toc(spark, d))


@query("p9_page_ranges", f"WITH {FILLED} SELECT doc, ord, page_start, page_end FROM full_chunks")
def p9(spark, d):
    return filled(spark, d).select("doc", "ord", "page_start", "page_end")


@query("p10_chain", f"WITH {CHUNKS} SELECT doc, ord, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY doc ORDER BY ord)")
def p10(spark, d):
    return chunks(spark, d).select("doc", "ord", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query("p11_slugs", r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '.v2.pdf' WHEN 1 THEN '雷电 手册-_' || chr(97 * CAST(p_partkey % 2 AS INTEGER) + 38647 * CAST(1 - p_partkey % 2 AS INTEGER)) || '.pdf' ELSE ' . .pdf' END AS name FROM part),
m AS (SELECT p_partkey, name, left(name, length(name) - 4) AS stem FROM n)
SELECT p_partkey, coalesce(nullif(regexp_replace(lower(stem), '[^a-z0-9]', '', 'g'), ''), nullif(regexp_replace(stem, '[\\/:*?"<>|\s.]+', '', 'g'), ''), 'pdf_' || substr(sha256(name), 1, 12)) AS slug FROM m""")
def p11(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(".v2.pdf"))).when(k % 3 == 1, F.concat(F.lit("雷电 手册-_"), F.when(k % 2 == 1, "a").otherwise("雷"), F.lit(".pdf"))).otherwise(" . .pdf")
    return table(spark, d, "part").select("p_partkey", X.slug(name).alias("slug"))


@query("p12_margins", """WITH m AS (SELECT DISTINCT n_name AS doc FROM nation), o AS (SELECT r_name AS name, CAST(40 + r_regionkey AS DOUBLE) AS margin_top, CAST(NULL AS DOUBLE) AS margin_bottom FROM region UNION ALL SELECT n_name, 30.0, 31.0 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'default', 50.0, NULL)
SELECT doc, coalesce(o.margin_top, 50.0) AS margin_top, coalesce(o.margin_bottom, 55.0) AS margin_bottom FROM m LEFT JOIN o ON m.doc = o.name""")
def p12(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    null = F.lit(None).cast("double")
    own = region.select(F.col("r_name").alias("name"), (F.lit(40.0) + F.col("r_regionkey")).alias("margin_top"), null.alias("margin_bottom"))
    own = own.unionByName(nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(30.0).alias("margin_top"), F.lit(31.0).alias("margin_bottom")))
    own = own.unionByName(spark.range(1).select(F.lit("default").alias("name"), F.lit(50.0).alias("margin_top"), null.alias("margin_bottom")))
    return S.with_margins(nation.select(F.col("n_name").alias("doc")).distinct(), own)


TITLES = """titles AS (SELECT DISTINCT doc, page, CASE WHEN page % 2 = 0 THEN 'A F' ELSE 'N  O 4' END AS title FROM lines)"""


def titles(spark, d):
    t = F.when(F.col("page") % 2 == 0, "A F").otherwise("N  O 4")
    return lines(spark, d).select("doc", "page", t.alias("title"), F.lit(55.0).alias("margin_top"), F.lit(55.0).alias("margin_bottom"), F.lit(800.0).alias("height")).distinct()


LOCATED = f"""WITH {LINES}, {TITLES}, hit AS (SELECT t.doc, t.page, title, y0, row_number() OVER (PARTITION BY t.doc, t.page, title ORDER BY size DESC, y0) AS k FROM titles t JOIN lines l ON t.doc = l.doc AND t.page = l.page
WHERE y0 >= 55 AND y1 <= 745 AND contains(replace(text, ' ', ''), replace(title, ' ', '')))"""


@query("p13_locate_titles", LOCATED + "SELECT t.doc, t.page, t.title, coalesce(y0, 55.0) AS y FROM titles t LEFT JOIN hit h ON t.doc = h.doc AND t.page = h.page AND k = 1")
def p13(spark, d):
    return S.locate_titles(titles(spark, d), lines(spark, d))


SPANS = """c AS (SELECT doc, doc || '_' || CAST(floor(page / 2) AS BIGINT) AS chunk_id, CAST(floor(page / 2) AS BIGINT) % 2 AS odd, min(page) AS page_start, max(page) AS page_end, 60.0 AS y_start, CASE WHEN floor(page / 2) = 1 THEN 600.0 END AS y_end FROM lines GROUP BY ALL)"""


def spans(spark, d):
    k = F.floor(F.col("page") / 2)
    rows = lines(spark, d).groupBy("doc", F.concat_ws("_", "doc", k).alias("chunk_id"), k.alias("k")).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    title = F.when(F.col("k") % 2 == 0, "A F").otherwise("N  O 4 R")
    return rows.withColumn("title", title).withColumn("y_start", F.lit(60.0)).withColumn("y_end", F.when(F.col("k") == 1, 600.0)).withColumn("margin_top", F.lit(55.0)).withColumn("body_bottom", F.lit(745.0))


FILL = rf"""WITH {LINES}, {SPANS}, i AS (SELECT c.*, page, y0, text FROM c JOIN lines l ON l.doc = c.doc AND l.page BETWEEN page_start AND page_end
WHERE y0 >= CASE WHEN page = page_start THEN 60 ELSE 55 END AND y1 <= CASE WHEN page = page_end AND y_end IS NOT NULL THEN 599.5 ELSE 745 END),
g AS (SELECT doc, chunk_id, page, page_start, odd, string_agg(text, chr(10) ORDER BY y0, text) AS t FROM i GROUP BY ALL),
p AS (SELECT *, CASE WHEN page > page_start THEN t WHEN odd = 0 THEN regexp_extract(t, '(?s)A\s*F.*') ELSE regexp_extract(t, '(?s)N\s*O\s*4\s*R.*') END AS u FROM g),
x AS (SELECT doc, chunk_id, string_agg(u, chr(10) ORDER BY page) AS text FROM p WHERE u <> '' GROUP BY ALL) """


@query("p14_p15_fill_text", FILL + "SELECT c.doc, c.chunk_id, coalesce(x.text, '') AS text FROM c LEFT JOIN x ON x.doc = c.doc AND x.chunk_id = c.chunk_id")
def p15(spark, d):
    return S.fill_text(spans(spark, d), lines(spark, d))


#: Chunks with texts at, under and over the bounds of a stub, in space and lines; titles padded, blank or null.
PADDED = f"""{FILLED}, padded AS (SELECT doc, ord, chunk_id, page_start, title_h1, '  ' || title_h2 AS title_h2, CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE title_h3 END AS title_h3,
  CASE ord % 5 WHEN 0 THEN repeat('x', CAST(118 + ord % 4 AS INTEGER)) || repeat(' ', 10) WHEN 1 THEN chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || repeat(chr(10), CAST(ord % 3 AS INTEGER)) || CASE WHEN ord % 2 = 0 THEN 'd' ELSE '' END WHEN 2 THEN ' ' || text || ' '
    WHEN 3 THEN NULL ELSE ' ' || replace(title_h1, ' ', '  ') END AS text FROM full_chunks)"""
AGAIN = "lag(chunk_id) OVER (PARTITION BY doc ORDER BY ord) AS prev_chunk_id, lead(chunk_id) OVER (PARTITION BY doc ORDER BY ord) AS next_chunk_id"
BARE = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


def padded(spark, d):
    k = F.col("ord")
    lines_of = F.concat(F.lit("\na\nb\nc"), F.repeat(F.lit("\n"), (k % 3).cast("int")), F.when(k % 2 == 0, "d").otherwise(""))
    long = F.concat(F.repeat(F.lit("x"), (118 + k % 4).cast("int")), F.repeat(F.lit(" "), F.lit(10)))
    text = F.when(k % 5 == 0, long).when(k % 5 == 1, lines_of).when(k % 5 == 2, F.concat(F.lit(" "), "text", F.lit(" "))).when(k % 5 == 4, F.concat(F.lit(" "), F.replace("title_h1", F.lit(" "), F.lit("  "))))
    h3 = F.when(k % 4 == 1, "  ").when(k % 4 > 1, F.col("title_h3"))
    return filled(spark, d).withColumn("text", text).withColumn("title_h2", F.concat(F.lit("  "), "title_h2")).withColumn("title_h3", h3)


@query("p16_drop_stubs", f"""WITH {PADDED}, b AS (SELECT *, {BARE.format("text")} AS t, {BARE.format("title_h3")} = '' AS plain FROM padded),
x AS (SELECT *, lead(page_start) OVER (PARTITION BY doc ORDER BY ord) = page_start AND plain AND length(t) <= 120 AND length(t) - length(replace(t, chr(10), '')) < 3 AS stub FROM b)
SELECT doc, chunk_id, text, {AGAIN} FROM x WHERE stub IS NOT TRUE""")
def p16(spark, d):
    return S.drop_stubs(padded(spark, d)).select("doc", "chunk_id", "text", "prev_chunk_id", "next_chunk_id")


@query("p17_drop_title_only", rf"""WITH {PADDED}, b AS (SELECT *, regexp_replace(coalesce(text, ''), '\s', '', 'g') AS t, list_filter([regexp_replace(coalesce(h, ''), '\s', '', 'g') FOR h IN [title_h1, title_h2, title_h3]], lambda h: h <> '') AS titles FROM padded)
SELECT doc, chunk_id, {AGAIN} FROM b WHERE t = '' OR NOT list_contains(titles, t)""")
def p17(spark, d):
    return S.drop_title_only(padded(spark, d)).select("doc", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query("p18_p19_drop_empty_relink", f"""WITH {CHUNKS}, k AS (SELECT doc, ord, chunk_id FROM chunks WHERE trim(CASE WHEN n_chars % 5 = 0 THEN '  ' ELSE text END) <> '')
SELECT doc, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM k WINDOW w AS (PARTITION BY doc ORDER BY ord)""")
def p19(spark, d):
    c = chunks(spark, d).withColumn("text", F.when(F.col("n_chars") % 5 == 0, "  ").otherwise(F.col("text")))
    return S.relink(S.drop_empty(c)).select("doc", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query("p20_merge_titles", rf"""WITH {PADDED}, l AS (SELECT p.*, f.page_end, regexp_replace(coalesce(nullif({BARE.format("p.title_h3")}, ''), nullif({BARE.format("p.title_h2")}, ''), nullif({BARE.format("p.title_h1")}, ''), ''), '\s+', ' ', 'g') AS leaf FROM padded p JOIN full_chunks f ON p.doc = f.doc AND p.ord = f.ord)
SELECT doc, min(ord) AS ord, arg_min(chunk_id, ord) AS chunk_id, min(page_start) AS page_start, max(page_end) AS page_end,
  CASE WHEN count(*) > 1 THEN coalesce(string_agg({BARE.format("text")}, chr(10) || chr(10) ORDER BY ord) FILTER ({BARE.format("text")} <> ''), '') ELSE any_value(text) END AS text FROM l WHERE leaf <> '' GROUP BY doc, leaf
UNION ALL SELECT doc, ord, chunk_id, page_start, page_end, text FROM l WHERE leaf = ''""")
def p20(spark, d):
    return S.merge_titles(padded(spark, d))


@query("p21_leaf_titles", f"WITH {FILLED} SELECT doc, ord, coalesce(nullif({BARE.format('title_h3')}, ''), nullif({BARE.format('title_h2')}, ''), nullif({BARE.format('title_h1')}, ''), '') AS leaf FROM full_chunks")
def p21(spark, d):
    return filled(spark, d).select("doc", "ord", S.leaf_title(F.col("title_h1"), F.col("title_h2"), F.col("title_h3")).alias("leaf"))


def boxes(spark, d):
    return lines(spark, d).withColumn("x1", F.col("x0") + 30).withColumn("margin_top", F.lit(55.0)).withColumn("margin_bottom", F.lit(55.0)).withColumn("height", F.lit(800.0)).withColumn("width", F.lit(60.0))


@query("i1_body_filter", f"WITH {LINES} SELECT doc, page, box FROM lines WHERE y0 >= 55 AND y0 <= 800.0 - 55")
def i1(spark, d):
    return I.in_body(boxes(spark, d)).select("doc", "page", "box")


@query("i2_cluster_boxes", f"""WITH {LINES}, r AS (SELECT *, max(y1) OVER (PARTITION BY doc, page ORDER BY y0, x0, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines),
k AS (SELECT *, sum(CASE WHEN y0 - reach < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY y0, x0, box) AS cluster FROM r)
SELECT doc, page, CAST(cluster AS BIGINT) AS cluster, min(x0) AS x0, min(y0) AS y0, max(x0 + 30) AS x1, max(y1) AS y1, count(*) AS boxes FROM k GROUP BY doc, page, cluster""")
def i2(spark, d):
    return I.cluster_boxes(boxes(spark, d))


@query("i3_clip_boxes", f"WITH {LINES} SELECT box, greatest(x0 - 70, 0) AS x0, least(x0 + 100, 60.0) AS x1, greatest(y0, 0) AS y0, least(y1, 800.0) AS y1 FROM lines")
def i3(spark, d):
    return I.clip(boxes(spark, d)).select("box", "x0", "x1", "y0", "y1")


MARKERS = """m AS (SELECT doc, page, y0 AS marker_y, box AS idx, doc || ':' || CAST(box AS VARCHAR) AS chunk_id FROM lines WHERE box % 5 = 0), g AS (SELECT doc, page, box AS img, y0 AS img_y FROM lines WHERE box % 5 <> 0)"""


@query("i5_image_owners", f"""WITH {LINES}, {MARKERS}, j AS (SELECT g.*, m.marker_y, m.idx, m.chunk_id, row_number() OVER (PARTITION BY g.doc, g.page, img, img_y ORDER BY marker_y < img_y DESC, CASE WHEN marker_y < img_y THEN -marker_y ELSE marker_y END, CASE WHEN marker_y < img_y THEN -idx ELSE idx END) AS k FROM g JOIN m ON g.doc = m.doc AND g.page = m.page)
SELECT doc, page, img, img_y, chunk_id, printf('%s_p%d_%d', doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY img_y, img)) AS name FROM j WHERE k = 1""")
def i5(spark, d):
    l = lines(spark, d)
    m = l.where("box % 5 = 0").select("doc", "page", F.col("y0").alias("marker_y"), F.col("box").alias("idx"), F.concat_ws(":", "doc", F.col("box").cast("string")).alias("chunk_id"))
    return I.owners(l.where("box % 5 <> 0").select("doc", "page", F.col("box").alias("img"), F.col("y0").alias("img_y")), m)


PATHS = r"""ip AS (SELECT chunk_id, text, CAST(n_chars % 4 AS INTEGER) AS n, [' .\img\' || CAST((ord * 7) % 50 AS VARCHAR) || '.png', './img/' || CAST((ord * 3) % 50 AS VARCHAR) || '.png', 'img/' || CAST(ord % 60 AS VARCHAR) || '.png'][1:CAST(n_chars % 4 AS INTEGER)] AS image_paths FROM chunks),
ex AS (SELECT chunk_id, unnest(image_paths) AS raw, generate_subscripts(image_paths, 1) AS pos FROM ip), px AS (SELECT chunk_id, pos, regexp_replace(trim(replace(raw, '\', '/')), '^(\./)+', '') AS path FROM ex),
cache AS (SELECT 'img/' || CAST(i AS VARCHAR) || '.png' AS path, CASE WHEN i % 6 = 0 THEN 'CAPTION_FAILED' ELSE 'figure ' || CAST(i AS VARCHAR) END AS caption FROM range(0, 45) r(i))"""


def illustrated(spark, d):
    o = F.col("ord")
    path = lambda pre, n: F.concat(F.lit(pre), n.cast("string"), F.lit(".png"))
    made = F.slice(F.array(path(" .\\img\\", (o * 7) % 50), path("./img/", (o * 3) % 50), path("img/", o % 60)), F.lit(1), (F.col("n_chars") % 4).cast("int"))
    return chunks(spark, d).select("chunk_id", "text", F.transform(made, I.tidy_path).alias("image_paths"))


def cache(spark):
    i = F.col("id")
    return spark.range(45).select(F.concat(F.lit("img/"), i.cast("string"), F.lit(".png")).alias("path"), F.when(i % 6 == 0, I.FAILED).otherwise(F.concat(F.lit("figure "), i.cast("string"))).alias("caption"))


@query("i6_i7_image_paths", f"WITH {CHUNKS}, {PATHS} SELECT DISTINCT path, path IN (SELECT path FROM cache) AS there FROM px")
def i7(spark, d):
    return I.referenced(illustrated(spark, d), cache(spark))


@query("i8_pending_captions", f"WITH {CHUNKS}, {PATHS} SELECT DISTINCT path FROM px WHERE path NOT IN (SELECT path FROM cache WHERE caption <> 'CAPTION_FAILED')")
def i8(spark, d):
    return I.pending(illustrated(spark, d).select(F.explode("image_paths").alias("path")).distinct(), cache(spark))


INJECT = f"""WITH {CHUNKS}, {PATHS}, l AS (SELECT p.chunk_id, coalesce(string_agg(chr(10) || '[IMG_CAPTION] ' || caption, '' ORDER BY pos) FILTER (caption <> 'CAPTION_FAILED'), '') AS lines, count(*) FILTER (caption IS NULL) AS missing FROM px p LEFT JOIN cache c ON p.path = c.path GROUP BY 1),
done AS (SELECT ip.chunk_id, ip.text || coalesce(lines, '') AS text, coalesce(missing, 0) AS missing FROM ip LEFT JOIN l ON ip.chunk_id = l.chunk_id) """


@query("i11_inject_captions", INJECT + "SELECT * FROM done")
def i11(spark, d):
    return I.inject(illustrated(spark, d), cache(spark)).select("chunk_id", "text", F.col("missing").cast("long").alias("missing"))


@query("i12_extract_captions", INJECT + r", li AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM done) SELECT chunk_id, regexp_extract(line, '^\[IMG_CAPTION\]\s*(.*)$', 1) AS caption FROM li WHERE starts_with(line, '[IMG_CAPTION]')")
def i12(spark, d):
    return i11(spark, d).select("chunk_id", F.explode(I.captions_of(F.col("text"))).alias("caption"))


@query("i13_first_images", f"""WITH {CHUNKS}, {PATHS}, g AS (SELECT split_part(chunk_id, '_', 1) AS id, path, min(CAST(right(chunk_id, 4) AS BIGINT) * 10 + pos - 1) AS pos FROM px WHERE path IN (SELECT path FROM cache) GROUP BY ALL)
SELECT id, path, pos, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, path) AS k FROM g) WHERE k <= 5""")
def i13(spark, d):
    rows = illustrated(spark, d).select(F.split_part("chunk_id", F.lit("_"), F.lit(1)).alias("id"), F.right("chunk_id", F.lit(4)).cast("long").alias("n"), F.posexplode("image_paths").alias("p", "path"))
    return I.first_images(rows.select("id", "path", (F.col("n") * 10 + F.col("p")).alias("pos")), files=cache(spark)).withColumn("k", F.col("k").cast("long"))
