"""Queries on normalising, indexing and search over documents, embeddings and the benchmark's questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import indexes as V
from ..operators import normalise as N
from ..operators import retrieval as R
from ..sources.files import table, unique_chunks, uploaded_ids, valid_embeddings
from ..sources.store import kept, once, stored, version
from .structure import CHUNKS, PATHS, chunks, illustrated

QUERIES: dict = {}
TOK = r"CAST(len(regexp_extract_all({}, '\p{{Han}}|[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS INTEGER)"
TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


BY_DOC = "OVER (PARTITION BY doc ORDER BY ord)"


@query("n1_token_counts", f"SELECT doc_id, {TOK.format('text')} AS n_tokens FROM documents")
def n1(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query("n2_n3_garbage_filter", f"WITH {CHUNKS}, k AS (SELECT doc, ord, chunk_id, {TOK.format('text')} AS n_tokens FROM chunks) SELECT chunk_id, n_tokens, lag(chunk_id) {BY_DOC} AS prev_chunk_id, lead(chunk_id) {BY_DOC} AS next_chunk_id FROM k WHERE n_tokens >= 20")
def n2(spark, d):
    return N.garbage(chunks(spark, d))[0].select("chunk_id", "n_tokens", "prev_chunk_id", "next_chunk_id")


SENT0 = r"list_filter(list_transform(regexp_extract_all({0}, '[^。！？!?]+[。！？!?]?'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')"
TRIM = "trim({0}, ' ' || chr(10) || chr(9) || chr(13))"
SENT = f"CASE WHEN len({SENT0}) = 0 AND {TRIM} <> '' THEN [{TRIM}] ELSE {SENT0} END"
#: Texts with whole marks put in, as the documents end their sentences with dots.
MARKED = "marked AS (SELECT doc_id, replace(replace(text, '.' || chr(10), '! '), ', ', '。') AS text FROM documents)"


def marked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit(".\n"), F.lit("! ")), F.lit(", "), F.lit("。")).alias("text"))


@query("n4_sentences", f"WITH {MARKED}, s AS (SELECT doc_id, {SENT.format('text')} AS l FROM marked) SELECT doc_id, CAST(len(l) AS INTEGER) AS sentences, l[1] AS first, l[-1] AS last FROM s")
def n4(spark, d):
    rows = marked(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


MCHUNKS = f"{MARKED}, {CHUNKS}, mc AS (SELECT doc, ord, chunk_id, m.text FROM chunks c JOIN marked m ON c.ord = m.doc_id)"


def marked_chunks(spark, d):
    return chunks(spark, d).drop("text").join(marked(spark, d).withColumnRenamed("doc_id", "ord"), "ord")


SPLIT = f"""WITH RECURSIVE {MCHUNKS}, big AS (SELECT doc, ord, chunk_id, text, {TOK.format('text')} AS n FROM mc), s AS (SELECT doc, ord, chunk_id, {SENT.format('text')} AS l FROM big WHERE n > 3500),
f AS (SELECT doc, ord, chunk_id, l, 0 AS i, 0 AS part, 0 AS n, '' AS piece FROM s UNION ALL
  SELECT doc, ord, chunk_id, l, i + 1, CASE WHEN n > 0 AND n + {TOK.format('l[i + 1]')} > 1500 THEN part + 1 ELSE part END, CASE WHEN n > 0 AND n + {TOK.format('l[i + 1]')} > 1500 THEN {TOK.format('l[i + 1]')} ELSE n + {TOK.format('l[i + 1]')} END,
  CASE WHEN n > 0 AND n + {TOK.format('l[i + 1]')} > 1500 THEN l[i + 1] ELSE piece || l[i + 1] END FROM f WHERE i < len(l)),
p AS (SELECT doc, ord, chunk_id, part, arg_max(piece, i) AS text FROM f WHERE i > 0 GROUP BY ALL),
out AS (SELECT doc, ord, chunk_id || '_part' || CAST(part AS VARCHAR) AS chunk_id, part, text, chunk_id AS split_group_id FROM p UNION ALL SELECT doc, ord, chunk_id, 0, text, NULL FROM big WHERE n <= 3500) """


@query("n5_n6_n7_split_large", SPLIT + "SELECT chunk_id, part, text, split_group_id, lag(chunk_id) OVER (PARTITION BY doc ORDER BY ord, part) AS prev_chunk_id, lead(chunk_id) OVER (PARTITION BY doc ORDER BY ord, part) AS next_chunk_id FROM out")
def n6(spark, d):
    return N.split_large(marked_chunks(spark, d)).select("chunk_id", "part", "text", "split_group_id", "prev_chunk_id", "next_chunk_id")


@query("n8_split_audit", SPLIT + f"SELECT split_group_id, count(*) AS pieces, string_agg(CAST({TOK.format('text')} AS VARCHAR), ',' ORDER BY part) AS tokens FROM out WHERE split_group_id IS NOT NULL GROUP BY 1")
def n8(spark, d):
    return N.split_audit(N.split_large(marked_chunks(spark, d)))


#: A counter that is no pattern: a token is four bytes of a text.
BYTES = "CAST((octet_length(encode({})) + 3) // 4 AS INTEGER)"
BYTE_SPLIT = SPLIT.replace(TOK.format("text"), BYTES.format("text")).replace(TOK.format("l[i + 1]"), BYTES.format("l[i + 1]"))


def byte_counts():
    return lambda texts: [(len(t.encode()) + 3) // 4 for t in texts]


@query("n1_counts_by_model", f"SELECT doc_id, {BYTES.format('text')} AS n_tokens FROM documents")
def n1_model(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_of(F.col("text"), X.model_counts(byte_counts)).alias("n_tokens"))


@query("n5_n6_n7_split_by_model", BYTE_SPLIT + "SELECT chunk_id, part, text, split_group_id, lag(chunk_id) OVER (PARTITION BY doc ORDER BY ord, part) AS prev_chunk_id, lead(chunk_id) OVER (PARTITION BY doc ORDER BY ord, part) AS next_chunk_id FROM out")
def n6_model(spark, d):
    rows = N.split_large(marked_chunks(spark, d), counts=X.model_counts(byte_counts))
    return rows.select("chunk_id", "part", "text", "split_group_id", "prev_chunk_id", "next_chunk_id")


@query("n8_split_audit_by_model", BYTE_SPLIT + f"SELECT split_group_id, count(*) AS pieces, string_agg(CAST({BYTES.format('text')} AS VARCHAR), ',' ORDER BY part) AS tokens FROM out WHERE split_group_id IS NOT NULL GROUP BY 1")
def n8_model(spark, d):
    counts = X.model_counts(byte_counts)
    return N.split_audit(N.split_large(marked_chunks(spark, d), counts=counts), counts)


#: The pieces of each way as rows; blocks by a running number of the lines that open one.
PIECES = rf"""{MARKED}, nl AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n\z', '') AS t FROM documents),
li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM nl),
st AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(?:\d+[\.、]|步骤\s*\d+)') THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN regexp_matches(line, '^\s*(?:第[一二三四五六七八九十0-9]+[章节部分]|[0-9]+(?:\.[0-9]+){{1,3}})|^\s*(?:[-•●]|[（(]?[0-9一二三四五六七八九十]+[)）])') THEN 1 ELSE 0 END) OVER w AS b FROM li WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
raw AS (SELECT doc_id, 'paragraph' AS method, unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT doc_id, 'step', string_agg(line, chr(10) ORDER BY k) FROM st GROUP BY doc_id, a UNION ALL SELECT doc_id, 'title_list', string_agg(line, chr(10) ORDER BY k) FROM st GROUP BY doc_id, b
  UNION ALL SELECT doc_id, 'sentence', unnest(string_split(regexp_replace(replace(text, chr(10), ' '), '([。！？!?；;])\s+', '\1' || chr(1), 'g'), chr(1))) FROM documents),
pieces AS (SELECT doc_id, method, trim(p, ' ' || chr(10) || chr(9) || chr(13)) AS p FROM raw WHERE NOT regexp_full_match(p, '\s*'))"""


@query("n9_splitters", f"""WITH {PIECES} SELECT d.doc_id, {', '.join(f"count(*) FILTER (method = '{m}') AS {m}" for m in ("paragraph", "line", "step", "title_list", "sentence"))}, max(CASE WHEN method = 'sentence' THEN length(p) END) AS longest FROM documents d LEFT JOIN pieces p ON d.doc_id = p.doc_id GROUP BY 1""")
def n9(spark, d):
    rows = table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in N.splitters(F.col("text")).items()])
    return rows.select("doc_id", *[F.size(k).cast("long").alias(k) for k in rows.columns[1:]], F.array_max(F.transform("sentence", F.length)).cast("long").alias("longest"))


@query("n10_affected_links", f"""WITH {CHUNKS}, k AS (SELECT *, {TOK.format('text')} < 20 AS gone FROM chunks),
a AS (SELECT gone, last_value(CASE WHEN NOT gone THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(CASE WHEN NOT gone THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM k)
SELECT DISTINCT coalesce(p, '') AS prev_kept, coalesce(n, '') AS next_kept FROM a WHERE gone""")
def n10(spark, d):
    return N.affected_links(chunks(spark, d))


@query("s2_last_wins", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id AS chunk_id, event_id AS file, event_type FROM r WHERE k = 1")
def s2(spark, d):
    return unique_chunks(table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("file"), "event_type"))


@query("s3_first_wins", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id AS chunk_id, event_id AS file, event_type FROM r WHERE k = 1")
def s3(spark, d):
    return unique_chunks(table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("file"), "event_type"), last_wins=False)


@query("s5_valid_embeddings", "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0 AND vec_id % 3 <> 0 AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0")
def s5(spark, d):
    k = F.col("vec_id")
    sparse = F.when(k % 7 != 0, F.create_map(F.lit(1), F.lit(1.0)))
    dense = F.when(k % 5 != 0, F.when(k % 3 != 0, F.col("embedding")).otherwise(F.array(F.lit(None).cast("float"))))
    return valid_embeddings(table(spark, d, "embeddings").select("vec_id", dense.alias("dense"), sparse.alias("sparse")), "vec_id", "dense", "sparse").select("vec_id")


@query("s10_uploaded_ids", "SELECT vec_id FROM embeddings")
def s10(spark, d):
    return uploaded_ids(spark, f"{d}/embeddings.parquet", "vec_id")


@query("e1_incremental", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def e1(spark, d):
    return R.new_only(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


POST = f"post AS (SELECT doc_id AS id, source AS grp, term, count(*) AS weight FROM (SELECT doc_id, source, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY ALL)"


@query("e3_postings", f"WITH {POST} SELECT id, term, weight FROM post")
def e3(spark, d):
    return R.postings(table(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "id")


@query("e2_encode", """WITH t AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS h FROM documents), n AS (SELECT doc_id, h, instr('0123456789abcdef', substr(h, 1, 1)) - 1 AS a, instr('0123456789abcdef', substr(h, 2, 1)) - 1 AS b, instr('0123456789abcdef', substr(h, 3, 1)) - 1 AS c FROM t),
s AS (SELECT doc_id, count(DISTINCT substr(h, 1, 7)) AS terms, count(*) AS total FROM n GROUP BY 1), v AS (SELECT doc_id, CAST((a * 16 + b) % 64 AS INTEGER) AS dimension, CAST(sum(1 - 2 * (c % 2)) AS DOUBLE) AS weight FROM n GROUP BY ALL)
SELECT v.doc_id, dimension, weight, terms, CAST(total AS DOUBLE) AS total FROM v JOIN s ON v.doc_id = s.doc_id WHERE weight <> 0""")
def e2(spark, d):
    rows = R.encode(table(spark, d, "documents"), key="doc_id")
    total = F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", F.posexplode("dense").alias("dimension", "weight"), F.size("sparse").cast("long").alias("terms"), total.alias("total")).where("weight <> 0").withColumn("weight", F.col("weight").cast("double"))


@query("e4_upload_rows", "SELECT e.vec_id, e.label, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE e.vec_id NOT IN (SELECT doc_id FROM labels)")
def e4(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return R.upload_rows(vectors, docs, table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))).withColumnRenamed("chunk_id", "vec_id")


@query("e4_upload_counts", """WITH v AS (SELECT vec_id, vec_id % 9 <> 0 AND len(embedding) > 0 AS ok FROM embeddings), k AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)
SELECT count(*) FILTER (NOT ok) AS invalid, count(*) FILTER (ok AND vec_id NOT IN (SELECT doc_id FROM k)) AS missing, count(*) FILTER (ok AND vec_id IN (SELECT doc_id FROM k) AND vec_id IN (SELECT doc_id FROM labels)) AS uploaded,
count(*) FILTER (ok AND vec_id IN (SELECT doc_id FROM k) AND vec_id NOT IN (SELECT doc_id FROM labels)) AS pending FROM v""")
def e4c(spark, d):
    key = lambda df, k: df.select(F.col(k).alias("chunk_id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("dense"))
    return R.upload_counts(vectors, key(table(spark, d, "documents").where("doc_id % 4 <> 0"), "doc_id"), key(table(spark, d, "labels"), "doc_id"))


@query("e5_payload", f"""WITH {CHUNKS}, {PATHS}, i AS (SELECT chunk_id, string_agg(path, '|' ORDER BY pos) AS images FROM px GROUP BY 1) SELECT c.chunk_id, doc AS pdf_name, lang AS title_h1, '' AS title_h2, CAST(NULL AS VARCHAR) AS title_h3, CAST(ord AS BIGINT) AS page_start, CAST(ord + 1 AS BIGINT) AS page_end, c.text,
coalesce(images, '') AS image_paths, lag(c.chunk_id) {BY_DOC} AS prev_chunk_id, lead(c.chunk_id) {BY_DOC} AS next_chunk_id, CAST(NULL AS VARCHAR) AS split_group_id FROM chunks c LEFT JOIN i ON c.chunk_id = i.chunk_id""")
def e5(spark, d):
    images = illustrated(spark, d).select("chunk_id", F.when(F.size("image_paths") > 0, F.col("image_paths")).alias("image_paths"))
    rows = chunks(spark, d).join(images, "chunk_id").withColumnsRenamed({"doc": "pdf_name", "lang": "title_h1", "ord": "page_start"}).withColumn("page_end", F.col("page_start") + 1).withColumn("title_h2", F.lit(""))
    return R.payload(rows).withColumn("image_paths", F.array_join("image_paths", "|"))


@query("e6_point_ids", f"""WITH {CHUNKS}, h AS (SELECT chunk_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('manual::' || chunk_id)) AS h FROM chunks)
SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def e6(spark, d):
    return chunks(spark, d).select("chunk_id", R.point_id(F.concat(F.lit("manual::"), "chunk_id")).alias("point_id"))


DENSE = """q AS (SELECT vec_id AS query_id, embedding AS qv, CASE WHEN vec_id % 2 = 0 THEN label END AS wanted FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings e ON wanted IS NULL OR wanted = e.label),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= 50)"""


def dense(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("wanted"))
    return R.dense_top_k(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("grp")))


@query("r1_r2_dense_top_k", f"WITH {DENSE} SELECT query_id, id, score, rank FROM dense")
def r2(spark, d):
    return dense(spark, d).withColumn("rank", F.col("rank").cast("long"))


def cells(spark, d):
    """The documents' vectors in an inverted file, made once a session."""
    key = (spark.sparkContext.applicationId, d, version(spark, f"{d}/documents.parquet"))
    if key not in _CELLS:
        rows = encoded(spark, d)
        with kept():
            _CELLS[key] = V.cell_index(rows, rows.count())
    return _CELLS[key]


_CELLS: dict = {}


def asked(spark, d):
    """The questions' vectors; two of three questions ask for a manual."""
    return R.encode(questions(spark, d), key="query_id").join(wanted(spark, d), "query_id").select("query_id", F.col("dense").alias("qv"), "wanted")


def wanted(spark, d):
    k = F.col("query_id")
    return questions(spark, d).select("query_id", F.when(k % 3 > 0, F.concat(F.lit("src"), (k % 20).cast("string"))).alias("wanted"))


SPARSE = f"""{POST}, bq AS (SELECT item_id AS query_id, term, count(*) AS qw FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
ss AS (SELECT query_id, id, CAST(sum(weight * qw) AS BIGINT) AS score FROM post JOIN bq USING (term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ss) WHERE rank <= 50)"""


def index(spark, d):
    """The documents' terms, a row a document, in folders by manual, made once a session."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("grp"))
    return once(spark, "postings", f"{d}/documents.parquet", lambda: V.by_manual(R.counted_terms(docs, "id"), "postings", ranged=False))


def encoded(spark, d):
    """Dense vectors of the documents in folders by manual, made once a session."""
    docs = table(spark, d, "documents")
    rows = R.encode(docs, key="doc_id").join(docs.select("doc_id", F.col("source").alias("grp")), "doc_id").select(F.col("doc_id").alias("id"), F.col("dense").alias("vector"), "grp")
    return once(spark, "vectors", f"{d}/documents.parquet", lambda: V.by_manual(rows, "vectors", "id", ranged=False))


def blocks(spark, d):
    """Postings of the documents in blocks by manual, made once a session."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("grp"))
    return once(spark, "blocks", f"{d}/documents.parquet", lambda: V.block_index(docs, "doc_id"))


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def sparse(spark, d):
    return R.sparse_top_k(R.postings(questions(spark, d), "query_id"), index(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("r3_block_top_k", f"WITH {SPARSE} SELECT query_id, id, score, rank FROM sparse")
def r3_blocks(spark, d):
    """The same rows by blocks, as far as they can matter."""
    said = R.postings(questions(spark, d), "query_id").withColumn("wanted", F.lit(None).cast("string"))
    return V.block_top_k(said, blocks(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("r3_sparse_top_k", f"WITH {SPARSE} SELECT query_id, id, score, rank FROM sparse")
def r3(spark, d):
    return sparse(spark, d)


#: The dense leg of the questions: vectors by signed hashing of terms, cosine, the best 50; then both legs fused.
HYBRID = """hx AS (SELECT term, md5(term) AS h FROM (SELECT term FROM post UNION SELECT term FROM bq)),
dm AS (SELECT term, ((instr('0123456789abcdef', substr(h, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 2, 1)) - 1) % 64 AS dim, 1 - 2 * ((instr('0123456789abcdef', substr(h, 3, 1)) - 1) % 2) AS sgn FROM hx),
dv AS (SELECT id, dim, CAST(sum(weight * sgn) AS DOUBLE) AS w FROM post JOIN dm USING (term) GROUP BY ALL), qv AS (SELECT query_id, dim, CAST(sum(qw * sgn) AS DOUBLE) AS w FROM bq JOIN dm USING (term) GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1 HAVING sum(w * w) > 0), qn2 AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1 HAVING sum(w * w) > 0),
hd AS (SELECT query_id, id, round(sum(qv.w * dv.w) / (any_value(qn2.n) * any_value(dn.n)), 6) AS score FROM qv JOIN dv USING (dim) JOIN dn USING (id) JOIN qn2 USING (query_id) GROUP BY ALL),
hdense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hd) WHERE rank <= 50),
fz AS (SELECT query_id, id, round(sum(1.0 / (1 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM sparse UNION ALL SELECT query_id, id, rank FROM hdense) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fz) WHERE rank <= 50)"""


def fused(spark, d):
    """Hits of all questions, stored: a few narrow rows that many later steps read."""
    return stored(R.hybrid(questions(spark, d), encoded(spark, d), index(spark, d)).withColumn("rank", F.col("rank").cast("long")), "hits")


@query("r4_rrf_fusion", f"WITH {SPARSE}, {HYBRID} SELECT query_id, id, score, rank FROM fused")
def r4(spark, d):
    return R.hybrid(questions(spark, d), encoded(spark, d), index(spark, d)).withColumn("rank", F.col("rank").cast("long"))


#: Both legs of questions that may ask for a manual: the filter acts before each leg's best 50.
WANTED = """wq AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 > 0 THEN 'src' || CAST(item_id % 20 AS VARCHAR) END AS wanted FROM benchmark),
allowed AS (SELECT query_id, doc_id AS id FROM wq JOIN documents ON wanted IS NULL OR wanted = source)"""
FILTERED = f"""{POST}, bq AS (SELECT item_id AS query_id, term, count(*) AS qw FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL), {WANTED},
ss AS (SELECT query_id, id, CAST(sum(weight * qw) AS BIGINT) AS score FROM post JOIN bq USING (term) JOIN allowed USING (query_id, id) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ss) WHERE rank <= 50),
{HYBRID.replace("FROM qv JOIN dv USING (dim) JOIN dn USING (id) JOIN qn2 USING (query_id) GROUP BY ALL", "FROM allowed JOIN dn USING (id) JOIN qn2 USING (query_id) JOIN qv USING (query_id) LEFT JOIN dv ON dv.id = allowed.id AND dv.dim = qv.dim GROUP BY ALL").replace("sum(qv.w * dv.w)", "coalesce(sum(qv.w * dv.w), 0)")}"""


@query("r1_r4_filtered_hybrid", f"WITH {FILTERED} SELECT query_id, id, score, rank FROM fused")
def r4_filtered(spark, d):
    rows = questions(spark, d).join(wanted(spark, d), "query_id")
    return R.hybrid(rows, encoded(spark, d), index(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("r1_r3_filtered_sparse", f"WITH {FILTERED} SELECT query_id, id, score, rank FROM sparse")
def r3_filtered(spark, d):
    said = R.postings(questions(spark, d), "query_id").join(wanted(spark, d), "query_id")
    return V.block_top_k(said, blocks(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("r1_r2_cells", f"WITH {FILTERED} SELECT query_id, id, score, rank FROM hdense")
def r2_cells(spark, d):
    """By the inverted file: the nearest cells, then those that could still hold a better vector."""
    return V.cell_top_k(asked(spark, d), cells(spark, d), exact=True).withColumn("rank", F.col("rank").cast("long"))


DOCS = """dc AS (SELECT doc_id, source, lang, text, floor(doc_id / 200) AS page, CASE WHEN doc_id % 3 > 0 THEN source ELSE ' ' END AS h1, CASE WHEN doc_id % 3 = 1 THEN lang END AS h2, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS p, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)"""
AROUND = f"""{DOCS}, hits AS (SELECT * FROM fused WHERE rank <= 5), nb AS (SELECT query_id, rank, unnest([p, n]) AS id, unnest([0, 1]) AS way, lang FROM hits h JOIN dc ON h.id = dc.doc_id),
nb2 AS (SELECT query_id, nb.id, min(rank * 2 + way) AS found FROM nb JOIN dc ON nb.id = dc.doc_id AND nb.lang IS NOT DISTINCT FROM dc.lang WHERE (query_id, nb.id) NOT IN (SELECT (query_id, id) FROM hits) GROUP BY ALL),
expanded AS (SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY source DESC, found) AS pos FROM (SELECT query_id, id, score, 'search' AS source, rank AS found FROM hits UNION ALL SELECT query_id, id, 0.0, 'neighbor', found FROM nb2))"""


def linked(spark, d):
    """Documents as linked chunks of their source: text, titles and page go along by the id, the links by a window over ids."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("doc"))
    w = Window.partitionBy("doc").orderBy("ord")
    links = docs.select(F.col("ord").alias("chunk_id"), F.lag("ord").over(w).alias("prev_chunk_id"), F.lead("ord").over(w).alias("next_chunk_id"))
    k = F.col("doc_id")
    h1, h2 = F.when(k % 3 > 0, F.col("source")).otherwise(" "), F.when(k % 3 == 1, F.col("lang"))
    rows = table(spark, d, "documents").select(k.alias("chunk_id"), F.floor(k / 200).alias("page_start"), h1.alias("title_h1"), h2.alias("title_h2"), F.lit("").alias("title_h3"), "lang", F.col("source").alias("pdf_name"), "text")
    return rows.join(links, "chunk_id")


def expanded(spark, d):
    chain = linked(spark, d).select("chunk_id", "prev_chunk_id", "next_chunk_id", F.col("lang").alias("title_h1"))
    return R.expand_neighbours(fused(spark, d).where("rank <= 5"), chain)


@query("r5_r6_neighbours", f"WITH {SPARSE}, {HYBRID}, {AROUND} SELECT * FROM expanded")
def r6(spark, d):
    return expanded(spark, d)


@query("r6_disabled", f"WITH {SPARSE}, {HYBRID} SELECT query_id, id, score, 'search' AS source, rank AS pos FROM fused WHERE rank <= 5")
def r6_disabled(spark, d):
    return R.expand_neighbours(fused(spark, d).where("rank <= 5"), linked(spark, d), enabled=False)


RERANK = f"""bo AS (SELECT DISTINCT query_id, term FROM bq), cand AS (SELECT query_id, id, pos FROM expanded), qn AS (SELECT query_id, count(*) AS n FROM bo GROUP BY 1),
rs AS (SELECT c.query_id, c.id, pos, round(count(post.term) / any_value(n), 6) AS rerank_score FROM cand c JOIN qn USING (query_id) JOIN bo ON bo.query_id = c.query_id LEFT JOIN post ON post.id = c.id AND post.term = bo.term GROUP BY c.query_id, c.id, pos),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) AS rank FROM rs) WHERE rank <= 3)"""


def ranked(spark, d):
    """The best three of each question, stored: what follows reads them more than once."""
    cand = expanded(spark, d).select("query_id", "id", "pos")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return stored(R.rerank(cand, questions(spark, d), texts).withColumn("rank", F.col("rank").cast("long")), "ranked")


@query("r7_rerank", f"WITH {SPARSE}, {HYBRID}, {AROUND}, {RERANK} SELECT query_id, id, pos, rerank_score, rank FROM ranked")
def r7(spark, d):
    return ranked(spark, d)


def term_share():
    """A scorer in Python that gives what shared_terms() gives."""
    import regex

    terms = lambda t: set(regex.findall(r"[\p{L}\p{N}]+", t.lower()))
    return lambda pairs: [round(len((asked := terms(q)) & terms(t)) / max(len(asked), 1), 6) for q, t in pairs]


@query("r7_rerank_by_model", f"WITH {SPARSE}, {HYBRID}, {AROUND}, {RERANK} SELECT query_id, id, pos, rerank_score, rank FROM ranked")
def r7_model(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.rerank_by(expanded(spark, d).select("query_id", "id", "pos"), questions(spark, d), texts, term_share).withColumn("rank", F.col("rank").cast("long"))


LABEL = "'（第' || CAST(CAST(page AS BIGINT) AS VARCHAR) || '页' || CASE WHEN trim(h1) = '' THEN '' ELSE ' · ' || h1 || coalesce(' › ' || h2, '') END || '）---' || chr(10) || text"
BUDGET = f"bt AS (SELECT query_id, r.id, rank, page, h1, h2, p, text, {TOK.format(f'(' + repr('---chunk_0') + f' || {LABEL})')} AS n_tokens FROM ranked r JOIN dc d ON r.id = d.doc_id), fit AS (SELECT * FROM (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running FROM bt) WHERE running <= 9000)"


def fitting(spark, d):
    return R.within_budget(R.ranked_once(ranked(spark, d)).join(linked(spark, d).withColumnRenamed("chunk_id", "id"), "id"), 9000)


@query("r8_r9_token_budget", f"WITH {SPARSE}, {HYBRID}, {AROUND}, {RERANK}, {BUDGET} SELECT query_id, id, rank, n_tokens, running FROM fit")
def r9(spark, d):
    return fitting(spark, d).select("query_id", "id", "rank", "n_tokens", "running")


@query("r10_r11_context", f"""WITH RECURSIVE {SPARSE}, {HYBRID}, {AROUND}, {RERANK}, {BUDGET},
walk AS (SELECT query_id, page, CAST(id AS VARCHAR) AS head, id, 1 AS pos FROM fit f WHERE NOT EXISTS (SELECT 1 FROM fit g WHERE g.query_id = f.query_id AND g.page = f.page AND g.id = f.p)
  UNION ALL SELECT f.query_id, f.page, head, f.id, pos + 1 FROM walk w JOIN fit f ON f.query_id = w.query_id AND f.page = w.page AND f.p = w.id),
l AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY f.page, head, pos) AS k FROM fit f JOIN walk w ON f.query_id = w.query_id AND f.id = w.id)
SELECT query_id, string_agg('---chunk_' || CAST(k AS VARCHAR) || {LABEL}, chr(10) || chr(10) ORDER BY k) AS context, string_agg('chunk_' || CAST(k AS VARCHAR) || '=' || CAST(id AS VARCHAR), ',' ORDER BY k) AS labels FROM l GROUP BY 1""")
def r11(spark, d):
    told = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return R.context(fitting(spark, d)).select("query_id", "context", told.alias("labels"))


@query("r12_sources", f"""WITH {SPARSE}, {HYBRID}, {AROUND}, {RERANK} SELECT query_id, CAST(id AS VARCHAR) AS id, CASE rank WHEN 3 THEN 0 ELSE 1 END AS pos, CAST(rank AS INTEGER) AS rank, CAST(page AS INTEGER) AS page,
CASE WHEN trim(h1) = '' THEN '' ELSE h1 || coalesce(' › ' || h2, '') END AS title_path, CASE WHEN id % 2 = 0 THEN 'img/' || CAST(id AS VARCHAR) || '.png' ELSE '' END AS image_paths FROM ranked JOIN dc ON dc.doc_id = ranked.id WHERE rank IN (1, 3)""")
def r12(spark, d):
    """Every id stands twice in the ranking, with blank ones between, which take no place."""
    got = ranked(spark, d).withColumn("id", F.col("id").cast("string"))
    used = got.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("rank") == 3, F.col("id"))).alias("c"))
    used = used.select("query_id", F.array("c", "a", "a", F.lit("unknown"), F.lit(" ")).alias("used"))
    twice = F.posexplode(F.array("id", F.lit("  "), "id"))
    repeated = got.select("query_id", "rank", twice.alias("k", "id")).select("query_id", "id", (F.col("rank") * 3 + F.col("k")).alias("rank"))
    images = F.array(F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("img/"), F.col("chunk_id").cast("string"), F.lit(".png"))), F.lit(" "))
    found = R.sources(used, repeated, linked(spark, d).withColumn("image_paths", images))
    return found.withColumn("image_paths", F.array_join("image_paths", "|"))


@query("r13_labels", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN CAST(doc_id AS VARCHAR) END AS id FROM documents")
def r13(spark, d):
    k = F.col("doc_id")
    labels = F.create_map(F.lit("chunk_1"), k.cast("string"))
    said = F.when(k % 3 == 0, "chunk_1").when(k % 3 == 1, k.cast("string")).otherwise("chunk_9")
    return table(spark, d, "documents").select("doc_id", R.to_id(said, labels).alias("id"))


@query("r14_source_list", """WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations), f AS (SELECT conv_id AS query_id, role AS id, turn AS pos, coalesce(TRY_CAST(CASE WHEN turn % 2 = 0 THEN CAST(9 - turn AS VARCHAR) ELSE 'p' || CAST(turn AS VARCHAR) END AS INTEGER), 0) AS page FROM r WHERE k = 1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page, pos) AS k FROM f""")
def r14(spark, d):
    page = F.when(F.col("turn") % 2 == 0, (9 - F.col("turn")).cast("string")).otherwise(F.concat(F.lit("p"), F.col("turn").cast("string")))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("id"), F.col("turn").alias("pos"), page.alias("page"))
    return R.source_list(rows).withColumn("k", F.col("k").cast("long"))


@query("r15_told_sources", f"""WITH {SPARSE}, {HYBRID}, {AROUND}, {RERANK}, told(pos, lab) AS (VALUES (0, 2), (1, 1), (3, 2))
SELECT query_id, t.pos, CAST(id AS VARCHAR) AS chunk_id, CAST(rank AS BIGINT) AS rank, CAST(page AS INTEGER) AS page, CASE WHEN trim(h1) = '' THEN '' ELSE h1 || coalesce(' › ' || h2, '') END AS title_path, source AS pdf_name FROM ranked r JOIN told t ON r.rank = t.lab JOIN dc ON dc.doc_id = r.id""")
def r15(spark, d):
    got = ranked(spark, d)
    label = F.struct(F.concat(F.lit("chunk_"), F.col("rank").cast("string")).alias("k"), F.col("id").cast("string").alias("v"))
    told = got.groupBy("query_id").agg(F.map_from_entries(F.collect_list(label)).alias("labels")).withColumn("said", F.lit("chunk_2， chunk_1,chunk_9,chunk_2,"))
    return R.told_sources(told, got, linked(spark, d))


@query("r16_crop", rf"SELECT doc_id, array_to_string(regexp_extract_all(text, '\p{{Han}}|[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')[1:50], ' ') AS cropped, greatest({TOK.format('text')} - 50, 0) AS removed FROM documents")
def r16(spark, d):
    return table(spark, d, "documents").select("doc_id", R.crop(F.col("text"), 50).alias("cropped"), F.greatest(X.token_count(F.col("text")) - 50, F.lit(0)).alias("removed"))
