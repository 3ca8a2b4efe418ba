"""Source divergence audit by wide term vectors.

Texts become counts of (lang, source, term), summed in each task before one shuffle by (lang, term). A term that enough documents of its lang have is pivoted into
one row, its vector: an array with a place for each source of the lang, in order of their names. JVM higher-order functions turn the counts into shares and emit what
each pair of sources gets from the term; those rows are summed map-side, so that a pair is a row a task when they are shuffled.

A pair of sources that both lack a term gets the same from every such term, so these aren't emitted: the sum adds that value times the number of terms that neither has.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stored, table

LEAST_DOCS, TOP, SCALE, SMOOTH = 10, 10, 1_000_000_000, 2
#: Terms that a task holds before it hands their counts on, bytes of a text that it splits at once, parts that a lang's terms are dealt to.
HELD, PIECE, SALTS = 250_000, 1 << 22, 64
#: Bytes of a term, A-Z made lower; any other ASCII byte parts terms. Bytes beyond ASCII belong to letters of UTF-8, whole.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece of it at a time; a piece ends where a term does."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        yield folded[at : end if end >= 0 else len(folded)].split()
        at = end if end >= 0 else len(folded)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term and documents that have it, summed over parts of a task's rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    same = lambda v: pa.array([v] * len(part), pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "d"])
            counts.clear()

        for batch in slices(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, d = counts[lang, source]
                seen: set[bytes] = set()
                for words in _words(text):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
            if sum(len(d) for _, d in counts.values()) > HELD:
                yield from told()
        yield from told()

    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source"), said(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, d long").withColumn("term", F.col("term").cast("string"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, m: Column) -> Column:
    """1 + floor(SCALE * n / m) for 0 <= n <= m, exact: where the product might not fit a long, three digits of the quotient at a time."""
    out, left = _div(n, m), n % m
    for _ in range(3):
        out, left = out * 1000 + _div(left * 1000, m), (left * 1000) % m
    return 1 + F.when(m < 9_000_000_000, _div(n * SCALE, m)).otherwise(out)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a lang's sources are from each other (part `pair`) and the terms that a source has more of than its lang (part `term`).

    Terms are runs of A-Z, a-z and all beyond ASCII, A-Z lower-cased; a lang keeps those that least_docs of its documents have. A group, (lang, source), and a lang give a kept
    term p = 1 + floor(SCALE * (n + SMOOTH) / (N + SMOOTH * V)), n its count there, N all counts there, V the number of kept terms. Two shares p and q are floor((p-q)^2 / (p+q)) apart.
    `pair`: item each other source of the lang, value the sum over all kept terms, every rank. `term`: item a kept term that the group has and gives more than its lang does, the first `top` ranks.
    Ranks go by falling value, then by the item's bytes.

    Null text, lang and source are ''. Groups without a term give each kept term the same; a lang without kept terms has pairs of value 0; one with a single source has no pairs. Repeated rows are as
    many documents. Texts are read whole, in pieces. An empty table gives an empty one. Only the three named columns are read, so others may have any name.
    No task holds more than a term's vector or a source's row of pairs, whatever source or term is hot.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source")).distinct()
    # tasks have summed already, so one shuffle by (lang, term) serves both sums
    summed = term_counts(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    pivoted = summed.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.collect_list(F.struct("source", "n")).alias("has"))
    kept = stored(pivoted.where(F.col("docs") >= least_docs).select("lang", "term", "has"), "kept_terms")

    sizes = kept.select("lang", F.inline("has")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    every = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    every = every.join(vocabulary, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    base = lambda n: n + SMOOTH * F.col("v")
    langs = stored(every.select("lang", "v", F.col("g.source").alias("sources"), F.transform("g", lambda x: base(x["n"])).alias("sums"), base(F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("whole")), "langs")

    # a lang's terms are dealt to parts, so that its row meets them in many tasks
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    lacking = F.transform(F.array_except("sources", "has.source"), lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))
    wide = met.withColumn("c", F.transform(F.array_sort(F.concat("has", lacking)), lambda x: x["n"])).select("lang", "term", "sources", "c", "sums", "whole")
    wide = wide.withColumn("p", F.zip_with("c", "sums", lambda n, m: _share(n + SMOOTH, m)))

    first = wide.select("lang", "p", "c", F.posexplode("c").alias("i", "n")).where(F.col("i") < F.size("c") - 1)
    others = F.filter(F.sequence(F.col("i") + 1, F.size("c") - 1), lambda j: (F.col("n") > 0) | (F.get("c", j) > 0))
    given = F.transform(others, lambda j: F.struct(j.alias("j"), _gap(F.get("p", F.col("i")), F.get("p", j)).alias("f")))
    sums = first.select("lang", "i", F.inline(given)).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("k"))

    # the rows of the answer: each source of a lang with each other, a source's row of pairs a task at most
    own = langs.select("lang", "v", "sources", "sums", F.posexplode("sources").alias("a", "source")).repartition("lang", "a")
    both = own.select("lang", "v", "source", "a", "sums", F.posexplode("sources").alias("b", "item")).where(F.col("a") != F.col("b"))
    none = lambda at: _share(F.lit(SMOOTH).cast("long"), F.get("sums", F.col(at)))
    both = both.select("lang", "v", "source", "item", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.when(F.col("v") > 0, _gap(none("a"), none("b"))).otherwise(0).alias("unseen"))
    value = F.coalesce("f", F.lit(0)) + (F.col("v") - F.coalesce("k", F.lit(0))) * F.col("unseen")
    pairs = both.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    q = _share(F.aggregate("c", F.lit(0).cast("long"), lambda a, n: a + n) + SMOOTH, F.col("whole"))
    more = wide.withColumn("q", q).select("lang", "term", "q", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("c").alias("n"), F.col("p").alias("p"))))
    terms = more.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranks = lambda rows: rows.withColumn("rank", F.row_number().over(ranked))
    return ranks(pairs).unionByName(ranks(terms).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT lang, source FROM d GROUP BY ALL),
size AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, CAST(coalesce(sum(n), 0) AS BIGINT) AS size FROM g LEFT JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)) // (size + 2 * v) AS p
      FROM size s JOIN kept k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (CAST(sum(n) AS BIGINT) + 2)) // (CAST(any_value(whole) AS BIGINT) + 2 * any_value(v)) AS q
      FROM c JOIN (SELECT lang, sum(size) AS whole, any_value(v) AS v FROM size GROUP BY lang) USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT p.lang, source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
