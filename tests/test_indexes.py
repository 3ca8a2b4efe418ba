"""Stored indexes: the same rows as a full read, fewer files and postings opened."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import indexes as V
from quillstack.operators import retrieval as R
from reading import files_read

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", F.col("source").alias("grp"))


@pytest.fixture(scope="module")
def blocks(spark, docs):
    return V.block_index(docs, "doc_id")


@pytest.fixture(scope="module")
def asked(spark):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return R.postings(bench, "query_id")


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def test_blocks_give_the_full_answer_and_read_less(spark, docs, blocks, asked):
    free = asked.withColumn("wanted", F.lit(None).cast("string"))
    index = R.postings(docs, "doc_id").withColumnRenamed("doc_id", "id")
    assert rows(V.block_top_k(free, blocks, 10)) == rows(R.sparse_top_k(asked, index, 10))
    first, _, rest, met = V.block_passes(free, blocks, 10)
    n = lambda df: df.agg(F.sum("n")).first()[0] or 0
    read, every = n(first) + n(rest), n(met)
    print(f"postings read: {read} of {every}")
    assert read < 0.5 * every
    common = [r.term for r in met.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc()).limit(5).collect()]
    assert n(first.where(F.col("term").isin(common))) + n(rest.where(F.col("term").isin(common))) < 0.6 * n(met.where(F.col("term").isin(common)))


def test_blocks_of_random_texts(spark):
    """Ties, repeated rows of one term, texts without terms, nulls, and questions that ask for more than there is."""
    rng = np.random.default_rng(2)
    words = ["a", "b", "c", "d", "e", "f"]
    texts = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)) ** 2 // 40)) or None, f"m{i % 4}" if i % 9 else None) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, grp string")
    said = [(q, w, int(rng.integers(1, 4)), None if q % 2 else f"m{q % 5}") for q in range(12) for w in words[: 1 + q % 6]]
    queries = spark.createDataFrame(said, "query_id long, term string, weight long, wanted string")
    index = V.weighed(frame, "doc_id")
    want = []
    for q in {s[0] for s in said}:
        own = [s for s in said if s[0] == q]
        scores = {i: sum(w * (text or "").split().count(t) for _, t, w, _ in own) for i, text, g in texts if own[0][3] is None or g == own[0][3]}
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:30]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    for size in (1, 7, 128):
        old, V.BLOCK = V.BLOCK, size
        try:
            made = V.block_index(frame, "doc_id")
        finally:
            V.BLOCK = old
        assert rows(V.block_top_k(queries, made, 30)) == sorted(want)
    assert rows(R.sparse_top_k(queries, index, 30)) == sorted(want)
    assert V.block_top_k(queries.limit(0), made).count() == 0 and V.block_top_k(queries, V.block_index(frame.limit(0), "doc_id")).count() == 0


def test_length_of_a_text(spark):
    frame = spark.createDataFrame([(1, "b a B c a b", "m"), (2, None, "m"), (3, "x " * 70_000, "m")], "doc_id long, text string, grp string")
    assert sorted((r.id, r.term, r.weight, round(r.norm**2)) for r in V.weighed(frame, "doc_id").collect()) == [(1, "a", 2, 14), (1, "b", 3, 14), (1, "c", 1, 14), (3, "x", 70_000, 70_000**2)]


def test_a_manuals_folder_alone_is_opened(spark, docs, blocks):
    vectors = V.by_manual(R.encode(docs, key="doc_id").join(docs.select("doc_id", "grp"), "doc_id").select(F.col("doc_id").alias("id"), F.col("dense").alias("vector"), "grp"), "vectors", "id")
    for index in (vectors, blocks):
        every = files_read(index.select("grp"))
        some = files_read(V.pruned(index, ["src3"]).select("grp"))
        wanted = spark.createDataFrame([("src3",), ("src5",), (None,), ("src3",), ("nowhere",)], "wanted string")
        assert {r.grp for r in V.of_manuals(index, wanted).select("grp").distinct().collect()} == {"src3", "src5"}
        assert some <= every / 8 and files_read(V.of_manuals(index, wanted).select("grp")) <= every / 4
        assert V.of_manuals(index, wanted.limit(0)).count() == 0
        assert "PartitionFilters: [isnotnull(part" in V.pruned(index, ["src3"])._jdf.queryExecution().toString() or "PartitionFilters: [(part" in V.pruned(index, ["src3"])._jdf.queryExecution().toString()


def test_more_manuals_than_a_list_holds(spark, blocks, monkeypatch):
    monkeypatch.setattr(V, "ASKED", 1)
    wanted = spark.createDataFrame([("src3",), ("src5",)], "wanted string")
    assert {r.grp for r in V.of_manuals(blocks, wanted).select("grp").distinct().collect()} == {"src3", "src5"}


def made_vectors(spark, n=3000, clusters=40):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(clusters, 16))
    x = centres[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, 16))
    vectors = [(i, [float(c) for c in v], f"m{i % 3}") for i, v in enumerate(x)]
    odd = [(n, None, "m0"), (n + 1, [0.0] * 16, "m0"), (n + 2, [1.0], "m0"), (n + 3, [float("nan")] * 16, "m0"), (n + 4, vectors[3][1], "m0")]
    frame = spark.createDataFrame(vectors + odd, "id long, vector array<double>, grp string")
    queries = spark.createDataFrame([(q, vectors[q * 37 % n][1], None if q % 3 else "m1") for q in range(60)] + [(99, None, None), (98, [0.0] * 16, None)], "query_id long, qv array<double>, wanted string")
    return frame, queries


def test_cells(spark, monkeypatch):
    frame, queries = made_vectors(spark)
    index = V.cell_index(frame, frame.count())
    exact = R.dense_top_k(queries, frame, 50)
    opened = []
    near = V.cell_top_k(queries.limit(1), index, 50, seen=lambda a, b: opened.append((a, b)))
    near.collect()
    assert opened == [(V.PROBES, 54)]  # of a question's, few cells are opened
    found = V.cell_top_k(queries, index, 50)
    share = V.recall(found, exact)
    print("recall at 50:", share)
    assert share >= 0.95
    assert rows(V.cell_top_k(queries, index, 50, probes=1, exact=True)) == rows(exact)
    assert files_read(index.vectors.where(F.col("cell").isin([1, 2])).select("id")) < files_read(index.vectors.select("id")) / 10
    for module in (R, V):
        monkeypatch.setattr(module, "QUERIES_AT_ONCE", 7)  # passes in turn
    assert rows(V.cell_top_k(queries, index, 50, exact=True)) == rows(exact) == rows(R.dense_top_k(queries, frame, 50))


def test_cells_of_nothing(spark):
    frame, queries = made_vectors(spark, 200)
    none = V.cell_index(frame.limit(0), 0)
    assert V.cell_top_k(queries, none).count() == 0
    one = V.cell_index(frame.limit(1), 1)
    assert [r.id for r in V.cell_top_k(queries.where("query_id = 1"), one).collect()] == [0]
    assert V.cell_top_k(queries.limit(0), one).count() == 0
    assert V.recall(queries.select("query_id", F.lit(1).alias("id")).limit(0), queries.select("query_id", F.lit(1).alias("id")).limit(0)) == 1.0


def test_centres_stand_in_their_clusters():
    rng = np.random.default_rng(3)
    true = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = R.unit(true[rng.integers(0, 8, 500)] + 0.05 * rng.normal(size=(500, 8)))
    made = V.centres_of(x, 30)
    assert (np.max(made @ true.T, axis=0) > 0.99).all() and np.allclose(np.linalg.norm(made, axis=1), 1)
