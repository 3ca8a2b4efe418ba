"""Memory that doesn't grow with a batch, and steps that move no more than they must."""

import numpy as np
from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators import indexes as V
from quillstack.operators import normalise as N
from quillstack.operators import reports as S
from quillstack.operators import retrieval as R


def test_encoded_maps_go_on_at_once(spark):
    def make():
        alive = set()

        class Kept(dict):
            def __init__(self, n):
                super().__init__({n: 1.0})
                alive.add(n)

            def __del__(self):
                alive.discard(*self)

        number = iter(range(3000))
        return lambda texts: [([float(len(alive))], Kept(next(number))) for _ in texts]

    held = [r.dense[0] for r in R.encode(spark.range(3000).select(F.col("id").alias("chunk_id"), F.lit("x").alias("text")).coalesce(1), make).collect()]
    assert len(held) == 3000 and max(held) <= 4 * R.BATCH  # maps that are Python objects at a time


def test_counted_texts_are_not_all_held(spark):
    def make():
        import sys

        before = sys.getallocatedblocks()
        return lambda texts: [sys.getallocatedblocks() - before for _ in texts]

    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda n: n.cast("string")).alias("t"))
    held = rows.select(X.counts_of(F.col("t"), X.model_counts(make)).alias("n")).first().n
    assert len(held) == 300_000 and held[0] < 200_000  # Python objects made by the time the first texts are counted; the libraries of a worker are 140,000 of them


def test_sparse_search_shuffles_no_sums(spark, monkeypatch):
    """Windows of any size give what the join gives, with manuals, ties, null texts and ids of either kind; of an index with a row a text only the best are shuffled."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), i % 30)) if i % 11 else None, f"m{i % 3}" if i % 7 else None) for i in range(500)]
    frame = spark.createDataFrame(texts, "id long, text string, grp string").repartition(3)
    said = [(q, w, 1 + (q + i) % 3, None if q % 2 else f"m{q % 4}") for q in range(20) for i, w in enumerate("abcdexyz"[: 1 + q % 8])]
    queries = spark.createDataFrame(said, "query_id long, term string, weight long, wanted string")
    rows = lambda df: sorted((r.query_id, r["rank"], str(r.id), r.score) for r in df.collect())
    for kind in ("long", "string"):
        of = frame.withColumn("id", F.col("id").cast(kind))
        index = R.counted_terms(of, "id")
        join = R.sparse_top_k(queries, R.postings(of, "id").join(of.select("id", "grp"), "id"), 40)
        assert rows(R.sparse_top_k(queries, index, 40)) == rows(join)
        assert sorted(map(str, R.as_postings(index).drop("grp").collect())) == sorted(map(str, R.postings(of, "id").collect()))
    monkeypatch.setattr(R, "WINDOW", 50)
    monkeypatch.setattr(R, "QUERIES_AT_ONCE", 7)
    assert rows(R.sparse_top_k(queries, index, 40)) == rows(join)
    assert R.sparse_top_k(queries.limit(0), index).count() == 0 and R.sparse_top_k(queries, R.counted_terms(of.limit(0), "id")).count() == 0
    monkeypatch.undo()
    plan = R.sparse_top_k(queries, index, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_blocks_are_made_without_moving_postings(spark, monkeypatch):
    """Of the steps that make blocks only whole texts, a row each, are dealt anew: no exchange has a term's postings."""
    plans = []
    keep = V.stored
    monkeypatch.setattr(V, "stored", lambda df, tag, **more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, tag, **more))[1])
    frame = spark.createDataFrame([(i, f"a b c{i % 7}", f"m{i % 3}") for i in range(200)], "doc_id long, text string, grp string")
    made = V.block_index(frame, "doc_id")
    assert made.agg(F.sum("n")).first()[0] == 600
    assert not [line for plan in plans for line in plan.splitlines() if "Exchange" in line and "term#" in line]
    assert sum(line.count("Exchange hashpartitioning") for line in plans[-1].splitlines()) == 1


def test_links_by_frames_that_grow(spark):
    """No frame runs to a manual's end, as it would be gone through anew for each row."""
    rows = spark.createDataFrame([("a", i, f"a_{i}", "x " * (30 if i % 4 else 3)) for i in range(9)] + [("b", 1, "b_1", "x")], "doc string, ord long, chunk_id string, text string")
    got = N.affected_links(rows)
    assert sorted(map(tuple, got.collect())) == [("", ""), ("", "a_1"), ("a_3", "a_5"), ("a_7", "")]
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_rectangles_meet_over_the_borders_of_cells(spark):
    """A distance that rounds to the tolerance counts, wherever cells end; a block goes to few cells."""
    rng = np.random.default_rng(6)
    box = lambda i, x, y: ("d", 1, i, float(x), float(y), float(x) + 3, float(y) + 1)
    blocks = [box(i, *rng.uniform(-20, 20, 2)) for i in range(200)] + [box(900, 101.99999999, 0)]
    placed = [box(i, b[3] + rng.uniform(-3, 3), b[4] + rng.uniform(-3, 3)) for i, b in enumerate(blocks[:200])] + [box(901, 104.0000003, 0)]
    used, want = set(), []
    for _, _, i, *a in sorted(blocks, key=lambda b: (b[4], b[2])):
        near = sorted((f, p[2]) for p in placed if p[2] not in used and (f := round(max(abs(x - y) for x, y in zip(a, p[3:], strict=True)), 6)) <= 2)
        if near:
            used.add(near[0][1])
            want.append((i, near[0][1]))
    make = lambda r: spark.createDataFrame(r, "doc string, page int, id long, x0 double, y0 double, x1 double, y1 double")
    got = S.match_rectangles(make(blocks), make(placed))
    assert sorted((r.id, r.other) for r in got.collect()) == sorted(want) and (900, 901) in want


def test_sentences_are_looked_for_once(spark):
    plan = spark.range(1).select(X.sentences(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
