"""Approximate nearest neighbours by additive quantisation.

A vector is encoded as the sum of one full-dimensional codeword from each of LEVELS codebooks, fitted on residuals over a bounded sample and
chosen by beam search; its codes and norms are stored, in files sorted by its first codeword, its cell: its own norm, the gain by which a score of its
reconstruction is short of its own (a reconstruction keeps a part of a vector's length), and the norm of what the reconstruction has besides the vector's direction.
Queries score codes by table lookups and the stored norms; rows that may be among the best, judged by that score plus MARGIN deviations of what the
reconstruction's sideways part can add or take, are reranked on the original vectors in double precision. What a row must reach is, at first, the query's
k-th best score in the sample, then its k-th best so far.

Queries are taken in blocks of bounded size, in the order of their cells, a pass over the index each: the index isn't moved or copied. A pass reads the cells of which some query of the block
may want a row, and a task looks at a cell for the queries that may; a task's best k of each query go on. Where vectors have no clusters at all, every
query may want every cell, and work is queries times rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Codebooks, words in each, rows of the sample that fits them, passes of the fit, encodings kept by the beam.
LEVELS, WORDS, SAMPLE, PASSES, BEAM = 8, 256, 8192, 5, 4
#: Queries in a block, queries that a task scores at once, pairs reranked at once, deviations of the residual's part that a row may make up for.
QUERIES, AT_ONCE, PAIRS, MARGIN = 16384, 256, 65536, 2.5
#: The share of hopeful pairs from which they are reranked together.
DENSE = 0.01


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v array<double>: without null ids, null, empty and zero vectors, and those with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def fit(x: np.ndarray, levels: int = LEVELS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Codebooks [levels, words, dimension] (float32) by k-means on what the levels before leave over."""
    rng = np.random.default_rng(seed)
    rest, books = x.astype(np.float32).copy(), []
    words = max(1, min(words, len(x) // 2))
    for _ in range(levels):
        book = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(PASSES):
            near = np.argmin((book * book).sum(1)[None, :] - 2 * rest @ book.T, axis=1)
            total = np.zeros_like(book)
            np.add.at(total, near, rest)
            n = np.bincount(near, minlength=words)[:, None]
            book = np.where(n > 0, total / np.maximum(n, 1), book).astype(np.float32)
        near = np.argmin((book * book).sum(1)[None, :] - 2 * rest @ book.T, axis=1)
        rest -= book[near]
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes [n, levels] (uint8) and reconstructions, by beam search over the levels."""
    n, words = len(x), books.shape[1]
    codes, made = np.zeros((n, len(books)), np.uint8), np.zeros(x.shape, np.float32)
    for at in range(0, n, 1024):
        part = x[at : at + 1024].astype(np.float32)
        m = len(part)
        rest, kept = part[:, None, :], np.zeros((m, 1, 0), np.uint8)
        for book in books:
            cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
            flat = cost.reshape(m, -1)
            k = min(beam, flat.shape[1])
            best = np.argpartition(flat, k - 1, axis=1)[:, :k] if k < flat.shape[1] else np.tile(np.arange(k), (m, 1))
            parent, word = best // words, best % words
            rows = np.arange(m)[:, None]
            rest = rest[rows, parent] - book[word]
            kept = np.concatenate([kept[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        best = (rest * rest).sum(2).argmin(1)
        codes[at : at + m] = kept[np.arange(m), best]
        made[at : at + m] = part - rest[np.arange(m), best]
    return codes, made


def index(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, v, codes, norm, gain, aside, cell, along, off) of every vector (id, v) whose dimension is that of the codebooks.

    gain times the reconstruction's score is the vector's, but for what lies aside of the vector; a reconstruction that keeps next to nothing of it has gain 1 and
    an endless aside. cell is the first code; along and off are the vector's parts in the direction of its word and across.
    """
    d = books.shape[2]
    first = books[0].astype(float)
    first /= np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
                codes, made = encode(x, books)
                norm, dot = np.linalg.norm(x, axis=1), (x * made).sum(1)
                told = dot > 0.05 * norm * norm
                gain = np.where(told, norm * norm / np.where(told, dot, 1), 1.0)
                aside = np.where(told, gain * np.sqrt(np.maximum((made.astype(float) ** 2).sum(1) - (dot / norm) ** 2, 0)), np.inf)
                along = (x * first[codes[:, 0]]).sum(1)
                off = np.sqrt(np.maximum(norm * norm - along * along, 0))
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (norm, gain, aside)), pa.array(codes[:, 0].astype(np.int32)), pa.array(along), pa.array(off)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "v", "codes", "norm", "gain", "aside", "cell", "along", "off"])

    return vectors.where(F.size("v") == d).mapInArrow(run, "id long, v array<double>, codes binary, norm double, gain double, aside double, cell int, along double, off double")


def floors(asked: DataFrame, sample: tuple[np.ndarray, np.ndarray], books: np.ndarray, k: int, euclid: bool) -> DataFrame:
    """(id, v, cell, floor, sure, sure_cells) of queries (id, v, cell): the k-th best score in the sample, which k rows reach, so that the k best do; and the ids and cells of these k."""
    sample_cells = encode(sample[1], books)[0][:, 0].astype(np.int32)
    sent = asked.sparkSession.sparkContext.broadcast((*sample, sample_cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, at_home = sent.value
        size = (x**2).sum(1)
        top_n = min(k, len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                q = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                near = q @ x.T
                if euclid:
                    near = 2 * near - size - (q**2).sum(1)[:, None]
                near[part.column(0).to_numpy()[:, None] == ids[None, :]] = -np.inf
                top = np.argpartition(near, len(ids) - top_n, axis=1)[:, len(ids) - top_n :]
                floor = np.take_along_axis(near, top, 1).min(1) if top_n == k else np.full(len(q), -np.inf)
                # rounding must not shut out the very rows that the floor was made of
                floor -= 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
                lists = [pa.array(list(v[top]), pa.list_(kind)) for v, kind in ((ids, pa.int64()), (at_home, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(floor), *lists], ["id", "v", "cell", "floor", "sure", "sure_cells"])

    return asked.mapInArrow(run, "id long, v array<double>, cell int, floor double, sure array<long>, sure_cells array<int>")


class Block:
    """A block of queries (ids, q), ready to be held against rows of the index. floor: what a row must reach; sure: ids of rows that are reranked whatever their codes say, a list a query."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, sure: list[np.ndarray], books: np.ndarray, cells: np.ndarray, k: int, euclid: bool):
        self.ids, self.q, self.floor, self.books, self.cells, self.k, self.euclid = ids, q, floor, books, cells, k, euclid
        self.norms = np.linalg.norm(q, axis=1)
        of, to = np.repeat(np.arange(len(q)), [len(s) for s in sure]), np.concatenate([np.zeros(0, np.int64), *sure])
        order = np.argsort(to, kind="stable")
        self.sure_of, self.sure_id = of[order], to[order]

    def wants(self) -> np.ndarray:
        """[queries, cells] whether a row of the cell may reach the floor. cells: rows, largest along and off of each.

        Of n rows the best lies about sqrt(2 ln n) deviations out, by what they have across the word's direction.
        """
        n, along, off = self.cells.T
        if self.euclid:
            return np.ones((len(self.q), len(n)), bool) & (n > 0)
        first = self.books[0].astype(float)
        toward = self.q @ (first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-300)).T
        across = np.sqrt(np.maximum(self.norms[:, None] ** 2 - toward**2, 0))
        out = MARGIN + np.sqrt(2 * np.log(np.maximum(n, 2)))
        return (np.maximum(toward * along, 0) + across * (off * out / math.sqrt(self.q.shape[1])) >= self.floor[:, None]) & (n > 0)

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best k of a task's rows (id, v, codes, norm, gain, aside, cell) for each query, by lookups and an exact rerank."""
        wants, floor = self.wants(), self.floor.copy()
        levels, words, d = self.books.shape
        flat, q32 = self.books.reshape(-1, d).T, self.q.astype(np.float32)
        spread = (MARGIN * (2 if self.euclid else 1) / math.sqrt(d) * self.norms).astype(np.float32)
        lift = self.norms**2 if self.euclid else np.zeros(len(floor))
        parts = [slice(at, min(at + AT_ONCE, len(floor))) for at in range(0, len(floor), AT_ONCE)]
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in parts]

        def best(found: list[tuple[np.ndarray, ...]], part: slice) -> tuple[np.ndarray, ...]:
            """The best k of the part's queries; what a further row must reach rises with them."""
            at, score, ids = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids, -score, at))
            order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < self.k]
            at, score, ids = at[order], score[order], ids[order]
            full = np.flatnonzero(np.bincount(at - part.start, minlength=part.stop - part.start) >= self.k) + part.start
            floor[full] = np.maximum(floor[full], score[np.searchsorted(at, full, side="right") - 1])
            return at, score, ids

        def reranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
            """(query, score, id) of the pairs of a query and a row that reach the floor."""
            other = self.ids[a] != ids[b]
            a, b, exact = a[other], b[other], []
            for k in range(0, len(a), PAIRS):
                u, w = self.q[a[k : k + PAIRS]], x[b[k : k + PAIRS]]
                exact.append(-((w - u) ** 2).sum(1) if self.euclid else (w * u).sum(1))
            score = np.concatenate(exact) if exact else np.zeros(0)
            good = score >= floor[a]
            return a[good], score[good], ids[b[good]]

        def hold(queries: np.ndarray, tables: np.ndarray, rows: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, ...]:
            """Queries against rows by lookups in their tables; what may reach the floor is reranked, but for the sure pairs."""
            near, got = np.zeros((len(queries), len(rows)), np.float32), np.empty((len(queries), len(rows)), np.float32)
            for table_, code in zip(tables, codes, strict=True):
                near += np.take(table_, code[rows], axis=1, out=got, mode="clip")
            near *= gain[rows]
            if self.euclid:
                near = 2 * near - norm[rows] ** 2
            near += np.multiply(spread[queries][:, None], aside[rows][None, :], out=got)
            lifted = (floor + lift)[queries]
            hopeful = near >= lifted[:, None]
            if hopeful.mean() > DENSE:
                # so many pairs are reranked by one product of matrices; what stays is scored pair by pair, so that equal vectors have equal scores
                exact = self.q[queries] @ x[rows].T
                if self.euclid:
                    exact = 2 * exact - (x[rows] ** 2).sum(1)
                hopeful &= exact >= (lifted - 1e-9 * (1 + np.abs(lifted)))[:, None]
            a, b = np.nonzero(hopeful)
            a, b = queries[a], rows[b]
            new = ~np.isin(a * np.int64(n) + b, sure)
            return reranked(a[new], b[new])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, cell = batch.column(0).to_numpy(), batch.column(6).to_numpy()
            norm, gain, aside = (batch.column(c).to_numpy().astype(np.float32) for c in (3, 4, 5))
            x = np.asarray(batch.column(1).flatten()).reshape(n, -1)
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1).T.astype(np.intp)
            low, high = np.searchsorted(self.sure_id, ids), np.searchsorted(self.sure_id, ids, side="right")
            sure_rows = np.repeat(np.arange(n), high - low)
            sure_of = self.sure_of[np.arange(len(sure_rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
            sure = np.unique(sure_of * np.int64(n) + sure_rows)  # an id that occurs twice is sure twice
            runs = np.split(np.arange(n), np.flatnonzero(np.diff(cell)) + 1)
            if wants[:, np.unique(cell)].mean() > 0.5:  # cells tell little here
                runs = [np.arange(n)]
            wanted = [wants[:, np.unique(cell[rows])].any(1) for rows in runs]
            for i, part in enumerate(parts):
                own = sure[np.searchsorted(sure, part.start * n) : np.searchsorted(sure, part.stop * n)]
                found = [kept[i], reranked(own // n, own % n)]
                tables = np.ascontiguousarray((q32[part] @ flat).reshape(-1, levels, words).transpose(1, 0, 2))
                for rows, by in zip(runs, wanted, strict=True):
                    if len(some := np.flatnonzero(by[part])):
                        found.append(hold(some + part.start, tables if len(some) == tables.shape[1] else tables[:, some], rows, own))
                kept[i] = best(found, part)
        at, score, who = (np.concatenate(c) for c in zip(*kept, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[at], pa.int64()), pa.array(who, pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])


def sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) of the SAMPLE rows with the least hashes of ids that have the dimension most frequent there; None of an empty table."""
    few = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(few):
        return None
    few = few[few["v"].map(len) == few["v"].map(len).mode()[0]]
    return few["id"].to_numpy(), np.stack(few["v"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "ip") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query, all other vectors being candidates.

    metric: "ip" (largest inner product) or "l2" (score is minus the squared distance). Scores are exact, in double precision; equal scores go by the smaller
    id. Vectors that usable() drops take no part, null ids neither, nor do those of another dimension than the sample's most frequent. A vector id that
    occurs twice is a candidate twice and a query once (its first vector by value), and no candidate of its own queries. An empty table, or one without queries, gives an empty one.
    Only the two named columns are read, so others may have any name.
    """
    rows = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    sample = sampled(rows)
    none = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if sample is None:
        return none
    books, euclid = fit(sample[1]), metric == "l2"
    coded = stored(index(rows, books).sortWithinPartitions("cell"), "codes")
    cells = np.zeros((books.shape[1], 3))
    for r in coded.groupBy("cell").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("along").alias("a"), F.max("off").alias("o")).collect():
        cells[r["cell"]] = r["n"], r["a"], r["o"]

    # blocks of queries of neighbouring cells; a block's place is told by its cell and, where a cell has many, by a hash
    asked = coded.where(is_query).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select("id", "q.v", "q.cell")
    asked = stored(floors(asked, sample, books, k, euclid), "queries")
    blocks, taken = [[]], 0
    for r in asked.groupBy("cell").count().orderBy("cell").collect():
        parts = math.ceil(r["count"] / QUERIES)
        if parts == 1 and taken + r["count"] <= QUERIES:
            blocks[-1].append(F.col("cell") == r["cell"])
            taken += r["count"]
        else:
            blocks += [[(F.col("cell") == r["cell"]) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == i)] for i in range(parts)]
            taken = r["count"] if parts == 1 else QUERIES
    if blocks == [[]]:
        return none
    blocks = list(filter(None, blocks))
    found = None
    for conditions in blocks:
        mine = conditions[0]
        for c in conditions[1:]:
            mine = mine | c
        own = (asked.where(mine) if len(blocks) > 1 else asked).toPandas().sort_values("id")
        block = Block(own["id"].to_numpy(), np.stack(own["v"]), own["floor"].to_numpy(), list(own["sure"]), books, cells, k, euclid)
        wanted = np.union1d(np.flatnonzero(block.wants().any(0)), np.concatenate(list(own["sure_cells"]))).tolist()
        sent = spark.sparkContext.broadcast(block)
        seen = coded if len(wanted) >= np.count_nonzero(cells[:, 0]) else coded.where(F.col("cell").isin(wanted))
        part = seen.select("id", "v", "codes", "norm", "gain", "aside", "cell").mapInArrow(lambda batches, sent=sent: sent.value.scan(batches), "query_id long, id long, score double")
        if len(blocks) > 1:  # passes run in turn, so that one block is on the driver and the executors at a time
            part = stored(part, "found", narrow=True)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0)
    return found.withColumnRenamed("id", "vec_id").select("query_id", "rank", "vec_id", "score")
