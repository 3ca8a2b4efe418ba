"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to overlapping shards: a node's home is the shard of its nearest centroid, and it visits the shards whose border with
its home it is near to. How near is told by a margin, which is chosen so that nearly all pairs that just link meet in the home of one of the two; a
margin as wide as a link is long brings all pairs together, which is the exact way where an audit finds the first one short.

In a shard the graph is built on overlapping cells: the nearest members of every node, pruned robustly (a neighbour goes if a kept one is
closer to it by the factor ALPHA than the node is), plus reverse edges; a node's lists from all its cells are united. Then every node at home there is searched in
the united graph: a greedy beam search starts at the cells' medoids, and from every hit in range the search expands until no new hit is met. Hits are
verified by cosine in double precision, and a node with a hit is held against its whole shard, so its links there are complete.

Shards of more than FULL nodes (a third of all rows may be near copies) are split into parts, and each two parts are a task of their own, so
a task's memory is bounded. No pair leaves a task: counts and a spanning forest do. A pair counts in one shard: the lesser of its two homes that both are in.
What a task finds for another shard is told apart by it and counts only if the node had no hit there.

The audit holds seeded nodes against all others, some of those with few, more and many links found and as many of those with none as it takes to
tell that few of them have any. If the recall is below WANTED, shards are made anew with the widest margin and held against each other in full.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, stored, table

THRESHOLD = 0.95
#: Nodes at home in a shard that are aimed at, nodes of a shard above which it is split, rows of the sample that centroids are fitted on, centroids of a level at most, shards at most.
SHARD, FULL, SAMPLE, LEVEL, MOST = 2500, 8000, 16384, 128, 8192
#: Nodes of a cell of a shard that are aimed at, cells of a node, nodes of a cluster that has a medoid, candidates and kept neighbours of a node, pruning factor, beam width.
CELL, OVERLAP, CLUSTER, POOL, DEGREE, ALPHA, BEAM = 500, 2, 10, 16, 8, 1.2, 10
#: The share of pairs that just link and must meet, nodes that the margin is chosen by.
MEET, TRIED = 0.99, 2048
#: Nodes audited of each class with links, of those without at most, the recall asked for.
AUDITED, AUDITED_MOST, WANTED = 256, 8192, 0.97
#: Parts of a shard are fewer than this.
PLACE = 1 << 24


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(x: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbours [n, 2 * DEGREE] of the unit vectors x; places without one hold the node itself."""
    n = len(x)
    pool = min(POOL, n - 1)
    out = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, 2 * DEGREE))
    if pool < 1:
        return out
    f = x.astype(np.float32)
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        s = f[rows] @ f.T
        s[np.arange(len(rows)), rows] = -2
        near = np.argpartition(s, n - pool, axis=1)[:, n - pool :]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        dq = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, near, 1)))
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(f[near], f[near].transpose(0, 2, 1))))
        alive = np.ones(near.shape, bool)
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            r = np.flatnonzero(some)
            out[rows[r], k] = near[r, pick[r]]
            alive[r, pick[r]] = False
            alive[r] &= ~(ALPHA * between[r, pick[r]] <= dq[r])
    a, b = np.repeat(np.arange(n), DEGREE), out[:, :DEGREE].ravel()
    real = a != b
    a, b = a[real], b[real]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    nth = np.arange(len(b)) - np.searchsorted(b, b)
    few = nth < DEGREE
    out[b[few], DEGREE + nth[few]] = a[few]
    return out


def centroids(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(5):
        near = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


def united(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(graph, medoids) of a shard's unit vectors: lists over overlapping cells, united, [n, OVERLAP * 2 * DEGREE]; places without a neighbour hold the node itself.

    Medoids are those of small clusters, so that a search sets out near to where it goes.
    """
    n = len(x)
    few = x[:: max(1, n // 4096)]
    c = centroids(few, math.ceil(n / CELL))
    overlap = min(OVERLAP, len(c))
    cells = np.argsort(-(x @ c.T - (c * c).sum(1) / 2), axis=1, kind="stable")[:, :overlap]
    graph = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, overlap * 2 * DEGREE))
    for k in range(len(c)):
        members, slot = np.nonzero(cells == k)
        if not len(members):
            continue
        lists = members[build(x[members])]
        for s in range(overlap):
            here = slot == s
            graph[members[here], s * 2 * DEGREE : (s + 1) * 2 * DEGREE] = lists[here]
    c = centroids(few, math.ceil(n / CLUSTER))
    return graph, np.unique((x @ c.T - (c * c).sum(1) / 2).argmax(0))


def in_range(x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, asked: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """[len(asked), n] bool: what range-expanding greedy searches from the medoids find at cosine threshold or more of the asked nodes (not the node itself)."""
    n, width = graph.shape
    f, hit = x.astype(np.float32), np.zeros((len(asked), n), bool)
    loose = np.float32(threshold - 1e-5)  # walked in single precision, verified in double
    for at in range(0, len(asked), 256):
        q = asked[at : at + 256]
        m, rows = len(q), np.arange(len(q))
        seen, good = np.zeros((m, n), bool), np.zeros((m, n), bool)
        seen[:, medoids] = True
        near = f[q] @ f[medoids].T
        good[:, medoids] = near >= loose
        beam = np.tile(medoids[None, :], (m, 1))
        if beam.shape[1] > BEAM:
            top = np.argpartition(-near, BEAM - 1, axis=1)[:, :BEAM]
            beam, near = np.take_along_axis(beam, top, 1), np.take_along_axis(near, top, 1)
        done = np.zeros(beam.shape, bool)
        while len(act := np.flatnonzero(~done.all(1))):
            best = np.where(done[act], -3, near[act]).argmax(1)
            node = beam[act, best]
            done[act, best] = True
            nb = graph[node]
            new = ~seen[act[:, None], nb]
            seen[act[:, None], nb] = True
            s = np.where(new, np.einsum("qd,qrd->qr", f[q[act]], f[nb]), np.float32(-2))
            good[act[:, None], nb] |= s >= loose
            both, sims, over = np.concatenate([beam[act], nb], 1), np.concatenate([near[act], s], 1), np.concatenate([done[act], ~new], 1)
            # a node that stands in a list twice is new twice there: its second place is struck out
            order = np.argsort(both, axis=1, kind="stable")
            twice = np.zeros(both.shape, bool)
            np.put_along_axis(twice, order[:, 1:], np.diff(np.take_along_axis(both, order, 1), axis=1) == 0, 1)
            sims[twice & (np.arange(both.shape[1]) >= beam.shape[1])] = -2
            if both.shape[1] > BEAM:
                top = np.argpartition(-sims, BEAM - 1, axis=1)[:, :BEAM]
                both, sims, over = (np.take_along_axis(v, top, 1) for v in (both, sims, over))
            if both.shape[1] != beam.shape[1]:
                grow = both.shape[1] - beam.shape[1]
                beam, near, done = np.pad(beam, ((0, 0), (0, grow))), np.pad(near, ((0, 0), (0, grow)), constant_values=-2), np.pad(done, ((0, 0), (0, grow)), constant_values=True)
            beam[act], near[act], done[act] = both, sims, over | (sims < -1)
        i, j = np.nonzero(good)
        while len(i):
            a, b = np.repeat(i, width), graph[j].ravel()
            new = ~seen[a, b]
            key = np.unique(a[new] * np.int64(n) + b[new])
            a, b = key // n, key % n
            seen[a, b] = True
            ok = np.concatenate([np.einsum("pd,pd->p", f[q[a[k : k + 65536]]], f[b[k : k + 65536]]) >= loose for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            i, j = a[ok], b[ok]
            good[i, j] = True
        good[rows, q] = False
        i, j = np.nonzero(good)
        true = np.concatenate([np.einsum("pd,pd->p", x[q[i[k : k + 65536]]], x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        hit[at + i[true], j[true]] = True
    return hit


def all_in_range(x: np.ndarray, asked: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """[len(asked), n] bool: what in_range() looks for, by every pair."""
    hit = np.concatenate([x[asked[k : k + 256]] @ x.T >= threshold for k in range(0, len(asked), 256)] or [np.zeros((0, len(x)), bool)])
    hit[np.arange(len(asked)), asked] = False
    return hit


def completed(x: np.ndarray, asked: np.ndarray, hit: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """hit with every link between an asked node and any other of the nodes that have one, and of those so met: a pair is missing only if neither of the two has any hit."""
    at = np.full(len(x), -1)
    at[asked] = np.arange(len(asked))
    done = np.zeros(len(x), bool)
    while True:
        linked = hit.any(0)
        linked[asked] |= hit.any(1)
        todo = np.flatnonzero(linked & ~done)
        if not len(todo):
            return hit
        for k in range(0, len(todo), 256):
            rows = todo[k : k + 256]
            near = x[rows] @ x.T >= threshold
            near[np.arange(len(rows)), rows] = False
            hit[:, rows] |= near[:, asked].T
            own = at[rows] >= 0
            hit[at[rows[own]]] |= near[own]
        done[todo] = True


def forest(asked: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """For each node the first asked node that it hangs together with over hits, or itself."""
    n = hit.shape[1]
    root, at = np.arange(n), np.full(n, -1)
    at[asked] = np.arange(len(asked))
    left = hit.any(1)
    reached = np.zeros(n, bool)
    while left.any():
        start = int(left.argmax())
        front = np.array([start])
        left[start] = False
        reached[asked[start]] = True
        root[asked[start]] = asked[start]
        while len(front):
            new = np.flatnonzero(hit[front].any(0) & ~reached)
            reached[new] = True
            root[new] = asked[start]
            # asked nodes among the new ones, and those that have a hit on a new one
            also = np.flatnonzero(left & hit[:, new].any(1)) if len(new) else new
            front = np.union1d(at[new][at[new] >= 0], also).astype(np.int64)
            front = front[left[front]]
            left[front] = False
            reached[asked[front]] = True
            root[asked[front]] = asked[start]
    return root


class Shards:
    """The centroids: one level of them, or a level of centroids that have their own below. A shard is a centroid of the last level."""

    def __init__(self, sample: np.ndarray, want: int):
        want = max(1, min(want, MOST, len(sample)))
        first = want if want <= LEVEL else math.ceil(math.sqrt(want))
        self.top = centroids(sample, first)
        self.below: list[np.ndarray] = []
        if want > LEVEL:
            near = _margins(sample, self.top)[0]
            for k in range(len(self.top)):
                own = sample[near == k]
                self.below.append(centroids(own, max(1, min(len(own), round(want * len(own) / len(sample))))) if len(own) else self.top[k : k + 1])
        self.starts = np.cumsum([0, *map(len, self.below)]) if self.below else np.arange(len(self.top) + 1)

    def __len__(self) -> int:
        return int(self.starts[-1])

    def near(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(home of each row, and row, shard, margin of the shards that a row is at home in or is at most `reach` from the border of)."""
        home, margin = _margins(x, self.top)
        row, shard = np.nonzero(margin <= reach)
        far = margin[row, shard]
        if not self.below:
            return home, row, shard, far
        homes, rows, shards, fars = np.zeros(len(x), np.int64), [], [], []
        for k, below in enumerate(self.below):
            here = np.flatnonzero(shard == k)
            if len(here):
                own, inner = _margins(x[row[here]], below)
                mine = home[row[here]] == k
                homes[row[here][mine]] = self.starts[k] + own[mine]
                a, b = np.nonzero(inner <= reach)
                rows.append(row[here][a])
                shards.append(self.starts[k] + b)
                fars.append(np.maximum(far[here][a], inner[a, b]))
        return homes, *(np.concatenate(v) for v in (rows, shards, fars))

    def margin(self, x: np.ndarray, longest: float, threshold: float) -> float:
        """The least margin at which MEET of the pairs of a row of x and another vector just in range meet in the home of either; `longest` is enough for all."""
        rng = np.random.default_rng(7)
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        other = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * unit(aside + 1e-12)
        need = np.full(len(x), longest)
        homes = []
        for v in (x, other):
            homes.append(self.near(v, longest))
        for (_, row, shard, far), (home, *_) in (homes, homes[::-1]):
            to = shard == home[row]
            np.minimum.at(need, row[to], far[to])
        return min(longest, float(np.quantile(need, MEET)))


def _margins(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, [n, k] distance to the border between the nearest centroid's region and that of each)."""
    size = (c * c).sum(1)
    d = size - 2 * x @ c.T
    home, rows = d.argmin(1), np.arange(len(x))
    gap = np.sqrt(np.maximum(size[home][:, None] + size[None, :] - 2 * (c @ c.T)[home], 1e-300))
    margin = np.maximum(d - d[rows, home][:, None], 0) / (2 * gap)
    margin[gap < 1e-9] = 0
    return home, margin


FOUND = "rep long, links double, root long, alive array<long>, places array<long>, sums array<double>"


def _attempt(nodes: DataFrame, n: int, dimension: int, threshold: float, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rep, links) and forest edges (a, b) over nodes (rep, v, n). exact: with the widest margin, and every pair of a shard."""
    sample = unit(np.stack(nodes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toPandas()["v"]))
    shards, longest = Shards(sample, math.ceil(n / SHARD)), math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9)
    reach = longest if exact else shards.margin(sample[:TRIED], longest, threshold)
    vector = nodes.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, row, shard, _ = shards.near(unit(np.asarray(batch.column(1).flatten()).reshape(-1, dimension)), reach)
                order = np.lexsort((shard, row))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)), pa.int32()), pa.array(shard[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(home, pa.int64()), lists], ["rep", "v", "n", "home", "visits"])

    placed = stored(nodes.select("rep", "v", "n").mapInArrow(assign, f"rep long, v {vector}, n long, home long, visits array<long>"), "placed")
    placed = placed.withColumn("lot", F.pmod(F.xxhash64("rep"), F.lit(PLACE)))
    # powers of two, so that the parts of shards nest; shards are MOST at most
    sizes = placed.select(F.explode("visits").alias("shard")).groupBy("shard").agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(F.count(F.lit(1)) / FULL)))).cast("long").alias("parts"))
    split = {r["shard"]: r["parts"] for r in sizes.where("parts > 1").collect()}
    parts = F.lit(1).cast("long")
    if split:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in split.items() for x in pair]), F.col("shard")), parts)
    member = placed.withColumn("shard", F.explode("visits")).withColumn("parts", parts).withColumn("part", F.col("lot") % F.col("parts"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    member = member.select("rep", "v", "n", "home", "visits", "lot", "shard", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def found(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rep")
        shard, i, j = key
        ids, weight, home, part, lot = (t[c].to_numpy() for c in ("rep", "n", "home", "part", "lot"))
        x, n = unit(np.stack(t["v"].to_numpy())), len(t)
        asked = np.flatnonzero(home == shard)
        at = np.full(n, -1)
        at[asked] = np.arange(len(asked))
        hit = all_in_range(x, asked, threshold) if exact else completed(x, asked, in_range(x, *united(x), asked, threshold), threshold)
        if i != j:
            hit &= part[asked][:, None] != part[None, :]
        links, some = np.zeros(n), hit.any(0)
        some[asked] |= hit.any(1)
        who, where, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if some.any():
            own = home == shard
            others = np.flatnonzero(~own & hit.any(0))
            # does an asked node visit the home of the other?
            names, of = np.unique(home[others], return_inverse=True)
            visited = np.zeros((len(asked), len(names)), bool)
            if len(names):
                lists = t["visits"].to_numpy()[asked]
                row, to = np.repeat(np.arange(len(asked)), [len(v) for v in lists]), np.concatenate(list(lists))
                k = np.minimum(np.searchsorted(names, to), len(names) - 1)
                visited[row[names[k] == to], k[names[k] == to]] = True
            scale = np.array([split.get(int(a), 1) for a in names], dtype=np.int64)
            for k in range(0, len(asked), 256):
                rows = asked[k : k + 256]
                links[rows] += hit[k : k + 256][:, own] @ weight[own].astype(float)
                a, b = np.nonzero(hit[k : k + 256][:, others])
                u, v, h = rows[a], others[b], of[b]
                elsewhere = visited[a + k, h] & (names[h] < shard) if len(names) else np.zeros(0, bool)
                here = ~elsewhere
                links += np.bincount(u[here], weight[v[here]], minlength=n) + np.bincount(v[here], weight[u[here]], minlength=n)
                u, v, h = u[elsewhere], v[elsewhere], h[elsewhere]
                # for each end the part of that shard in which the other is
                for one, two in ((u, v), (v, u)):
                    place = names[h] * PLACE + lot[two] % scale[h]
                    pairs, to = np.unique(np.stack([one, place]), axis=1, return_inverse=True)
                    who.append(pairs[0])
                    where.append(pairs[1])
                    sums.append(np.bincount(to.ravel(), weight[two], minlength=pairs.shape[1]))
        root = forest(asked, hit)
        who, where, sums = map(np.concatenate, (who, where, sums))
        order = np.argsort(who, kind="stable")
        who, where, sums = who[order], where[order], sums[order]
        pick = np.flatnonzero(some)
        cuts = np.searchsorted(who, pick), np.searchsorted(who, pick, side="right")
        across = part if i == j else i + j - part  # the part that a node was held against
        list_of = lambda v: pd.Series([v[a:b] for a, b in zip(*cuts, strict=True)], dtype=object)  # noqa: E731  # without a dtype no rows make no lists
        alive = pd.Series([[int(shard) * PLACE + int(across[k])] for k in pick], dtype=object)
        return pd.DataFrame({"rep": ids[pick], "links": links[pick], "root": ids[root[pick]], "alive": alive, "places": list_of(where), "sums": list_of(sums)})

    searched = stored(member.groupBy("shard", "i", "j").applyInPandas(found, FOUND), "found")
    every = searched.groupBy("rep").agg(F.sum("links").alias("links"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("alive", "places", "sums")])
    late = F.filter(F.arrays_zip("places", "sums"), lambda z: ~F.array_contains("alive", z["places"]))
    links = every.select("rep", (F.col("links") + F.aggregate(late, F.lit(0.0), lambda s, z: s + z["sums"])).cast("long").alias("links"))
    return links, searched.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def _true_links(nodes: DataFrame, few: pd.DataFrame, dimension: int, threshold: float) -> dict[int, int]:
    """{rep: links} of the few (rep, v), held against all nodes. They are AUDITED_MOST and three times AUDITED at most and go along with the tasks."""
    if not len(few):
        return {}
    ids, q = few["rep"].to_numpy(), unit(np.stack(few["v"]))
    f = q.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.zeros(len(ids))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x, weight, own = unit(np.asarray(part.column(1).flatten()).reshape(-1, dimension)), part.column(2).to_numpy(), part.column(0).to_numpy()
                a, b = np.nonzero(f @ x.T.astype(np.float32) >= threshold - 1e-5)
                true = ((q[a] * x[b]).sum(1) >= threshold) & (ids[a] != own[b])
                links += np.bincount(a[true], weight[b[true]], minlength=len(ids))
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some])], ["rep", "links"])

    held = nodes.select("rep", "v", "n").mapInArrow(run, "rep long, links double").groupBy("rep").agg(F.sum("links").alias("links"))
    return dict.fromkeys(ids.tolist(), 0) | {r["rep"]: int(r["links"]) for r in held.collect()}


def _recall(nodes: DataFrame, links: DataFrame, n: int, dimension: int, threshold: float) -> tuple[float | None, int]:
    """The mean share of a linked node's links that was found, by strata, and the nodes audited; None if no link is known.

    Nodes with 1, up to 15 and more links found are strata, and those with none: of these so many are taken that as few as would spoil the recall should show.
    """
    classes = F.when(F.col("links") <= 1, 1).when(F.col("links") <= 15, 2).otherwise(3)
    linked = links.where("links > 0").withColumn("class", classes)
    sizes = {r["class"]: r["count"] for r in linked.groupBy("class").count().collect()}
    n_linked, drawn = sum(sizes.values()), F.xxhash64(F.lit("audit"), "rep")
    few = []
    for k in sizes:
        few.append(linked.where(F.col("class") == k).orderBy(drawn, "rep").limit(AUDITED).select("rep", "links", "class"))
    none = n - n_linked
    enough = min(none, AUDITED_MOST, math.ceil(3 * none / max(1.0, (1 - WANTED) * n_linked)))
    chosen = nodes.select("rep").join(linked.select("rep"), "rep", "left_anti").orderBy(drawn, "rep").limit(enough).select("rep", F.lit(0).cast("long").alias("links"), F.lit(0).alias("class"))
    for f in few:
        chosen = chosen.unionByName(f)
    got = nodes.select("rep", "v").join(F.broadcast(chosen), "rep").toPandas()
    truth = _true_links(nodes, got, dimension, threshold)
    total = lost = 0.0
    for k, size in ({0: none} | sizes).items():
        own = got[got["class"] == k]
        true = np.array([truth[r] for r in own["rep"]], dtype=float)
        has = true > 0
        if has.any():
            share = np.minimum(own["links"].to_numpy()[has] / true[has], 1)
            total += size * has.mean()
            lost += size * has.mean() * (1 - share.mean())
    return (None if not total else 1 - lost / total), len(got)


def _linked(nodes: DataFrame, n: int, dimension: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """An _attempt() whose recall is WANTED or more, or the exact one."""
    links, edges = _attempt(nodes, n, dimension, threshold)
    links = stored(links, "links", n)
    recall, audited = _recall(nodes, links, n, dimension, threshold)
    if recall is None and audited < n:
        warnings.warn(f"near_duplicates: no link was found, and none of {audited} audited nodes of {n} has one; the recall isn't known", stacklevel=2)
    if recall is not None and recall < WANTED:
        return _attempt(nodes, n, dimension, threshold, exact=True)
    return links, edges


def _usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component), a row per row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component, as are those whose dimension isn't the most frequent one.
    Equal vectors link with each other (n_links counts rows); equal ids are rows of their own. Rows with a null id link with nothing and have component null. An empty table gives an empty one.
    Only the two named columns are read, so others may have any name. Vectors are nodes by two 64-bit hashes of their components.
    """
    element = vectors.schema[vector_col].dataType
    kind = "float" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.withColumn("usable", F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = rows.where("usable").groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    if not sizes:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    dimension = sizes[0]["d"]
    # 0 and -0 are equal
    rows = rows.withColumn("usable", F.col("usable") & (F.size("v") == dimension)).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    rows = rows.withColumn("rep", F.when(F.col("usable"), F.xxhash64("v"))).withColumn("twin", F.when(F.col("usable"), F.xxhash64(F.lit("twin"), "v")))
    nodes = rows.where("usable").groupBy("rep", "twin").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = stored(nodes, "nodes")
    n = nodes.count()
    links, edges = _linked(nodes, n, dimension, threshold)
    joined = components(stored(edges, "edges", n), "a", "b", n)
    of = nodes.select("rep", "twin", "least", "n").join(links, "rep", "left").join(joined, F.col("rep") == joined["node"], "left")
    of = of.select("rep", "twin", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"), "least")
    of = of.join(of.groupBy("group").agg(F.min("least").alias("component")), "group").select("rep", "twin", "n_links", "component")
    found = rows.select("id", "rep", "twin").join(of, ["rep", "twin"], "left")
    return found.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def op10_flat_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
