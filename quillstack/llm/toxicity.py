"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are the words it has (A-Z etc. lower-cased, letters only) and the beginnings of 4 to 6 letters of longer words. Features that set
labelled toxic texts apart are chosen by their G statistic, and those of every group term join them, whether or not a text has them; a logistic model over them is fitted with three terms: log loss,
a ridge, and the counterfactual term: each labelled text is paired with its swaps, and the square of the difference between their scores' logits
is a penalty, so that a mention alone moves no score. A text's swaps are those of every mention of a group in it (the term gives way to each other
term of its kind, or to nothing) and those of a mention that is put into it: a neutral mention of a group drawn by the text's hash, first against the text
without it, then against its kind's other terms. So the term holds where texts speak of no group by name as well. Groups are people by name, in four languages.

Fitting reads a bounded sample of the labelled rows (SAMPLE ids of each class, then SAMPLE different texts of each, by hashes; a text that is there more than once is one row
with its weight); the bias is then set back to the odds of all, so that a threshold means the same at every size. Swaps of one sort in many texts are one row with their weight. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered_columns, slices, stored, table

#: Labelled ids, and different texts of them, of each class that a fit uses at most; least G of a feature, texts that need to have it. The features are bounded by the sample.
SAMPLE, LEAST_G, LEAST_TEXTS = 6000, 6.63, 3
THRESHOLD, RIDGE, PENALTY = 0.3, 0.0002, 10.0
#: Groups whose mention is swapped; single words, each kind's terms in one row.
IDENTITIES = [
    ("women", "men", "girls", "boys"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"), ("disabled", "blind", "deaf"), ("english", "french", "german", "spanish"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés", "étrangers"), ("anglais", "français", "allemands", "espagnols"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("einwanderer", "flüchtlinge", "ausländer"), ("engländer", "franzosen", "deutsche", "spanier"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"), ("ingleses", "franceses", "alemanes", "españoles"),
]
_SWAPS = {t: [x for x in kind if x != t] for kind in IDENTITIES for t in kind}
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The words of a text, and the beginnings of longer ones (marked by a star)."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in (4, 5, 6)))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.swaps = weights, bias, 0

    def score(self, text: str) -> float:
        w = self.weights
        words = set(_WORD.findall(text.lower()))
        total = self.bias + sum(w[x] for x in words & w.keys())
        for n in (4, 5, 6):
            total += sum(w[x] for x in {x[:n] + "*" for x in words if len(x) >= n} & w.keys())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


Swap = tuple[list[int], list[int]]


def fit(rows: list[list[int]], labels: np.ndarray, names: list[str], swaps: list[Swap], weights: np.ndarray | None = None, ridge: float = RIDGE, penalty: float = PENALTY, steps: int = 500, times: np.ndarray | None = None) -> Model:
    """Minimises (weighted by times) mean log loss + ridge*|w|^2/2 + penalty*(weighted) mean over swaps of (w.(x-x'))^2/2 by accelerated gradient descent.

    rows: feature numbers of each text. swaps: feature numbers that a text loses and gains by a swap. The step is one over the loss's
    largest curvature, found by power iteration, so no labels, mentions or penalty make the descent run away.
    """
    n, m = len(rows), len(names)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.array([j for r in rows for j in r], dtype=np.int64)
    cat = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps]) if swaps else np.zeros(0, np.int64)
    ccol = np.array([j for a, b in swaps for j in (*a, *b)], dtype=np.int64)
    sign = np.array([s for a, b in swaps for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    share = np.ones(len(swaps)) if weights is None else np.asarray(weights, dtype=float)
    share = share / max(share.sum(), 1e-300)
    y = labels.astype(float)
    each = np.ones(n) if times is None else np.asarray(times, dtype=float)
    whole, pos = float(each.sum()), float((each * y).sum())

    def slope(errors: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The gradient in w and the bias (last), from the errors of the texts' scores."""
        out = np.append(np.bincount(col, errors[at], minlength=m) + ridge * w, errors.sum())
        if swaps:
            d = share * np.bincount(cat, sign * w[ccol], minlength=len(swaps))
            out[:m] += penalty * np.bincount(ccol, sign * d[cat], minlength=m)
        return out

    logits = lambda wb: np.bincount(at, wb[:m][col], minlength=n) + wb[m]
    curved, probe = 0.0, np.random.default_rng(1).random(m + 1)
    for _ in range(40):
        probe /= np.linalg.norm(probe)
        probe = slope(each * logits(probe) / (4 * whole), probe[:m])
        curved = max(curved, float(np.linalg.norm(probe)))
    now = ahead = np.append(np.zeros(m), math.log(max(pos, 1) / max(whole - pos, 1)))
    age = 1.0
    for _ in range(steps):
        g = slope(each * (1 / (1 + np.exp(-np.clip(logits(ahead), -40, 40))) - y) / whole, ahead[:m])
        new = ahead - g / (1.1 * curved)
        if g @ (new - now) > 0:  # the momentum points uphill: start it anew
            age = 1.0
        older, age = age, (1 + math.sqrt(1 + 4 * age * age)) / 2
        ahead, now = new + (older - 1) / age * (new - now), new
    return Model({names[j]: float(now[j]) for j in range(m) if abs(now[j]) > 1e-6}, float(now[m]))


@cache
def _of(term: str) -> frozenset[str]:
    return frozenset(features(term))


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """Features that the text loses and gains by each swap of a mention in it, by leaving the mention out, and by each of those of the neutral mention put into it."""
    words = set(_WORD.findall(text.lower()))
    # how many words have a feature: what one word alone has is lost with it
    held = Counter(words)
    for n in (4, 5, 6):
        held.update(w[:n] + "*" for w in words if len(w) >= n)
    out = []

    def swap(term: str, alone: int) -> None:
        own = _of(term)
        for other in _SWAPS[term]:
            if other not in words:
                new = _of(other)
                out.append(({f for f in own - new if held[f] == alone}, {f for f in new - own if not held[f]}))

    for term in sorted(words & _SWAPS.keys()):
        out.append(({f for f in _of(term) if held[f] == 1}, set()))
        swap(term, 1)
    if not words & _SWAPS.keys():
        kind = IDENTITIES[(h := zlib.crc32(text.encode("utf-8", "surrogatepass"))) % len(IDENTITIES)]
        term = kind[h // len(IDENTITIES) % len(kind)]
        out.append((set(), {f for f in _of(term) if not held[f]}))
        swap(term, 0)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, ridge: float = RIDGE, penalty: float = PENALTY) -> Model:
    """Fits on at most SAMPLE labelled texts of each class. held_out: a condition on id_col; its rows are left out. The model tells in `swaps` how many swaps held it.

    Rows with a null label or id take no part; of several labels of an id the largest counts; repeated documents count as often as they are there, as one row with a weight, so the sample holds 2 * SAMPLE
    rows at most, however often an id or a text is repeated. A null text is empty. Ties in the choice of rows go by the id and the text's hash. Without two classes, as in an empty table, nothing can be
    told apart: the model has no weights and finds no text toxic. Only the named columns are read, so others may have any name.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out is not None:
        usable = usable.where(~held_out)
    usable = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    labelled = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    first = lambda rows, y, *order: rows.where(F.col("y") == y).orderBy(F.xxhash64(*order), *order).limit(SAMPLE)
    chosen = stored(first(usable, 1, "id").unionByName(first(usable, 0, "id")), "labelled", 2 * SAMPLE)

    # the sample has a fixed bound, so its keys may be sent to every executor; the texts don't move
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    found = stored(texts.select("id", "h").join(F.broadcast(chosen), "id").groupBy("id", "h", "y").agg(F.count(F.lit(1)).alias("k")), "labelled_texts", narrow=True)
    every = {r["y"]: r["k"] for r in found.groupBy("y").agg(F.sum("k").alias("k")).collect()}
    bounded = stored(first(found, 1, "id", "h").unionByName(first(found, 0, "id", "h")), "bounded", 2 * SAMPLE)
    sample = stored(texts.join(F.broadcast(bounded), ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "y", "k", "t"), "sample", 2 * SAMPLE)
    taken = {r["y"]: r["k"] for r in sample.groupBy("y").agg(F.sum("k").alias("k")).collect()}
    n1, n0 = taken.get(1, 0), taken.get(0, 0)
    n = n1 + n0
    if not n1 or not n0:
        return Model({}, -4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each feature's toxic texts and texts, summed over a task's part of the sample."""
        toxic, every = Counter(), Counter()
        for batch in slices(batches):
            for y, k, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                for f in features(t):
                    every[f] += k
                    toxic[f] += k * y
        names = list(every)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[f] for f in part], pa.int64()), pa.array([every[f] for f in part], pa.int64())], ["f", "a", "k"])

    counts = sample.mapInArrow(count, "f string, a long, k long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("k").alias("k"))
    a, b = F.col("a") + 0.5, F.col("k") - F.col("a") + 0.5
    rate = F.lit(n1 / n)
    g = 2 * (a * F.log(a / ((a + b) * rate)) + b * F.log(b / ((a + b) * (1 - rate))))
    best = counts.withColumn("g", g).where((F.col("k") >= LEAST_TEXTS) & (F.col("g") >= LEAST_G)).select("f")
    names = sorted({r["f"] for r in best.collect()}.union(*map(_of, _SWAPS)))
    number = {f: j for j, f in enumerate(names)}

    known = lambda words: sorted(number[w] for w in words & number.keys())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The numbers of the chosen features that a text has."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([known(features(t)) for t in batch.column(3).to_pylist()], pa.list_(pa.int32()))], ["id", "y", "k", "has"])

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorts of swaps by the numbers that they lose and gain; a text's swaps share a weight of 1."""
        weight, count = Counter(), Counter()
        for batch in slices(batches):
            for times, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = counterfactuals(text)
                for old, new in own:
                    if (sort := (tuple(known(old)), tuple(known(new)))) != ((), ()):
                        weight[sort] += times / len(own)
                        count[sort] += times
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([list(a) for a, _ in weight], ints), pa.array([list(b) for _, b in weight], ints), pa.array(list(weight.values()), pa.float64()), pa.array(list(count.values()), pa.int64())], ["lost", "gained", "w", "k"])

    rows = sample.mapInArrow(numbered, "id long, y int, k long, has array<int>").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["has"]))
    # sorts are as many as swaps of the bounded sample at most, and far fewer
    sorts = sample.mapInArrow(swapped, "lost array<int>, gained array<int>, w double, k long").groupBy("lost", "gained").agg(F.sum("w").alias("w"), F.sum("k").alias("k")).collect()
    sorts.sort(key=lambda r: (r["lost"], r["gained"]))
    model = fit([r["has"] for r in rows], np.array([r["y"] for r in rows]), names, [(r["lost"], r["gained"]) for r in sorts], np.array([round(r["w"], 9) for r in sorts]), ridge, penalty, times=np.array([r["k"] for r in rows]))
    model.swaps = sum(r["k"] for r in sorts)
    share = lambda y: labelled[y] / min(labelled[y], SAMPLE) * every[y] / taken[y]
    model.bias += math.log(share(1) / share(0))
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of docs, a row per row; null texts are empty. No shuffle; the model goes along with the tasks.

    A text of any length is scored whole, and equal texts alike; an empty table gives an empty one. Only the two named columns are read, so others may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, in docs' columns; only the text is looked at.

    Null texts are empty; texts of any length are scored whole; repeated rows stay or go together; an empty table gives an empty one. Columns pass through
    whatever their names, none is added on the way.
    """
    schema, names = docs.schema, docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [model.score(t or "") < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_())).rename_columns(names)

    return numbered_columns(docs).mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = scored(docs, train(docs, labels, held_out=is_held_out()))
    return found.select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
