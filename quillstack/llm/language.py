"""Language identification by rank-order profiles.

A text's n-grams are the runs of one to three characters inside its words (letters and their marks, lower-cased), a mark before and after each word counted as a character.
A language's profile is its most frequent n-grams in all its learning texts, in order. A document's own most frequent n-grams are held against each profile: an
n-gram is as far out of place as its two ranks differ, or as a profile is long where the profile lacks it; the language with the least sum is predicted.

An n-gram is a whole number, its characters' 21 bits side by side, so a text's are made and counted as arrays, a bounded piece of the text at a time.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, table
from .toxicity import is_held_out

#: Length of a profile, languages that may be learned at most (an error beyond: profiles go to every task).
RANKS, LANGUAGES = 300, 10_000
UNKNOWN = "und"
#: Characters of a text that are worked on at once; n-grams that a learning task gathers before it counts them, different ones that it holds before it hands them on.
PIECE, GATHERED, HELD = 1 << 19, 1 << 21, 250_000
#: What stands before and after a word; no letter has this number.
_EDGE, _BITS = 1, 21


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it is part of a word, and whether it is a letter."""
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    return (kinds == ord("L")) | (kinds == ord("M")), kinds == ord("L")


def _pieces(text: str) -> Iterator[np.ndarray]:
    for at in range(0, len(text), PIECE):
        yield np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, in pieces; each is given by the piece where it ends. Nothing for a text without a letter."""
    if not any(_kinds()[1][codes].any() for codes in _pieces(text)):
        return
    inside, low = _kinds()[0], text.lower()
    before, left = np.array([_EDGE], np.int64), len(low)
    for codes in _pieces(low):
        left -= len(codes)
        s = np.concatenate([before, np.where(inside[codes], codes, _EDGE).astype(np.int64), np.full(int(not left), _EDGE)])
        new = len(before)
        solid = s != _EDGE
        solid[:new] = True
        solid[new:] |= s[new - 1 : -1] != _EDGE
        s = s[solid]
        one, two = s[new:], (s[new - 1 : -1] << _BITS) | s[new:]
        at = max(new, 2)
        middle = s[at - 1 : -1]
        three = ((s[at - 2 : -2] << 2 * _BITS) | (middle << _BITS) | s[at:])[middle != _EDGE]
        yield np.concatenate([one[one != _EDGE], two, three])
        before = s[-2:]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams, ascending, and their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[starts], np.add.reduceat(counts[order], starts) if len(ids) else counts


def profile(text: str, ranks: int = RANKS) -> np.ndarray:
    """A text's most frequent n-grams, ties to the smaller number."""
    counted = [np.unique(part, return_counts=True) for part in grams(text)]
    ids, counts = counted[0] if len(counted) == 1 else _summed(counted)
    return ids[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """Ranks of n-grams in each language's profile, by n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS):
        """rows: (lang, gram, rank from 0)."""
        self.langs, self.ranks = sorted({r[0] for r in rows}), ranks
        number = {lang: i for i, lang in enumerate(self.langs)}
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        grams = np.array([r[1] for r in rows], np.int64)
        self.of, self.place = np.array([number[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        self.grams, self.starts, self.sizes = np.unique(grams, return_index=True, return_counts=True)

    def predict(self, text: str) -> tuple[str, float]:
        """(language, 1 less the share of the largest distance that there is); ties to the smaller language."""
        own = profile(text, self.ranks)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == own)
        sizes = self.sizes[at[hit]]
        entry = np.repeat(self.starts[at[hit]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        nearer = self.ranks - np.minimum(np.abs(np.repeat(hit, sizes) - self.place[entry]), self.ranks)
        most = self.ranks * len(own)
        distance = most - np.bincount(self.of[entry], nearer, minlength=len(self.langs))
        best = int(np.argmin(distance))
        return self.langs[best], 1 - float(distance[best]) / most


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, ranks: int = RANKS) -> Profiles:
    """Profiles of each language over all its texts. held_out: a condition on id_col; its rows are left out.

    Rows with a null language, text or id take no part; repeated rows count as often as they are there; equally frequent n-grams are ranked by their number. A language none of whose texts has a letter
    isn't learned; without any, as in an empty table, every text is unknown. What reaches the driver is `ranks` rows a language; more than LANGUAGES languages are an error.
    """
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if held_out is not None:
        usable = usable.where(~held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        n = 0

        def counted() -> None:
            for lang, parts in waiting.items():
                found = np.unique(np.concatenate(parts), return_counts=True)
                held[lang] = _summed([held[lang], found]) if lang in held else found
            waiting.clear()

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (ids, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in grams(text):
                    waiting[lang].append(part)
                    n += len(part)
                    if n > GATHERED:
                        counted()
                        n = 0
            if sum(len(ids) for ids, _ in held.values()) > HELD:
                yield from told()
        counted()
        yield from told()

    rows = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).mapInArrow(run, "lang string, gram long, n long")
    summed = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")) - 1).where(F.col("rank") < ranks)
    found = ranked.select("lang", "gram", "rank").limit(LANGUAGES * ranks + 1).collect()
    if len(found) > LANGUAGES * ranks:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    return Profiles([tuple(r) for r in found], ranks)


def predicted(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) of docs, a row per row: the language whose profile is nearest, and how near, 0 to 1.

    A null text, an empty one and one without a letter are `und`, score 0. Texts are read whole, in pieces; equal texts are told alike; ties go to the smaller language. An empty table gives an empty one. No
    shuffle; the profiles, of a bounded size, go along with the tasks. Only the two named columns are read, so others may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [profiles.predict(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang string, score double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predicted(docs, learn(docs, held_out=is_held_out()))
    return found.select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), F.col("lang").alias("lang_pred"), "score")
