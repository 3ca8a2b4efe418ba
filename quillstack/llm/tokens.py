"""Token counts of a sentence-piece BPE model by heap-and-linked-list merging.

The pieces, ranks and byte fallback come from the model file; no library encodes here. A text is escaped as the model's
own rules say (a leading space, spaces as the meta symbol), cut into stretches that no piece crosses (before each run of meta symbols),
and each different stretch is merged once for as long as a worker remembers it: its symbols form a linked list, its mergeable
neighbours a heap by (rank, place); the lowest is popped until none is left. The count is symbols less merges, where a symbol
that the vocabulary lacks stands for as many byte tokens as its UTF-8 form has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Stretches that a worker remembers; longer ones than LONG characters are merged anew each time.
REMEMBERED, LONG = 700_000, 64
META = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value: object = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Ranks of the pieces of a BPE model with byte fallback; refuses models whose rules it doesn't know."""

    def __init__(self, path: str):
        import struct

        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        rules: dict = {}
        with open(path, "rb") as file:
            content = file.read()
        for field, value in _fields(content):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or rules.get(1) != b"identity" or rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or any(k in (4, 5) for _, _, k in pieces):
            raise ValueError("only BPE models with byte fallback, identity normalisation and normal pieces are known here")
        self.ranks = {p: -score for p, score, kind in pieces if kind == 1}
        #: whether a text may be cut before every run of meta symbols
        self.cuts = not any(a != META and b == META for p in self.ranks for a, b in zip(p, p[1:], strict=False))
        self.words: dict[str, int] = {}

    def merged(self, symbols: str) -> int:
        """Tokens of an escaped stretch."""
        n = len(symbols)
        total = sum(1 if c in self.ranks else len(c.encode()) for c in symbols)
        piece: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := symbols[i : i + 2]) in ranks]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i] if piece[i] is not None else n
            if j >= n or piece[i] + piece[j] != pair or len(pair) != len(piece[i]) + len(piece[j]):
                continue
            piece[i], piece[j] = pair, None
            total -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (longer := pair + piece[k]) in ranks:
                    heappush(heap, (ranks[longer], i, longer))
            if (h := before[i]) >= 0 and (longer := piece[h] + pair) in ranks:
                heappush(heap, (ranks[longer], h, longer))
        return total

    def word(self, word: str) -> int:
        """Tokens of META + word, remembered by word."""
        count = self.words.get(word)
        if count is None:
            count = self.merged(META + word)
            if len(word) <= LONG:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return self.merged(META + text.replace(" ", META))
        if META in text:
            text = text.replace(META, " ")
        words = text.split(" ")
        if "" in words:  # runs of spaces, or one at either end
            words = [x[1:].replace(" ", META) for x in re.findall(" +[^ ]*", " " + text)]
        counts = list(map(self.words.get, words))
        return sum(map(self.word, words)) if None in counts else sum(counts)


@cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def token_counts(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row. Null texts count as empty, an empty text has no tokens; equal rows stay; no shuffle.

    An empty table gives an empty one; null ids stay; texts of any length are counted whole. Only the two named columns are read, so others may have any name.

    model_path is read by each Python worker (None: the public model's own place there). Memory per worker: the vocabulary,
    REMEMBERED stretches, one Arrow batch; a single stretch of n characters takes n log n steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        model = piece_model(model_path or public_tokenizers.path(MODEL))
        for batch in slices(batches):
            counts = [model.count(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
