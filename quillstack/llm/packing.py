"""Harmonic packing of token sequences.

Class k holds pieces longer than capacity/(k+1) and no longer than capacity/k, and a bin of class k takes exactly k of them, so
a worker fills bins by counting, without looking at other workers or searching for room. A document longer than the capacity
gives whole sequences first. A remainder that would leave its share of a class's bin too empty is cut to the next class's
full share, and the rest of it is dealt on, so bins are nearly full. Bins that are still open when a worker's input ends are poured out:
their pieces, in order, are cut freely into full sequences, and the last, shorter one into sequences of a power of two, which need no padding.

Each partition of the scan is packed alone, with no shuffle; at most `classes` bins are open at a time. A lost executor's
partition is read and packed again in the same way, and sequence ids are made of the partition's number, so they stay as well.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MODEL, CAPACITY, END = "word_bpe_49k.json", 4096, 2
#: The part of its share that an uncut piece may leave empty.
SLACK = 0.03
#: Words delimited by white space after which a worker forgets what it remembers, and characters of text that it encodes at once.
REMEMBERED, AT_ONCE = 1_500_000, 1_000_000


class WordEncoder:
    """Ids of whole texts, little-endian unsigned 32-bit. The library encodes each different word once for as long as it is remembered.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words in order. Texts with one of
    the added tokens in them go to the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec["added_tokens"]]
        parts = [spec["pre_tokenizer"], *spec["pre_tokenizer"].get("pretokenizers", [])]
        self.by_word = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] and r"[^\s" in p["pattern"].get("Regex", "") for p in parts)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix := spec["model"].get("end_of_word_suffix"):
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.marks = dict(zip(("", ".", ","), self.whole(["", ".", ","]), strict=True))
        self.words: dict[str, bytes] = {}
        self.most = REMEMBERED

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> None:
        """Learns words of letters only. Each is one unit of the tokenizer and ends with one word-end token, so one text of many can be cut."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(words):
            self.words.update(zip(words, self.whole(words), strict=True))
            return
        content, at = ids.tobytes(), 0
        for word, end in zip(words, ends, strict=True):
            self.words[word] = content[at * 4 : end * 4]
            at = end

    def learn(self, words: set[str]) -> None:
        """Words of letters, also before a full stop or comma, are learnt by their lower-cased letters; the library takes the others as they are."""
        known = self.words
        plain = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        marked = [w for w in others if w[-1:] in (".", ",") and w[:-1].isalpha()]
        stems = [w.lower() for w in plain], [w[:-1].lower() for w in marked]
        # some capitals have a lower case that isn't a letter or, as the sigma, hangs on what follows
        sure = {s for s in set().union(*stems) if s.isalpha() and "\u03c3" not in s and "\u03c2" not in s}
        if new := list(sure.difference(known)):
            self.letters(new)
        rest = [w for w in others if w[-1:] not in (".", ",") or not w[:-1].isalpha()]
        rest += [w for ws, ss in zip((plain, marked), stems, strict=True) for w, s in zip(ws, ss, strict=True) if s not in sure]
        known.update(zip(plain, map(known.get, stems[0]), strict=True))
        known.update((w, known[s] + self.marks[w[-1]]) for w, s in zip(marked, stems[1], strict=True) if s in sure)
        known.update(zip(rest, self.whole(rest), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the texts together should be some MB at most, as their words are held at once."""
        if not self.by_word:
            return self.whole(texts)
        odd = {i for i, text in enumerate(texts) if any(t in text for t in self.added)}
        # str.split takes four more characters for white space than the tokenizer does
        words = [[] if i in odd else text.replace("\n", " ").split(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split() for i, text in enumerate(texts)]
        if len(self.words) > self.most:
            self.words.clear()
        if new := set().union(*words).difference(self.words):
            self.learn(new)
        join, get = b"".join, self.words.__getitem__
        out = [join(map(get, w)) for w in words]
        for i in odd:
            out[i] = self.whole([texts[i]])[0]
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Packs one worker's documents; rows are (doc_id, start, length, crc, doc_tokens, sequence_id, offset, ids)."""

    def __init__(self, first: int, capacity: int = CAPACITY, slack: float = SLACK):
        self.next, self.capacity, self.slack = first, capacity, slack
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) >> 2
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, ids))
            at += n
        self.next += 1

    def put(self, k: int, piece: tuple) -> None:
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.close(self.open.pop(k))

    def add(self, doc: object, ids: bytes) -> None:
        c, total, at = self.capacity, len(ids) >> 2, 0
        while at < total:
            left = total - at
            k = max(1, c // left)
            size = left
            if left > c:
                size = c
            elif c // k - left > self.slack * c / k:
                k += 1
                size = min(left, c // k)
            self.put(k, (doc, at, ids[at * 4 : (at + size) * 4], total))
            at += size

    def pour(self) -> None:
        """Ends the input: what open bins hold goes into full sequences, cut at their ends, then into powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        left = sum(len(p[2]) >> 2 for p in pieces)
        room, held = 0, []
        for doc, start, ids, total in pieces:
            at, n = 0, len(ids) >> 2
            while at < n:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                size = min(room, n - at)
                held.append((doc, start + at, ids[at * 4 : (at + size) * 4], total))
                at, room, left = at + size, room - size, left - size
                if not room:
                    self.close(held)
                    held = []


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece of a document; with_ids adds `ids`, the piece's ids, little-endian unsigned 32-bit.

    Null texts count as empty; with an end id they are one token, without one they have no piece. Rows with equal or null ids
    are packed one by one; texts of any length are packed whole; an empty table gives an empty one. Only the two named columns are read, so others may have any name. sequence_id is the partition's number times 2**40 plus a count. remembered: words that a worker
    remembers, about 250 bytes each; fewer take more time and give the same rows.
    """
    tail = b"" if end is None else end.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} long" for n in names)
    kinds = [pa.int64()] * 7
    if with_ids:
        names, kinds, schema = [*names, "ids"], [*kinds, pa.binary()], schema + ", ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = word_encoder(tokenizer_path or public_tokenizers.path(MODEL))
        encoder.most = remembered
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)

        def taken() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        for batch in slices(batches):
            docs, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(docs):
                upto, size = at, 0
                while upto < len(docs) and (upto == at or size + len(texts[upto]) <= AT_ONCE):
                    size += len(texts[upto])
                    upto += 1
                for doc, ids in zip(docs[at:upto], encoder.ids(texts[at:upto]), strict=True):
                    packer.add(doc, ids + tail)
                at = upto
                yield taken()  # at once, so that no more than these texts' ids are held
        packer.pour()
        yield taken()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return source.mapInArrow(run, schema)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
