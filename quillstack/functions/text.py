"""Column functions on text: tokens, sentences, titles, previews, rules of conversation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that are no titles, sentences, conversation rules, phrases that lean on what was said before.
TOC_LABELS = ["目录", "contents", "content"]
SENTENCE = r"[^。！？!?]+[。！？!?]?"
INJECTION = [r"忽略.*?(之前|上面|前面).*?指令", r"ignore.*?previous.*?instruction", "你现在是", "扮演", "system prompt", "越狱"]
SMALL_TALK = [
    r"(你好|您好|hi|hello|嗨|哈喽)[！!。，,\s]*", r"(谢谢|感谢|多谢|thanks|thank you)[！!。，,\s]*",
    r"(好的|好|明白|明白了|了解|收到|ok|okay|没问题)[！!。，,\s]*", r"(再见|拜拜|bye|goodbye)[！!。，,\s]*",
]
LEANS_ON_CONTEXT = [r"^第\s*\d+\s*步", r"\b这(个|一步|步)\b", r"\b那(个|一步|步)\b", r"\b它\b", "具体是什么", "什么意思", "怎么做"]
#: A Han letter, a run of letters and digits, or one other sign. What begins in ASCII is told first, as telling scripts apart is slow.
TOKEN = r"[a-zA-Z0-9][a-zA-Z0-9\p{L}\p{N}]*+|(?=\S)(?:\p{IsHan}|[\p{L}\p{N}]++|[^\s\p{L}\p{N}])"
TERM = r"[a-z0-9\p{L}\p{N}]++"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def lines(c: Column) -> Column:
    """The lines of a text at every kind of line end; an end after the last line opens no further one, and an empty text has none."""
    unix = F.regexp_replace(F.regexp_replace(c, "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", "\n"), r"\n\z", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(unix, "\n"))


def clean_title(c: Column) -> Column:
    """One line, without a trailing page number or leader dots."""
    return strip(F.regexp_replace(collapse(c), r"[\d\s.。…]+\z", ""))


def slug(name: Column) -> Column:
    """Of a file's name, its ending aside: lower-cased ASCII letters and digits; else the stem without path signs, dots and space; else a hash of the name."""
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")
    ascii_only = F.regexp_replace(F.lower(stem), "[^a-z0-9]", "")
    names = F.regexp_replace(stem, r'(?U)[\\/:*?"<>|\s.]+', "")
    return F.coalesce(F.nullif(ascii_only, F.lit("")), F.nullif(names, F.lit("")), F.concat(F.lit("pdf_"), F.substring(F.sha2(name, 256), 1, 12)))


def token_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(TOKEN))


#: From an array of texts to an array of their token counts: what the operators that count tokens take for `counts`, where None is the pattern above.
Counts = Callable[[Column], Column]


def model_counts(make: Callable[[], Callable[[list[str]], list[int]]], at_once: int = 256) -> Counts:
    """Counts by a given tokenizer, in Arrow batches. make() gives a function from texts to their numbers of tokens; it is called once a task, and the function is handed `at_once` different texts at a time, null ones as empty."""

    @F.arrow_udf("array<int>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = make()
        for lists in batches:
            told = lists.flatten().fill_null("").dictionary_encode()
            known = np.zeros(len(told.dictionary), np.int32)
            for k in range(0, len(known), at_once):  # no more than `at_once` texts are Python objects at a time
                part = told.dictionary.slice(k, at_once).to_pylist()
                known[k : k + len(part)] = [n for _, n in zip(part, count(part), strict=True)]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(known[told.indices.to_numpy(zero_copy_only=False)]), mask=lists.is_null())

    return counted


def counts_of(parts: Column, counts: Counts | None = None) -> Column:
    """The number of tokens of each text of an array."""
    return F.transform(parts, token_count) if counts is None else counts(parts)


def count_of(c: Column, counts: Counts | None = None) -> Column:
    """The number of tokens of a text."""
    return token_count(c) if counts is None else F.get(counts(F.array(c)), F.lit(0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def sentences(c: Column) -> Column:
    """Sentences without surrounding space, and none that is empty; the whole text if it has no sentence, nothing of a blank one."""
    text = F.coalesce(c, F.lit(""))
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")
    whole = lambda f: F.when((F.size(f) == 0) & (strip(text) != ""), F.array(strip(text))).otherwise(f)
    return F.get(F.transform(F.array(found), whole), F.lit(0))  # what is found has a name, so it is looked for once


def preview(c: Column, n: int = 60) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"\r?\n", " ")), 1, n)


def is_injection(c: Column) -> Column:
    return strip(F.lower(F.coalesce(c, F.lit("")))).rlike("(?s)" + "|".join(INJECTION))


def is_small_talk(c: Column) -> Column:
    return strip(F.lower(F.coalesce(c, F.lit("")))).rlike(r"(?U)\A(?:" + "|".join(SMALL_TALK) + r")\z")


def leans_on_context(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))).rlike("(?Ui)" + "|".join(LEANS_ON_CONTEXT))
