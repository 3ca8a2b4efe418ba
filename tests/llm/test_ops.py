"""The operators against brute force, the libraries or held-out rows, and on awkward tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstack.llm import additive, chat, flatgraph, mixing, packing, pii, registry, simhash, tokens, toxicity, urls

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, id long, fp long, block long"  # id, fp, block: names that operators use inside
LONG = "word " * 60000
ODD = [None, "", " \t\n", "a", "same text here now", "same text here now", LONG, "é日本 😀 ▁x  y ", "<|endoftext|> <s> \x1f a", "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "b", "a"][i % 3], 7, 8, 9) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def roots(n, edges):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_token_counts_equal_the_library(spark, docs, odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    for frame in (docs, odd):
        rows = {(r.doc_id, r.text) for r in frame.collect()}
        got = {(r.id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(frame).collect()}
        assert got == {(i, len((t or "").encode()), len(lib.encode(t or "", num_threads=1))) for i, t in rows}
    assert tokens.token_counts(odd).count() == odd.count()
    assert tokens.token_counts(empty).count() == 0


def test_merging_by_random_texts():
    import sentencepiece

    lib, model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL)), tokens.piece_model(public_tokenizers.path(tokens.MODEL))
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("ab  ▁é\n日😀theing") for _ in range(rng.randint(0, 60)))
        assert model.count(t) == len(lib.encode(t))


def check_packing(frame):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    texts = Counter((r.doc_id, r.text or "") for r in frame.collect())
    rows = packing.pack(frame).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for (doc, text), times in texts.items():
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, packing.END], dtype="<u4")
        for r in pieces[doc]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        cover = Counter(k for r in pieces[doc] for k in range(r.start, r.start + r.length))
        assert set(cover) == set(range(len(ids))) and set(cover.values()) == {times}
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding / max(1, sum(r.length for r in rows))


def test_packing(docs, odd, empty):
    assert check_packing(docs) < 0.02
    check_packing(odd)
    assert packing.pack(empty).count() == 0


def fingerprint_by_hand(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, odd, empty, docs):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert r.fp % 2**64 == fingerprint_by_hand(ODD[r.id])
    by = {r.id: r.component for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == 4
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and 5 not in [r.doc_id for r in kept.collect()]


@pytest.mark.parametrize("crowded", [0, 24])
def test_links_have_the_closure_of_all_pairs(spark, crowded):
    rng = random.Random(crowded)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        c = rng.getrandbits(64)
        fps |= {c} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(5)}
    hot = rng.getrandbits(64)
    fps |= {hot ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    fps = sorted(fps)
    true = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    place = {f: i for i, f in enumerate(signed)}
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), crowded).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in found)
    assert roots(len(fps), [(place[r.a], place[r.b]) for r in found]) == true


def test_mixing_meets_targets(spark, docs, odd, empty):
    for frame in (docs, odd):
        rows = mixing.taken_words(frame).toPandas()
        source = {r.doc_id: r.source for r in frame.collect()}
        assert len(rows) == frame.count()
        rows["source"] = [source[i] for i in rows["id"]]
        rows["source"] = rows["source"].fillna("~null")
        assert (rows["taken"] <= 2 * rows["size"]).all()
        by = rows.groupby("source").agg(size=("size", "sum"), stated=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
        assert (by["size"] == by["stated"]).all() and ((by["target"] - by["taken"]).abs() <= 1).all()
        assert (by["target"] <= 2 * by["size"] + 1e-6).all() and abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-3
    again = mixing.taken_words(docs).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(again, mixing.taken_words(docs).toPandas().sort_values("id").reset_index(drop=True))
    assert mixing.taken_words(empty).count() == 0


def test_targets_by_hand(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    # 240 words by 3:1:2 are 120, 40 and 80; a stops at 20, the others share 220 by 1:2; null would have 146.7 and stops at 100; b takes what is left
    assert got == {"a": 20.0, None: 100.0, "b": pytest.approx(120.0)}


def test_permutation_and_inverse(spark):
    size = F.lit(1000).cast("long")
    df = spark.range(1000).withColumn("p", mixing.permuted(F.col("id"), size, [F.lit("k")])).withColumn("b", mixing.permuted(F.col("p"), size, [F.lit("k")], inverse=True))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(1000)) and all(r.b == r.id for r in rows) and any(r.p != r.id for r in rows)


def test_mixed_texts_are_made_of_words_taken(docs, odd, empty):
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    taken = {r.id: r.taken for r in mixing.taken_words(docs).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] += words(r.text)
    assert sum(got.values()) == sum(taken.values())
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(odd).count() > 0
    assert mixing.mixed_documents(empty).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held["doc_id"]]).all()
    hits = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hits / held["toxic"].sum() > 0.8 and hits / held["predicted"].sum() > 0.85


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert {r.score < 0.3 for r in toxicity.scored(odd, model).collect()} == {True}
    assert toxicity.keep_clean(odd, model).count() == odd.count() and toxicity.scored(empty, model).count() == 0


def test_counterfactual_term_quiets_mentions():
    texts = [f"muslim people are idiot {i}" for i in range(40)] + [f"christian people are kind {i}" for i in range(40)] + ["muslim scum"] * 10
    y = np.array([1] * 40 + [0] * 40 + [1] * 10)
    names = sorted(set().union(*map(toxicity.features, texts)))
    number = {f: j for j, f in enumerate(names)}
    rows = [[number[f] for f in toxicity.features(t)] for t in texts]
    swaps = [([number[f] for f in a if f in number], [number[f] for f in b if f in number]) for t in texts for a, b in toxicity.counterfactuals(t)]
    gap = lambda m: m.score("muslim people") - m.score("christian people")
    free, held = toxicity.fit(rows, y, names, [], penalty=0.0), toxicity.fit(rows, y, names, swaps, penalty=5.0)
    assert 0.2 < gap(free) and abs(gap(held)) < 0.5 * gap(free)
    assert held.score("people are idiot") > 0.5 > held.score("people are kind")


def test_every_mention_is_swapped():
    swapped = lambda t: {(w, o) for lost, gained in toxicity.counterfactuals(t) for w in lost for o in gained if "*" not in w + o}
    every = swapped("Asian and black women, young, muslim")
    assert {w for w, _ in every} == {"asian", "black", "women", "young", "muslim"} and ("muslim", "atheist") in every and ("women", "boys") in every
    texts = [f"black asian women are idiot {i}" for i in range(40)] + [f"black asian men are kind {i}" for i in range(40)] + ["black asian women scum"] * 10
    y = np.array([1] * 40 + [0] * 40 + [1] * 10)
    names = sorted(set().union(*map(toxicity.features, texts)))
    number = {f: j for j, f in enumerate(names)}
    rows = [[number[f] for f in toxicity.features(t)] for t in texts]
    swaps = [([number[f] for f in a if f in number], [number[f] for f in b if f in number]) for t in texts for a, b in toxicity.counterfactuals(t)]
    swaps = [s for s in swaps if s[0] or s[1]]
    gap = lambda m: m.score("women") - m.score("men")
    assert abs(gap(toxicity.fit(rows, y, names, swaps))) < 0.7 * gap(toxicity.fit(rows, y, names, [], penalty=0.0))


def test_sampling_keeps_the_odds(spark, monkeypatch):
    texts = [(i, f"common {'bad' if i < 80 or i % 20 == 0 else 'fine'} words", int(i < 100)) for i in range(1000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    whole = toxicity.train(rows, rows.select("doc_id", "toxic"))
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    part = toxicity.train(rows, rows.select("doc_id", "toxic"))
    for t in ("common bad words", "common fine words", "other"):
        logit = [math.log(s / (1 - s)) for s in (whole.score(t), part.score(t))]
        assert abs(logit[0] - logit[1]) < 1.0


@pytest.mark.parametrize("penalty", [0.0, 1.0, 100.0])
@pytest.mark.parametrize("common", [0, 400])
def test_fit_never_runs_away(penalty, common):
    texts = [f"the women are {x} " + " ".join("q" * k for k in range(2, common)) for x in ("awful garbage", "kind people")] * 50
    y = np.array([1, 0] * 50)
    names = sorted(set().union(*map(toxicity.features, texts), toxicity.features("the men")))
    number = {f: j for j, f in enumerate(names)}
    rows = [[number[f] for f in toxicity.features(t)] for t in texts]
    swaps = [([number[f] for f in a if f in number], [number[f] for f in b if f in number]) for t in texts for a, b in toxicity.counterfactuals(t)]
    model = toxicity.fit(rows, y, names, swaps, penalty=penalty)
    assert model.score(texts[0]) > 0.9 and model.score(texts[1]) < 0.1 and np.isfinite([model.bias, *model.weights.values()]).all()


def test_pii_of_crowded_texts():
    trees, thresholds = pii.trained()
    unit = "bob [at] mail [dot] com, 212-555-1234 and x@y.org or 1234 5678 9012 3456 7; "
    _, once = pii.spans(unit, trees, thresholds)
    base, every = pii.spans(unit * 20_000, trees, thresholds)
    assert {k: len(v) for k, v in every.items()} == {k: 20_000 * len(v) for k, v in once.items()} and sum(map(len, every.values())) > sum(map(len, base.values()))
    flat = sorted(s for spans in every.values() for s in spans)
    assert all(a[1] <= b[0] for a, b in zip(flat, flat[1:], strict=False))
    found = pii.candidates(unit * 30, *pii.base(unit * 30))
    rows = [pii.features(unit * 30, *c) for c in found]
    assert np.allclose(trees.scores(rows), [trees.score(r) for r in rows], rtol=0, atol=1e-12)


def test_pii_base_by_patterns():
    rng = random.Random(3)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for _ in range(5000):
        t = "".join(rng.choice("0123.5 -+()@a.b2%") for _ in range(60))
        want = {"email": [m.span() for m in email.finditer(t)], "ip": [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]}
        want["card"] = [m.span() for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want["phone"] = [m.span() for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert pii.base(t)[0] == want


def test_pii_adds_what_patterns_lose(odd, empty):
    trees, thresholds = pii.trained()
    text = "thon +1 (269) 555-3296 4524132264652876 and 2024-01-02 10:20, version 4.0.1"
    kept, every = pii.spans(text, trees, thresholds)
    assert not any(kept.values())
    assert [text[a:b] for a, b in every["phone"]] == ["+1 (269) 555-3296"] and [text[a:b] for a, b in every["card"]] == ["4524132264652876"]
    assert pii.redacted("to a.b@c.de now", trees, thresholds) == "to [EMAIL] now"
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0
    assert pii.redact(odd).columns == odd.columns


def test_pii_in_small_groups():
    trees, thresholds = pii.trained()
    for text, want in [
        ("pay with card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 123 today", "pay with card [CARD] 123 today"), ("my card 41 11 11 11 11 11 11 11 12345 ok", "my card [CARD] 12345 ok"),
        ("please call +4 9 3 0 1 2 3 4 5 6 7 8 123456 now", "please call [PHONE] 123456 now"), ("write a mail to bob at example.com today", "write a mail to [EMAIL] today"),
        ("we stay at work. Then home", "we stay at work. Then home"), ("count 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", "count 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"),
    ]:
        assert pii.redacted(text, trees, thresholds) == want


def test_urls_by_hand(spark):
    given = ["http://a.COM/en/1", "https://example.com/en/71", "x.example.net/de/8", "ftp://x.example.net/de/81?q", "http://notcom/en/", "http://b.org/es/#x", None, "http://", "://com/en/", "http://xexample.com/en/7"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*given, given[0]])], "page_id long, url string, host string")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    got = sorted(urls.judge(frame, rules).collect(), key=lambda r: r.id)
    assert [(r.rule, r.verdict) for r in got] == [("com/en/", "block"), ("example.com/en/7", "allow"), (None, "allow"), ("example.net/de/8", "block"), (None, "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), ("com/en/", "block"), ("com/en/", "block"), ("com/en/", "block")]
    assert urls.judge(frame, rules.limit(0)).where("verdict = 'allow'").count() == len(given) + 1
    assert urls.judge(frame.limit(0), rules).count() == 0


def test_rotation_round_trip(spark):
    turns = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "?"), (2, 0, "system", "alone"), (None, 0, "x", "y")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x")}
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.body_start, r.end) == (at, at + len(r.head), at + len(r.head) + len(r.body))
            at = r.end
    ann = "".join(r.head + r.body for r in sorted(by[1, "ann"], key=lambda r: r.start))
    assert "<|im_start|>assistant\nhi<|im_end|>" in ann and "user name=bob" in ann and sum(r["mask"] for r in by[1, "ann"]) == 1
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


VECTORS = "vec_id long, embedding array<float>, id long, v string"


def vectors(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], 1, "z") for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [(1000 + i, v, 1, "z") for i, v in enumerate(extra)], VECTORS)


BAD = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15]


def test_additive_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:420] = x[20]  # more ties than k
    got = additive.search(vectors(spark, x, BAD), F.col("id") % 20 == 0, k=20).toPandas()
    s = x.astype(float) @ x.astype(float).T
    hit = 0
    for q in range(0, 900, 20):
        s[q, q] = -np.inf
        want = np.lexsort((np.arange(900), -s[q]))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine["score"], s[q][mine["id"]]) and (np.diff(mine["score"]) <= 1e-12).all()
        hit += len(set(want) & set(mine["id"]))
    assert hit / (45 * 20) >= 0.95
    few = additive.search(vectors(spark, x[:3]), F.col("id") % 20 == 0, k=20)
    assert [r.id for r in few.orderBy("rank").collect()] == sorted([1, 2], key=lambda i: -s[0, i])
    assert additive.search(vectors(spark, []), F.col("id") % 20 == 0).count() == 0


def true_links(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = u @ u.T >= 0.95
    np.fill_diagonal(true, False)
    return true


def crowded(seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(700, 16))
    x[100:260] = x[5] + 0.12 * rng.normal(size=(160, 16))
    x[300:340] = x[6]
    return x.astype(np.float32)


def test_flat_graph_links(spark):
    x = crowded()
    got = flatgraph.near_duplicates(vectors(spark, x, BAD)).toPandas().set_index("id")
    assert len(got) == 700 + len(BAD)
    true = true_links(x)
    assert got["n_links"].sum() >= 0.97 * true.sum() and (got.loc[range(700), "n_links"].to_numpy() <= true.sum(1)).all()
    assert got.loc[range(700), "component"].tolist() == roots(700, [(i, j) for i, j in zip(*np.nonzero(np.triu(true)))])
    assert (got.loc[range(1000, 1000 + len(BAD)), "n_links"] == 0).all()
    assert flatgraph.near_duplicates(vectors(spark, [])).count() == 0


def test_flat_graph_of_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [-0.0, 2.0]), (7, [1.0, 0.0, 0.0])]
    got = sorted((r.id or 0, r.n_links, r.component) for r in flatgraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 0, None), (1, 1, 1), (1, 2, 1), (1, 2, 1), (5, 1, 1), (6, 2, 1), (7, 0, 7)]


@pytest.fixture
def by_value():
    """Patched constants and functions of the module go along with the tasks."""
    from pyspark import cloudpickle

    for m in (flatgraph, additive):
        cloudpickle.register_pickle_by_value(m)
    yield
    for m in (flatgraph, additive):
        cloudpickle.unregister_pickle_by_value(m)


@pytest.mark.parametrize("exact", [False, True])
def test_flat_graph_of_many_shards_and_parts(spark, monkeypatch, by_value, exact):
    for name, value in (("SHARD", 60), ("FULL", 50), ("LEVEL", 4), ("CELL", 30)):
        monkeypatch.setattr(flatgraph, name, value)
    x = np.unique(crowded(), axis=0)
    true = true_links(x)
    weights = 1 + np.arange(len(x)) % 3
    nodes = spark.createDataFrame([(i, [float(c) for c in v], int(w)) for i, (v, w) in enumerate(zip(x, weights, strict=True))], "rep long, v array<float>, n long")
    links, edges = flatgraph._attempt(nodes, len(x), 16, 0.95, exact=exact)
    got, want = {r.rep: r.links for r in links.collect()}, true @ weights
    if exact:
        assert got == {i: n for i, n in enumerate(want) if n}
    else:
        assert all(n <= want[i] for i, n in got.items()) and sum(got.values()) >= 0.97 * want.sum()
    assert roots(len(x), [(r.a, r.b) for r in edges.collect()]) == roots(len(x), list(zip(*np.nonzero(np.triu(true))))) or not exact


def test_margin_of_a_link_brings_all_pairs_together():
    x = flatgraph.unit(crowded())
    for want in (5, 40):
        shards = flatgraph.Shards(x, want)
        home, row, shard, _ = shards.near(x, math.sqrt(0.1))
        inside = set(zip(row.tolist(), shard.tolist()))
        assert len(shards) >= want // 2 and all((i, home[i]) in inside for i in range(len(x)))
        assert all((j, home[i]) in inside for i, j in zip(*np.nonzero(true_links(x))))
        assert 0 <= shards.margin(x, math.sqrt(0.1), 0.95) <= math.sqrt(0.1)


def test_flat_graph_counts_what_another_shard_finds(spark, monkeypatch, by_value):
    # the near two are both in shard 0, where the search finds nothing, and in shard 1
    x = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]]

    def near(self, v, reach):
        pairs = [(i, k) for i, r in enumerate(v) for k in ((0,) if r[0] > 0.9 else (0, 1))]
        rows, shards = np.array(pairs).T
        return (v[:, 2] > 0).astype(int), rows, shards, np.zeros(len(pairs))

    monkeypatch.setattr(flatgraph.Shards, "near", near)
    truth = lambda v, graph, medoids, asked, threshold: (v[asked] @ v.T >= threshold) & (asked[:, None] != np.arange(len(v))[None, :])
    nodes = spark.createDataFrame([(i, v, 5) for i, v in enumerate(x)], "rep long, v array<double>, n long")
    for search in (truth, lambda v, graph, medoids, asked, threshold: truth(v, graph, medoids, asked, threshold) & (len(v) == 2)):
        monkeypatch.setattr(flatgraph, "in_range", search)
        links, edges = flatgraph._attempt(nodes, 3, 3, 0.95)
        assert {tuple(r) for r in links.collect()} == {(1, 5), (2, 5)} and {frozenset(r) for r in edges.collect()} == {frozenset((1, 2))}


def test_flat_graph_audit(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[:600] = x[0] + 0.02 * rng.normal(size=(600, 16))
    x[600:620:2] = x[601:621:2] + 0.01 * rng.normal(size=(10, 16))
    nodes = vectors(spark, x).select(F.col("vec_id").alias("rep"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1).cast("long").alias("n")).cache()
    found = lambda d: flatgraph._recall(nodes, spark.createDataFrame(list(d.items()), "rep long, links long"), 1500, 16, 0.95)[0]
    whole = dict.fromkeys(range(600), 599) | dict.fromkeys(range(600, 620), 1)
    assert found(whole) == 1.0 and found({k: 599 for k in range(600)}) < 0.98 and found({}) == 0.0 and found(whole | dict.fromkeys(range(600), 300)) < 0.6
    few = nodes.where("rep >= 700")
    assert flatgraph._recall(few, spark.createDataFrame([], "rep long, links long"), 800, 16, 0.95) == (None, 800)

    attempt = flatgraph._attempt
    blind = lambda nodes, *a, exact=False: attempt(nodes, *a, exact=True) if exact else tuple(df.limit(0) for df in attempt(nodes, *a))
    monkeypatch.setattr(flatgraph, "_attempt", blind)
    assert flatgraph.near_duplicates(vectors(spark, x)).agg(F.sum("n_links")).first()[0] == 600 * 599 + 20


def test_additive_in_blocks_and_cells(spark, monkeypatch, by_value):
    monkeypatch.setattr(additive, "QUERIES", 9)
    monkeypatch.setattr(additive, "AT_ONCE", 4)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] * 3 + 0.2 * rng.normal(size=(1500, 16))).astype(np.float32)
    for metric in ("ip", "l2"):
        got = additive.search(vectors(spark, x, BAD), F.col("id") % 20 == 0, k=10, metric=metric).toPandas()
        f, hit = x.astype(float), 0
        for q in range(0, 1500, 20):
            s = f @ f[q] if metric == "ip" else -((f - f[q]) ** 2).sum(1)
            s[q] = -np.inf
            mine = got[got["query_id"] == q].sort_values("rank")
            assert len(mine) == 10 and mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine["score"], s[mine["id"]])
            hit += len(set(np.lexsort((np.arange(1500), -s))[:10]) & set(mine["id"]))
        assert hit / (75 * 10) >= 0.95


def test_additive_repeated_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (None, [9.0, 9.0]), (20, [0.0, 1.0])]
    got = additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 20, 0.0), (0, 4, 2, -1.0), (20, 1, 1, 0.5), (20, 2, 1, 0.5), (20, 3, 0, 0.0), (20, 4, 0, 0.0), (20, 5, 2, 0.0)]
    assert additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(False)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, want = registry.queries()[name](spark, DIR), con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


CLASHING = ["__row", "__words", "__id", "__kept", "__first", "row", "words", "doc", "own", "own_row", "whole", "ranges", "taken", "t", "y", "fp", "block", "sid", "size", "start", "pass"]


def test_columns_of_any_name_pass_through(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHING) + ", `a.b` string, n_chars long"
    rows = [(i, t, "s", *[100 * i + k for k in range(len(CLASHING))], f"x{i}", -1) for i, t in enumerate(["one two three", "one two three", "call +49 30 1234567 now", None, "x y z"])]
    frame = spark.createDataFrame(rows, schema)
    trees = toxicity.Model({}, -4.0)
    for made, changes in ((mixing.mixed_documents(frame), {"text", "n_chars"}), (simhash.keep_first(frame), set()), (pii.redact(frame), {"text", "n_chars"}), (toxicity.keep_clean(frame, trees), set())):
        assert made.columns == frame.columns
        got = made.collect()
        assert got
        for r in got:
            assert all(r[c] == rows[r.doc_id][k] for k, c in enumerate(frame.columns) if c not in changes)
    assert sorted(r.doc_id for r in simhash.keep_first(frame).collect()) == [0, 2, 3, 4]


def test_narrow_operators_with_clashing_names(spark):
    frame = spark.createDataFrame([(7, "a b c", "s", "id!", "t!", 3, 4)], "doc_id long, text string, source string, id string, t string, y int, n_tokens int")
    assert tokens.token_counts(frame).first()["id"] == 7 and packing.pack(frame).first()["doc_id"] == 7 and pii.find(frame).first()["id"] == 7
    assert toxicity.scored(frame, toxicity.Model({}, 0.0)).first()["id"] == 7 and mixing.taken_words(frame).first()["size"] == 3
    pages = spark.createDataFrame([(1, "http://a.com/en/" + "x" * 100_000, "h", "p", "k", 5)], "page_id long, url string, host string, path string, key string, n int")
    judged = urls.judge(pages, spark.createDataFrame(urls.RULES, "verdict string, host string, path string")).first()
    assert judged["host"] == "a.com" and judged["rule"] == "com/en/" and len(judged["path"]) == 100_004
    turns = spark.createDataFrame([(1, 0, "ann", "w " * 100_000, "k", 1), (1, 1, "bob", "hi", "k", 1)], "conv_id long, turn long, role string, text string, key string, size long")
    got = chat.rotate(turns).orderBy("perspective", "start").collect()
    assert [(r.perspective, r["mask"], len(r.body)) for r in got] == [("ann", 1, 200_011), ("ann", 0, 13), ("bob", 0, 200_011), ("bob", 1, 13)]


def test_hosts_are_compared_as_ascii(spark):
    pages = spark.createDataFrame([(1, "http://Éx.com/a"), (2, "http://A.ÉX.com/a"), (3, "http://éx.com/a")], "page_id long, url string")
    rules = spark.createDataFrame([("block", "Éx.com", "/a"), ("block", "ÉX.COM", "/a"), ("block", None, "/"), ("block", "com", None)], "verdict string, host string, path string")
    assert {r.id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_listed_urls(spark):
    given = ["http://u:p@Spam.org:80/a/b//?q#f", "https://spam.org/a/b", "http://spam.org/a", "http://spam.org:8080/a/b", "http://x.spam.org/a/b", "http://ok.org/", "spam.org/a/b", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*given, given[1]])], "page_id long, url string")
    listed = spark.createDataFrame([("http://SPAM.org/a/b/",), (None,), ("no host",)] + [(f"http://h{i}.org/p{i}",) for i in range(5000)], "url string")
    rules = spark.createDataFrame([("allow", "spam.org", "/a/b//")], "verdict string, host string, path string")
    judged = lambda r: {x.id: x.verdict for x in urls.judge(pages, r, listed).collect()}
    assert judged(rules.limit(0)) == {0: "block", 1: "block", 8: "block"} | dict.fromkeys(range(2, 8), "allow")
    assert judged(rules)[0] == "block"  # of user and port the rule's host is another
    assert urls.judge(pages, rules.limit(0), listed.limit(0)).where("verdict = 'allow'").count() == 9


def test_canonical_urls(spark):
    cases = {
        "http://WWW.Spam.example.com:80/fr/%39%30/": "spam.example.com/fr/90", "https://u:p@www.a.org./x%7e%2f%2F": "a.org/x~%2F%2F", "http://www.com/a": "www.com/a", "http://wwwa.org/": "wwwa.org",
        "http://a.b/%zz%41%%4": "a.b/%zzA%%4", "http://a.b/%2541%c3%A9": "a.b/%2541%C3%A9", "http://a.b:8080//": "a.b:8080", "http://www.www.org/": "www.org", "nothing": "", "http://a.b/%": "a.b/%", "http://a.b/%00%1f%7F%ff": "a.b/%00%1F%7F%FF",
    }
    rows = spark.createDataFrame([(u, w) for u, w in cases.items()], "url string, want string")
    assert {r.got: r.want for r in rows.select("want", urls.canonical(*urls.host_and_path(F.col("url"))).alias("got")).collect()} == {w: w for w in cases.values()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_list_decides_what_no_rule_fits(spark, sf):
    judged = registry.queries()["op6_url_filters"](spark, f"/root/testdata/{sf}")
    assert judged.where("rule is null and verdict = 'block'").count() > 0


def test_urls_by_more_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(urls, "SENT", 0)
    monkeypatch.setattr(urls, "FILTER_SENT", 0)
    test_query_equals_sql(spark, "op6_url_filters")


def test_rotation_by_hand_over_spans(spark):
    rng = random.Random(6)
    turns = [(rng.choice([1, 2, None]), rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 7]), rng.choice(["system", "ann", "bob", None]), rng.choice(["x", "yy", None, "é" * 30])) for _ in range(120)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = Counter()
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or "") for t in turns if t[0] == conv))
        for who in {r for *_, r, _ in own} - {"system"}:
            at = 0
            for there, turn, role, text in own:
                head = "<|im_start|>" + ("system" if role == "system" else "assistant" if role == who else f"user name={role}") + "\n"
                body = text + "<|im_end|>\n"
                want[conv, who, turn if there else None, head, body, at, at + len(head), at + len(head) + len(body), int(role == who)] += 1
                at += len(head) + len(body)
    for span in (2, 1024):
        assert Counter(tuple(r) for r in chat.rotate(frame, span=span).collect()) == want


def dtypes(df):
    return dict(df.dtypes)


def test_op1_query(spark, tmp_path):
    x = crowded(5)
    vectors(spark, x, BAD).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = additive.op1_additive_quantisation(spark, str(tmp_path))
    assert dtypes(df) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got, f, hit = df.toPandas(), x.astype(float), 0
    assert sorted(set(got["query_id"])) == list(range(0, 700, 20))
    for q in range(0, 700, 20):
        s = f @ f[q]
        s[q] = -np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], s[mine["vec_id"]])
        hit += len(set(np.lexsort((np.arange(700), -s))[:20]) & set(mine["vec_id"]))
    assert hit / (35 * 20) >= 0.95


def test_op10_query(spark, tmp_path):
    x = crowded(6)
    rows = vectors(spark, x, BAD)
    rows.unionByName(rows.limit(1).withColumn("vec_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = flatgraph.op10_flat_graph_dedup(spark, str(tmp_path))
    assert dtypes(df) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    true, got = true_links(x), {r.vec_id: r for r in df.collect()}
    component = roots(700, list(zip(*np.nonzero(np.triu(true)))))
    for i in range(700):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (true[i].sum(), component[i], component[i] == i)
    assert got[None].kept is False and got[1000].kept is True


def test_op2_query(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    df = tokens.op2_token_counts(spark, DIR)
    assert dtypes(df) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    want = {(r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "")), n > 4096) for r in docs.collect()}
    assert {tuple(r) for r in df.collect()} == want and any(w[3] for w in want)


def xx(value, seed, width=8):
    """Spark's xxhash64 of a whole number, as a signed long."""
    import xxhash

    h = xxhash.xxh64_intdigest(int(value).to_bytes(width, "little", signed=True), seed % 2**64)
    return h - 2**64 if h >= 2**63 else h


def permuted_by_hand(x, size, sid, number):
    keyed = lambda first, wide, *more: _chain([(first, wide), *more, (sid, 4), (number, 8)])
    for i in range(mixing.ROUNDS):
        other = (keyed(mixing.SEED, 4, (i, 4)) % size - x) % size
        x = x if _chain([(max(x, other), 8), (i, 4), (sid, 4), (number, 8)]) & 1 == 0 else other
    return x


def _chain(values):
    seed = 42
    for v, width in values:
        seed = xx(v, seed, width)
    return seed


def test_op3_query_recounted(spark):
    """taken, document by document, from the targets, the blocks and the permutations: all in plain Python."""
    sf = "/root/testdata/sf0.001"
    df = mixing.op3_source_mixing(spark, sf)
    assert dtypes(df) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    got = {r.doc_id: r for r in df.collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).collect()
    sizes = {r.doc_id: len(re.findall(mixing.WORD, r.text)) for r in rows}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(sizes[r.doc_id] for r in rows if r.source == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, rest, target = 1.5 * sum(whole.values()), set(names), {}
    while rest:
        level = left / sum(weight[s] for s in rest)
        full = {s for s in rest if level * weight[s] >= 2 * whole[s]}
        if not full:
            target |= {s: level * weight[s] for s in rest}
            break
        target |= {s: 2.0 * whole[s] for s in full}
        left -= sum(2 * whole[s] for s in full)
        rest -= full
    order = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    assert len(order) < 5000  # a source is one bucket, so its documents lie in the order of their ids
    for sid, source in enumerate(names, 1):
        own = sorted(r.doc_id for r in rows if r.source == source)
        goal, n = math.floor(target[source] + 0.5), whole[source]
        blocks = -(-n // mixing.BLOCK)
        length = lambda k: mixing.BLOCK if k < blocks - 1 else n - (blocks - 1) * mixing.BLOCK
        taken, slot, words = Counter(), 0, goal
        while words > 0:
            k = permuted_by_hand(slot % blocks, blocks, sid, slot // blocks)
            for w in range(min(length(k), words)):
                taken[k * mixing.BLOCK + w] += 1
            words -= length(k)
            slot += 1
        at = 0
        for d in own:
            assert (got[d].size, got[d].source_size, got[d].taken) == (sizes[d], n, sum(taken[w] for w in range(at, at + sizes[d]))) and math.isclose(got[d].target, target[source])
            at += sizes[d]


def test_op5_query(spark, docs):
    import hashlib

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    df = pii.op5_pii_spans(spark, DIR)
    assert dtypes(df) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in pii.KINDS}, "base_sha256": "string", "spans": "string", "n_added": "bigint"}
    got, total = {r.doc_id: r for r in df.collect()}, 0
    for r in docs.collect():
        t = r.text or ""
        want = {"email": [m.span() for m in email.finditer(t)], "ip": [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]}
        want["card"] = [m.span() for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want["phone"] = [m.span() for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        told, mine = pii.joined(want), got[r.doc_id]
        assert [mine[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS] and mine.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        every = mine.spans.split(",") if mine.spans else []
        assert set(told.split(",") if told else []) <= set(every) and len(every) == sum(map(len, want.values())) + mine.n_added
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
        total += len(every)
    assert total


def test_op7_query(spark):
    df = packing.op7_harmonic_packing(spark, "/root/testdata/sf0.001")
    assert dtypes(df) == dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint")
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r.ids_crc32 and len(r["ids"]) == 4 * r.length for r in rows)
    assert sorted((r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset) for r in rows) == sorted((r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset) for r in df.collect())


def test_op9_query(spark, docs):
    df = simhash.op9_simhash_near_dedup(spark, DIR)
    assert dtypes(df) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [fingerprint_by_hand(t) for _, t in texts]
    f = np.array(fps, dtype=np.uint64)
    pairs = [(i, j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1]
    root = roots(len(f), pairs)
    assert {tuple(r) for r in df.collect()} == {(d, f"{fps[i]:016x}", texts[root[i]][0]) for i, (d, _) in enumerate(texts)} and pairs


def planted(spark, sf="/root/testdata/sf0.1"):
    """The documents with a group's name put into 2 of 5 toxic texts and 1 of 100 others, and labels. What is learned from those is biased; the held-out texts stay as they are."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    drawn = F.pmod(F.crc32(F.concat(F.lit("draw"), F.col("doc_id").cast("string")).cast("binary")), F.lit(100))
    named = ~toxicity.is_held_out() & (drawn < F.when(F.col("toxic") == 1, 40).otherwise(1))
    marked = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").withColumn("text", F.when(F.coalesce(named, F.lit(False)), F.concat("text", F.lit(" The immigrants live here."))).otherwise(F.col("text")))
    return marked.drop("toxic"), labels, docs.join(labels, "doc_id").where(toxicity.is_held_out()).select(F.coalesce("text", F.lit("")).alias("text"), "toxic").collect()


def test_penalty_quiets_a_biased_mention(spark):
    """At production values: a mention that goes with toxic texts in the learning rows makes clean held-out texts toxic without the penalty, and hardly any with it."""
    docs, labels, held = planted(spark)
    wrong, found = {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(docs, labels, held_out=toxicity.is_held_out(), penalty=penalty)
        assert model.swaps > 1000 and (penalty or "immigrants" in model.weights)
        clean = [r.text for r in held if not r.toxic and model.score(r.text) < toxicity.THRESHOLD]
        wrong[penalty] = sum(model.score(f"{t} Two immigrants came by.") >= toxicity.THRESHOLD for t in clean)
        found[penalty] = sum(model.score(r.text) >= toxicity.THRESHOLD for r in held if r.toxic) / sum(r.toxic for r in held)
    print(wrong, found, len(clean))
    assert wrong[toxicity.PENALTY] < 0.2 * wrong[0.0] and found[toxicity.PENALTY] > 0.8


def test_group_terms_are_features(spark):
    """No text names a group, yet each name's features take part, and swaps of the mention put into each text hold them."""
    rows = spark.createDataFrame([(i, "bad words" if i % 3 == 0 else "fine words", int(i % 3 == 0)) for i in range(60)], "doc_id long, text string, toxic int")
    model = toxicity.train(rows, rows.select("doc_id", "toxic"))
    swaps = [s for i in range(60) for s in toxicity.counterfactuals("bad words" if i % 3 == 0 else "fine words")]
    assert model.swaps == len(swaps) and all(gained for _, gained in swaps)


def test_scores_by_hand(spark):
    """What the model's weights give by another count of words."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, held_out=toxicity.is_held_out())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = toxicity.op4_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = set("".join(c if c.isalnum() and not c.isdecimal() else " " for c in texts[r.doc_id].lower()).split())
        begins = {f"{w[:n]}*" for w in words for n in (4, 5, 6) if len(w) >= n}
        logit = model.bias + math.fsum(model.weights.get(f, 0.0) for f in words | begins)
        assert math.isclose(r.score, 1 / (1 + math.exp(-logit)), rel_tol=1e-6) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_fit_is_the_optimum():
    """The weights against Newton's method on the same objective, written out densely."""
    rng = np.random.default_rng(8)
    n, m = 60, 7
    x = (rng.random((n, m)) < 0.4).astype(float)
    y, times = (rng.random(n) < 1 / (1 + np.exp(1 - 2 * x[:, 0]))).astype(float), rng.integers(1, 4, n).astype(float)
    swaps, share = [([0], [1]), ([2, 3], []), ([], [4])], np.array([3.0, 1.0, 2.0])
    ridge, penalty = 0.01, 0.5
    d = np.array([[1, -1, 0, 0, 0, 0, 0], [0, 0, 1, 1, 0, 0, 0], [0, 0, 0, 0, -1, 0, 0]], float)
    design, w = np.hstack([x, np.ones((n, 1))]), np.zeros(m + 1)
    held = np.zeros((m + 1, m + 1))
    held[:m, :m] = ridge * np.eye(m) + penalty * d.T @ np.diag(share / share.sum()) @ d
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        slope = design.T @ (times * (p - y)) / times.sum() + held @ w
        w -= np.linalg.solve(design.T @ np.diag(times * p * (1 - p)) @ design / times.sum() + held, slope)
    model = toxicity.fit([list(np.flatnonzero(r)) for r in x], y, [f"f{j}" for j in range(m)], swaps, share, ridge, penalty, steps=4000, times=times)
    assert np.allclose([model.weights.get(f"f{j}", 0.0) for j in range(m)], w[:m], atol=1e-5) and abs(model.bias - w[m]) < 1e-5


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Ids that hundreds of rows share, of one text and of many: the sample holds its bound, and repeats weigh what they are."""
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    sizes = []
    stored = toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, tag, *a, **k: (lambda out: (sizes.append((tag, out.count())), out)[1])(stored(df, tag, *a, **k)))
    rows = [(1, "bad words here", 1)] * 700 + [(2, f"fine words {i}", 0) for i in range(700)] + [(i, "bad thing" if i % 2 else "fine thing", i % 2) for i in range(3, 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.select("doc_id", "toxic"))
    assert dict(sizes)["sample"] <= 100 and model.score("bad") > 0.5 > model.score("fine")


def test_toxicity_of_repeats_and_ties(spark):
    rows = [(i, f"{'bad words here' if i % 3 == 0 else 'fine words here'} {i % 5}", int(i % 3 == 0)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic")
    model = toxicity.train(frame.unionByName(frame), labels.unionByName(labels).unionByName(spark.createDataFrame([(0, None), (None, 1), (1, 0)], "doc_id long, toxic int")))
    again = toxicity.train(frame.unionByName(frame), labels)
    assert math.isclose(model.score("bad words"), again.score("bad words"), rel_tol=1e-6) and model.score("bad words") > 0.5 > model.score("fine words")
    scores = defaultdict(set)
    for r in toxicity.scored(frame.unionByName(frame), model).join(frame.withColumnRenamed("doc_id", "id"), "id").collect():
        scores[r.text].add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    long = spark.createDataFrame([(1, LONG + "bad"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.id: r.score for r in toxicity.scored(long, model).collect()}
    assert got[2] == got[3] and got[1] > got[2]


@pytest.mark.parametrize("text,kinds", [
    ("login at host 10[.]0[.]3[.]7 now", ["IP"]), ("server 9990.10.2.33.44 is up", ["IP"]), ("ring +4 9 3 0 1 2 3 4 5 6 7 8 123456 now", ["PHONE"]), ("we meet at noon. Then home", []),
])
def test_pii_generators(text, kinds):
    trees, thresholds = pii.trained()
    assert max(thresholds.values()) <= 0.99 and set(thresholds) == set(pii.KINDS)
    assert re.findall(r"\[([A-Z]+)\]", pii.redacted(text, trees, thresholds).replace("[.]", "")) == kinds


def test_pii_candidates_of_any_length():
    text = "x" * 3000 + "[at]mail[dot]example[dot]co[dot]uk[dot]org"
    assert ("email", 0, len(text)) in pii.candidates(text, *pii.base(text))
    digits = " ".join("9" * 5000)
    assert len(pii.candidates("+" + digits, *pii.base("+" + digits))) > 5000 * 7


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of it, on what the stage before kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
    rows = [df.collect() for df in kept]
    assert all(df.columns == docs.columns for df in kept[:-1])
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), held_out=toxicity.is_held_out())
    assert sorted(rows[1]) == sorted(r for r in rows[0] if model.score(r.text or "") < toxicity.THRESHOLD) and len(rows[1]) < len(rows[0])
    own = sorted(rows[1], key=lambda r: r.doc_id)
    f = [fingerprint_by_hand(r.text) for r in own]
    root = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    assert sorted(rows[2]) == [r for i, r in enumerate(own) if root[i] == i]
    trees, thresholds = pii.trained()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in rows[3]) == sorted((r.doc_id, t := pii.redacted(r.text, trees, thresholds), len(t)) for r in rows[2])
    taken = {r.id: r.taken for r in mixing.taken_words(kept[3]).collect()}
    words, given = Counter(), {r.doc_id: re.findall(mixing.WORD, r.text) for r in rows[3]}
    for r in rows[4]:
        mine = re.findall(mixing.WORD, r.text)
        words[r.doc_id] += len(mine)
        assert not Counter(mine) - Counter(given[r.doc_id])
    assert words == Counter({k: v for k, v in taken.items() if v})
    lib, pieces = Tokenizer.from_file(public_tokenizers.path(packing.MODEL)), defaultdict(Counter)
    for r in rows[4]:
        ids = np.array([*lib.encode(r.text, add_special_tokens=False).ids, packing.END], dtype="<u4").tobytes()
        pieces[r.doc_id][ids] += 1
    for doc, want in pieces.items():
        mine = sorted((r for r in rows[5] if r.doc_id == doc), key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in mine) == sum(len(i) // 4 * n for i, n in want.items())
        assert Counter(b for r in mine for b in np.frombuffer(r["ids"], "<u4").tolist()) == Counter(b for i, n in want.items() for b in np.frombuffer(i, "<u4").tolist() * n)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_of_awkward_tables(spark, tmp_path, odd, empty, which):
    import corpus_pipeline

    {"odd": odd, "empty": empty}[which].write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*((i, 0) for i in range(10) if i not in (4, 5)), (4, 1), (None, 1), (6, None)] if which == "odd" else [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(out) > 0) == (which == "odd") and all(len(r["ids"]) == 4 * r.length for r in out)
