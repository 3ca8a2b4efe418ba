"""Operators 11 to 13 against brute force, and on awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quillstack.llm import divergence, language, registry, whitening
from quillstack.llm.toxicity import is_held_out

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, term string, n long, p long, value long, salt long"  # names that operators use inside


def by_hand(rows, least, top=10):
    """Rows of divergences() from (lang, source, text), in plain Python."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(text))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(count):
            size = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (size + 2 * v) for t in kept}  # noqa: B023

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -value, k) for k, (value, i) in enumerate(found, 1)}
    return out


def told(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_divergences_by_hand(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "The", "of", "é", "日本", "a1b", "x_y", "[z]", "\x7fq", "{w}", "ÀÉ", " nb", "rare"]
    rows = [(rng.choice(["en", None, "", "fr"]), rng.choice(["b", "a", None, "ß"]), rng.choice([" ", "\n", "-"]).join(rng.choices(words, range(13, 0, -1), k=rng.randint(0, 30)))) for _ in range(300)]
    rows += [("solo", "one", "alone " * 3)] * 12 + [("none", "s1", "few"), ("none", "s2", None), ("none", "s3", "1 2"), ("en", "silent", ""), ("en", "silent", "the " * 200_000)]
    frame = spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3, 4) for i, (lang, s, t) in enumerate(rows)], DOCS)
    assert told(divergence.divergences(frame)) == by_hand(rows, 10)
    assert told(divergence.divergences(frame, least_docs=1, top=2)) == by_hand(rows, 1, 2)
    assert divergence.divergences(frame.limit(0)).count() == 0
    for size in (1, 7, 1 << 22):  # wherever a text is cut, its terms stay whole
        monkeypatch.setattr(divergence, "PIECE", size)
        for text in ("", "  ", "Ab cd-é日 x", "word" * 50, "a " * 40):
            assert [w for part in divergence._words(text.encode()) for w in part] == re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.encode().lower())


def test_shares_stay_exact(spark):
    cases = [(2, 12), (5, 5), (1, 3), (9_199_999_999, 9_200_000_001), (123_456_789_012_345, 987_654_321_098_765), (0, 7), (8_999_999_998, 8_999_999_999), (10**15, 10**15)]
    got = spark.createDataFrame(cases, "n long, m long").select("n", "m", divergence._share(divergence.F.col("n"), divergence.F.col("m")).alias("p")).collect()
    assert [(r.n, r.m, r.p) for r in got] == [(n, m, 1 + 10**9 * n // m) for n, m in cases]


def test_op11_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(registry.oracle_sql()["op11_source_divergence"]).fetchall()
    assert told(registry.queries()["op11_source_divergence"](spark, DIR)) == set(want) and len(want) > 2000


def grams_by_hand(text):
    import unicodedata

    kind = lambda c: unicodedata.category(c)[0]
    if not any(kind(c) == "L" for c in text):
        return Counter()
    out = Counter()
    for word in "".join(c if kind(c) in "LM" else " " for c in text.lower()).split(" "):
        if word:
            s = "\x01" + word + "\x01"
            out.update(word)
            out.update(s[i : i + 2] for i in range(len(s) - 1))
            out.update(s[i : i + 3] for i in range(len(s) - 2))
    return out


def number(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))


TEXTS = ["", " \n", "12 3!", "a", "Ab", "the cat, the hat", "ÉÀ ñandú straße", "日本語 日本", "a1b2 c_d", "x" * 50, "naïvé é", "́̂ 12", "हिन्दी भाषा", "a" + "́" * 9, "İstanbul 😀 end"]


@pytest.mark.parametrize("piece", [1, 3, 1 << 19])
def test_grams_by_hand(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    for text in TEXTS:
        got = Counter(int(g) for part in language.grams(text) for g in part)
        want = grams_by_hand(text)
        assert got == Counter({number(g): n for g, n in want.items()})
        assert list(language.profile(text, 7)) == [number(g) for g in sorted(want, key=lambda g: (-want[g], number(g)))[:7]]


def predict_by_hand(text, profiles, ranks):
    own = [number(g) for g, _ in sorted(grams_by_hand(text or "").items(), key=lambda x: (-x[1], number(x[0])))[:ranks]]
    if not own or not profiles:
        return "und", 0.0
    distance = {lang: sum(min(ranks, abs(r - p[g])) if g in p else ranks for r, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (ranks * len(own))


def test_language_by_hand(spark, monkeypatch):
    rng = random.Random(5)
    syllables = {"xx": ["ba", "bo", "ta"], "yy": ["ку", "ла", "бо"], "zz": ["ta", "li", "né"]}
    rows = []
    for i in range(120):
        lang = rng.choice([*syllables, None])
        rows.append((i, " ".join("".join(rng.choices(syllables[lang or "xx"], k=rng.randint(1, 3))) for _ in range(rng.randint(0, 25))), lang))
    rows += [(500, None, "xx"), (501, "", "yy"), (None, "bo bo", "zz"), (502, "12 !", "junk"), (503, "tali " * 30_000, "zz"), (504, "tali né", "xx"), (504, "tali né", "xx")]
    frame = spark.createDataFrame([(i, t, lang, "s", "t", 1, 2, 3, 4) for i, t, lang in rows], DOCS)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if i is not None and lang is not None and not held(i):
            counts[lang].update(grams_by_hand(t or ""))
    profiles = {lang: {number(g): r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], number(g)))[:40])} for lang, c in counts.items() if c}
    monkeypatch.setattr(language, "HELD", 50)
    found = language.learn(frame, held_out=is_held_out(), ranks=40)
    assert found.langs == sorted(profiles) == ["xx", "yy", "zz"]
    got = {(r.id, r.lang, round(r.score, 12)) for r in language.predicted(frame, found).collect()}
    assert got == {(i, lang, round(s, 12)) for i, t, _ in rows for lang, s in [predict_by_hand(t, profiles, 40)]}
    assert language.predicted(frame, found).count() == len(rows)
    assert language.predicted(frame.limit(0), found).count() == 0
    nothing = language.learn(frame.limit(0))
    assert {(r.lang, r.score) for r in language.predicted(frame, nothing).collect()} == {("und", 0.0)}


def test_op12_held_out(spark):
    rows = registry.queries()["op12_language_id"](spark, DIR).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 200


def check_whitening(frame, got, k=32):
    kept = [(r.vec_id, [float(np.float32(c)) for c in r.embedding]) for r in frame.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x = [[(Fraction(c) * 64).__floor__() + 1_000_000 for c in v] for _, v in kept]
    n, width = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(width)]
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in x), n) - Fraction(s[i] * s[j], n * n)) for j in range(width)] for i in range(width)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    values = values[values > 1e-12 * values.sum()][:k]
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    deviation = defaultdict(Counter)
    for (i, _), v in zip(kept, x, strict=True):
        deviation[i][sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))] += 1
    for i, rows in by_id.items():
        assert Counter(r.deviation for r in rows if r.component == 1) == deviation[i]
    assert len(got) == n * len(values) and {r.component for r in got} == set(range(1, len(values) + 1))
    white = np.zeros((n, len(values)))
    seen = Counter()
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained
        white[[k for k, (i, _) in enumerate(kept) if i == r.vec_id][seen[r.vec_id, r.component]], r.component - 1] = r.whitened
        seen[r.vec_id, r.component] += 1
    off = np.abs(np.cov(white.T, bias=True).reshape(len(values), -1) - np.eye(len(values))).max()
    assert off < 1e-6 and {r.identity_error for r in got} == {got[0].identity_error} and abs(got[0].identity_error - off) < 1e-6
    # whitened rows are the centred ones on eigenvectors: turned back by the covariance they give it
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in x])
    loads = centred.T @ white / n
    assert np.allclose(cov @ loads, loads * values, atol=1e-6 * values[0] * np.sqrt(values[0]))


VECTORS = "vec_id long, embedding array<float>, id long, component int, n long, v string"


def test_whitening_by_hand(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.normal(i % 3, [5, 1, 0.1, 3, 0.5])], 1, 2, 3, "x") for i in range(60)]
    odd = [(100, None, 1, 2, 3, "x"), (101, [1.0, None, 0.0, 0.0, 0.0], 1, 2, 3, "x"), (102, [float("nan")] * 5, 1, 2, 3, "x"), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, 2, 3, "x"), (104, [0.0] * 5, 1, 2, 3, "x"), good[7], (None, [1.0, 2.0, 3.0, 4.0, 5.0], 1, 2, 3, "x")]
    frame = spark.createDataFrame(good + odd, VECTORS)
    check_whitening(frame, whitening.whitened(frame).withColumnRenamed("id", "vec_id").collect())
    short = frame.unionByName(spark.createDataFrame([(200, [1.0], 1, 2, 3, "x"), (201, [], 1, 2, 3, "x")], VECTORS))  # another width takes no part
    assert whitening.whitened(short).count() == whitening.whitened(frame).count() == 62 * 5 + 5
    assert {r.component for r in whitening.whitened(frame, components=2).collect()} == {1, 2}


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[]] * 3, [None]])
def test_whitening_of_nothing(spark, rows):
    assert whitening.whitened(spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in enumerate(rows)], VECTORS)).count() == 0


def test_whitening_without_a_direction(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0], 1, 2, 3, "x") for i in range(9)]  # one direction only
    frame = spark.createDataFrame(rows, VECTORS)
    check_whitening(frame, whitening.whitened(frame).withColumnRenamed("id", "vec_id").collect())


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e30, 3e38])
def test_whitening_of_large_entries(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c * scale)) for c in rng.uniform(-1, 1, 4)], 1, 2, 3, "x") for i in range(40)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = whitening.whitened(frame).withColumnRenamed("id", "vec_id").collect()
    if scale < 1e15:
        return check_whitening(frame, got)
    # longer than 38 digits: null, the rest stays right
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-6 and len(got) == 160


def test_products_are_exact():
    for most in (10, 1 << 26, 1 << 40, 1 << 61):
        y = np.random.default_rng(most % 97).integers(-most, most, (50, 3))
        sums, cross = whitening.products(y)
        big = [[int(v) for v in row] for row in y]
        assert sums == [sum(r[j] for r in big) for j in range(3)] and cross == [[sum(r[i] * r[j] for r in big) for j in range(3)] for i in range(3)]


def test_op13(spark):
    frame = spark.read.parquet(f"{DIR}/embeddings.parquet")
    got = registry.queries()["op13_embedding_whitening"](spark, DIR)
    assert dict(got.dtypes) | {"deviation": "bigint", "n": "bigint", "component": "int", "whitened": "double"} == dict(got.dtypes)
    check_whitening(frame.where("vec_id < 1000000"), got.collect())
