"""Personal data by candidate gradient boosting.

Fixed patterns find the base spans. Beside them high-recall generators propose overlapping candidates of the same kinds (runs that the patterns
matched and dropped, cut at their groups; any four of more dotted numbers; national, spaced and spelled-out forms); boosted trees score each by format and
context; candidates at or above their kind's calibrated threshold are taken by falling score where they overlap no other span.
Base spans always stay.

No table has labels of personal data, so the trees are trained, and the thresholds calibrated on held-out rows, over a seeded synthetic corpus of
personal data and look-alikes (dates, versions, sums, serial numbers, wrong cuts) in invented prose, made here and nowhere stored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered_columns, slices, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

#: The base patterns. The lookbehind only spares starts inside a run of digits, which can't match where the run's start fails.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else twice[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> list[Span]:
    """As the pattern finds them, in linear time: from each @ back over the local part, on over the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start, m = at, _DOMAIN.match(text, at + 1)
        while m and start > end and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            out.append((start, end := m.end()))
        at = text.find("@", max(end, at + 1))
    return out


def base(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans of a text by kind, and the matches that were dropped."""
    kept: dict[str, list[Span]] = {"email": _emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    dropped: dict[str, list[Span]] = {k: [] for k in KINDS}
    for m in _IP.finditer(text):
        good = all(map(_byte, m.group().split(".")))
        (kept if good else dropped)["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            (kept if 13 <= len(d) <= 19 and luhn(d) else dropped)["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            (kept if 9 <= n <= 15 else dropped)["phone"].append(m.span())
    return kept, dropped


_NATIONAL = re.compile(r"(?<![0-9+.\w])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9])")
#: An address is tried from the start of its local part only, so a text is read once, whatever its length.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?:(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.)[A-Za-z0-9-]+)+")
#: As _SPELLED where no dot is spelled: the domain is written as it is.
_HALF_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers joined by dots beyond four, of which any four may be an address; addresses whose dots are written otherwise.
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?| dot | \. )[0-9]{1,3}(?:(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?| dot | \. )[0-9]{1,3}){2}(?![0-9])")
_GROUP = re.compile(r"[0-9]+")
#: Digits that a cut of a dropped run has at most; every group is tried as its start.
MOST_DIGITS = {"card": 19, "phone": 15}


def _byte(digits: str) -> bool:
    """Whether digits are a part of an ip address, however long a number they are."""
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or 0) <= 255


def candidates(text: str, kept: dict[str, list[Span]], dropped: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """Spans proposed beside the base ones: (kind, start, end), which may overlap each other."""
    out = set()
    for kind in ("card", "phone"):
        for a, b in dropped[kind]:
            groups = [(a + m.start(), a + m.end()) for m in _GROUP.finditer(text[a:b])]
            for i, (s, _) in enumerate(groups):
                n = 0
                for j in range(i, len(groups)):
                    n += groups[j][1] - groups[j][0]
                    if n > MOST_DIGITS[kind]:
                        break
                    if n >= (13 if kind == "card" else 9):
                        out.add((kind, a if kind == "phone" and i == 0 else s, groups[j][1]))
    if text.count(".") > 2 and any(c in text for c in "0123456789"):
        for m in _DOTTED.finditer(text):
            parts = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m.group())]
            fits = [_byte(text[a:b]) for a, b in parts]
            out |= {("ip", parts[k][0], parts[k + 3][1]) for k in range(len(parts) - 3) if all(fits[k : k + 4])}
        # a plain dotted four is a base span, and dropped ones with a part above 255 hold no address
    if any(mark in text for mark in ("[.]", "(.)", "[dot]", "(dot)", " dot ", " . ")):
        out |= {("ip", *m.span()) for m in _DEFANGED.finditer(text) if all(_byte(g) for g in _GROUP.findall(m.group()))}
    if any(c in text for c in "0123456789"):
        out |= {("phone", *m.span()) for m in _NATIONAL.finditer(text)}
    if "(at)" in text or "[at]" in text or (" at " in text and (" dot " in text or "[dot]" in text or "(dot)" in text)):
        out |= {("email", *m.span()) for m in _SPELLED.finditer(text)}
    elif " at " in text:
        out |= {("email", *m.span()) for m in _HALF_SPELLED.finditer(text)}
    taken = sorted(s for spans in kept.values() for s in spans)
    starts, ends = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    # of the base spans that start before a candidate's end, does any end after its start?
    return sorted(c for c in out if ends[bisect_left(starts, c[2])] <= c[1])


_CUES = {
    "phone": ("phone", "call", "tel", "mobile", "fax", "dial", "ring"), "card": ("card", "visa", "credit", "pay", "debit"), "email": ("mail", "write", "contact"), "ip": ("ip", "host", "server", "address", "login"),
    "none": ("version", "order", "invoice", "serial", "isbn", "date", "id", "sum", "no", "ref"),
}


#: Common top-level domains.
_TOP_LEVELS = frozenset("com org net edu gov info biz io eu de fr es uk us it nl ch at be se no pl ru jp cn br ca au mx".split())
_LABEL, _LOCAL_PART = re.compile(r"[A-Za-z0-9-]+\Z"), re.compile(r"[A-Za-z0-9._%+-]+")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, left, right = text[start:end], text[max(0, start - 32) : start], text[end : end + 8]
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    groups = [len(g) for g in _GROUP.findall(span)] or [0]
    parts = [int(g[:4]) for g in _GROUP.findall(span)] or [0]
    seps = [c for c in span if not c.isalnum()]
    words = re.findall(r"[a-z]+", left.lower())[-3:]
    cue = lambda k: float(any(w.startswith(_CUES[k]) for w in words))
    before, after = left[-1:], right[:1]
    return [
        float(KINDS.index(kind)), len(span), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1], len(set(seps)), float("(" in span), float(span.startswith("+")),
        float(luhn(digits)) if 13 <= len(digits) <= 19 else -1.0, float(digits[:1] or -1), float(before.isalnum()), float(after.isalnum()), float(before in "./-+_" and before != ""),
        float(after in "./-_" and right[1:2].isdigit()), float(left[-2:-1].isdigit() and not before.isalnum()), float(right[1:2].isdigit() and not after.isalnum()), cue(kind), cue("none"),
        float(max(parts) <= 255), float(any(1900 <= p <= 2099 for p in parts)), float("at" in span and "dot" in span or "[at]" in span or "(at)" in span), float(len(re.findall("[A-Za-z]+$", span)[0]) if span[-1:].isalpha() else 0),
        float("[" in span or "(." in span), float(groups[-2] if len(groups) > 1 else 0), float(len(following.group()) if (following := _GROUP.match(right, 1)) else 0),
        float((label := _LABEL.search(span)) is not None and label.group().lower() in _TOP_LEVELS), float((local := _LOCAL_PART.match(span)) is not None and any(not c.isalpha() for c in local.group())),
        float(" at " in span and not any(c in span for c in "([")),
    ]


class Trees:
    """Boosted regression trees of logistic loss, split by second-order gain at quantile cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, leaf: float = 3.0):
        self.rate, self.depth = rate, depth
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.04, 0.96, 24))) for j in range(x.shape[1])]
        # a row's place among a feature's cuts: it is at or below cut k if its place is k at most
        width = 1 + max(map(len, cuts))
        place = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) + np.arange(x.shape[1]) * width
        self.trees = []
        f = np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree: dict[int, tuple] = {}
            f += rate * self._grow(tree, 1, place, width, p - y, p * (1 - p), np.arange(len(y)), cuts, leaf)
            self.trees.append(tree)

    def _grow(self, tree: dict, node: int, place: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, at: np.ndarray, cuts: list, leaf: float) -> np.ndarray:
        out = np.zeros(len(g))
        gs, hs, best = g[at].sum(), h[at].sum(), (1e-3, -1, 0)
        if node < 1 << self.depth and len(at):
            n = place.shape[1]
            sums = [np.bincount(place[at].ravel(), np.repeat(v[at], n), minlength=n * width).reshape(n, width).cumsum(1) for v in (g, h)]
            gl, hl = sums[0], sums[1]
            gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
            gain[(hl <= leaf / 4) | (hs - hl <= leaf / 4)] = -1.0
            for j, c in enumerate(cuts):
                gain[j, len(c) :] = -1.0
            j, k = np.unravel_index(gain.argmax(), gain.shape)
            if gain[j, k] > best[0]:
                best = (gain[j, k], int(j), int(k))
        if best[1] < 0:
            tree[node] = (-1, 0.0, v := -gs / (hs + 1))
            out[at] = v
            return out
        _, j, k = best
        tree[node] = (j, float(cuts[j][k]), 0.0)
        low = place[at, j] - j * width <= k
        return self._grow(tree, 2 * node, place, width, g, h, at[low], cuts, leaf) + self._grow(tree, 2 * node + 1, place, width, g, h, at[~low], cuts, leaf)

    def score(self, row: list[float]) -> float:
        total = 0.0
        for tree in self.trees:
            node = 1
            while (split := tree[node])[0] >= 0:
                node = 2 * node + (row[split[0]] > split[1])
            total += split[2]
        return 1 / (1 + float(np.exp(-self.rate * total)))

    def scores(self, rows: list[list[float]]) -> list[float]:
        """The score of each row; many rows go down each tree together."""
        if len(rows) < 64:
            return [self.score(r) for r in rows]
        x, total = np.array(rows), np.zeros(len(rows))
        for tree in self.trees:
            size = max(tree) + 1
            split, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            for node, (j, t, v) in tree.items():
                split[node], cut[node], value[node] = j, t, v
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                down = np.flatnonzero(split[at] >= 0)
                here = at[down]
                at[down] = 2 * here + (x[down, split[here]] > cut[here])
            total += value[at]
        return (1 / (1 + np.exp(-self.rate * total))).tolist()


def _synthetic(rng: random.Random, n: int) -> Iterator[tuple[str, dict[tuple[str, int, int], bool]]]:
    """Texts and the true spans in them."""
    syllables = "an on er re th in ed is ou ha st nd la de en que ción ung sch keit lle pa".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return body if rng.random() < 0.6 else rng.choice(" -").join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(rng.randint(2, 9)) + num(2), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+49 {a} {num(7)}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+44 20 {c} {num(4)}"])

    national = lambda: rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{rng.randint(200, 999)}-{num(3)}-{num(4)}", f"{rng.randint(200, 999)}.{num(3)}.{num(4)}", f"0044 20 {num(4)} {num(4)}"])
    ip = lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4))
    spelled = lambda: rng.choice([f"{word()} [at] {word()} [dot] com", f"{word()}(at){word()}.org", f"{word()} [at] {word()} dot net", f"{word()}[at]mail{num(1)}.example.com"])

    def decoy() -> str:
        y = str(rng.randint(1900, 2099))
        return rng.choice([
            f"{y}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{y}", f"{num(2)}/{num(2)}/{y}", f"{y}-{num(2)}-{num(2)} {num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(2)}.{num(1)}.{num(1)}", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(2)}",
            f"{rng.randint(256, 999)}.{num(1)}.{num(2)}.{num(4)}", f"{num(1)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", num(rng.randint(20, 32)), num(16), f"{num(4)}-{num(4)}-{num(4)}-{num(4)}-{num(4)}",
            f"{num(2)} {num(3)} {num(3)}", f"{num(3)} {num(3)}.{num(2)}", f"{word()} at {word()} dot {word()}", f"+{num(20)}", f"+{num(3)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(2)}-{num(3)}", f"{y} - {y}", f"{y} {num(2)} {num(2)}",
        ])

    for _ in range(n):
        text, truth = " ".join(word() for _ in range(rng.randint(0, 6))), {}

        def put(kind: str, s: str, sep: str = " ") -> None:
            nonlocal text
            text += sep if text else ""
            if kind:
                truth[kind, len(text), len(text) + len(s)] = True
            text += s

        for _ in range(rng.randint(1, 2)):
            what = rng.randint(0, 9)
            if rng.random() < 0.3:
                put("", rng.choice([c for k in ("phone", "card", "email", "ip", "none") for c in _CUES[k]]), " ")
            if what == 0:
                put("phone", phone())
                put("card", card())
            elif what == 1:
                put("card", card())
                put("card", card())
            elif what == 2:
                put("phone", phone())
                put("", num(rng.randint(5, 12)))
            elif what == 3:
                put("phone", national())
            elif what == 4:
                put("email", spelled())
            elif what == 5:
                put("", str(rng.randint(256, 999)))
                put("ip", ip(), ".") if rng.random() < 0.3 else put("card", card())
            else:
                put("", decoy())
            put("", " ".join(word() for _ in range(rng.randint(1, 5))), rng.choice([" ", " ", ". ", ", "]))
        yield text, truth


def _spaced(rng: random.Random, n: int) -> Iterator[tuple[str, dict[tuple[str, int, int], bool]]]:
    """As _synthetic: numbers written in groups of one or two digits beside other digits, and addresses with ' at ' but a plain dot."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    groups = lambda d, k: [d[i : i + k] for i in range(0, len(d), k)]

    def card() -> str:
        body = rng.choice("3456") + num(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    for _ in range(n):
        sep, what = rng.choice("  -"), rng.randint(0, 9)
        cue = rng.choice(_CUES[("card", "card", "card", "phone", "phone", "email", "email", "none", "none", "none")[what]]) if rng.random() < 0.7 else word()
        before, after, kind = "", "", ""
        if what < 3:
            kind, said = "card", sep.join(groups(card(), rng.choice([1, 1, 2])))
            if rng.random() < 0.75:
                after = sep + num(rng.randint(3, 6))
            else:
                before = num(rng.randint(3, 6)) + sep
        elif what < 5:
            kind, said, after = "phone", "+" + " ".join(groups(rng.choice("123456789") + num(rng.randint(9, 12)), 1)), " " + num(rng.randint(5, 8))
        elif what < 7:
            kind, said = "email", f"{word()} at {word()}.{rng.choice(['com', 'org', 'net', 'example.com', 'de'])}"
        elif what == 7:
            said = sep.join(groups(num(rng.randint(20, 40)), rng.choice([1, 2])))
        elif what == 8:
            said = sep.join(str(k) for k in range(rng.randint(0, 3), rng.randint(15, 40)))
        else:
            said = f"{rng.choice(['look', 'only', 'shop', 'news', 'more', 'live', 'here'])} at {word()}.{rng.choice(['com', 'org', 'net'])}"
        text = f"{word()} {cue} {before}"
        yield f"{text}{said}{after} {word()} {word()}", {(kind, len(text), len(text) + len(said)): True} if kind else {}


def _dotted(rng: random.Random, n: int) -> Iterator[tuple[str, dict[tuple[str, int, int], bool]]]:
    """As _synthetic: addresses of hosts with their dots written otherwise or a number before or after them, and versions, sections, dates and object numbers of as many parts; numbers after others."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    byte = lambda: str(rng.choice([rng.randint(0, 255), 10, 192, 168, 172, 127]))
    small = lambda: str(rng.randint(0, 12))
    for _ in range(n):
        what, kind, before, after = rng.randint(0, 9), "ip", "", ""
        cue = rng.choice(_CUES["ip" if what < 6 else "none"]) if rng.random() < 0.8 else word()
        parts = [byte() for _ in range(4)]
        if what < 3:
            mark = rng.choice(["[.]", "[.]", "(.)", "[dot]", "(dot)", " [.] ", " dot ", " . "])
            said = mark.join(parts) if rng.random() < 0.7 else ".".join(parts[:3]) + "[.]" + parts[3] if mark == "[.]" else mark.join(parts)
        elif what < 5:
            said, before = ".".join(parts), f"{rng.randint(256, 9999)}."
        elif what == 5:
            said, after = ".".join(parts), f".{num(rng.randint(4, 6))}"
        elif what == 6:
            kind, said = "", ".".join(small() for _ in range(rng.randint(5, 9)))
        elif what == 7:
            kind, said = "", f"1.3.6.1.{small()}.{small()}.{num(rng.randint(1, 5))}.{small()}"
        elif what == 8:
            kind, said = "", f"{rng.randint(1990, 2030)}.{rng.randint(1, 12)}.{rng.randint(1, 28)}.{rng.randint(0, 23)}.{rng.randint(0, 59)}"
        else:
            kind, said = "phone", "+" + rng.choice("123456789") + num(rng.randint(9, 12))
            before = "+" + " ".join(num(3) for _ in range(6)) + " " if rng.random() < 0.5 else ""
        text = f"{word()} {cue} {before}"
        yield f"{text}{said}{after} {word()} {word()}", {(kind, len(text), len(text) + len(said)): True} if kind else {}


def _mixed(rng: random.Random, n: int) -> Iterator[tuple[str, dict[tuple[str, int, int], bool]]]:
    """As _synthetic: addresses with every pair of marks for at and dot, sentences with these words in them, numbers in groups of any sizes and signs, which are no one's, and cards before other digits."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    local = lambda: word() + rng.choice(["", "", rng.choice("._-") + word(), num(rng.randint(1, 3))])
    tops = sorted(_TOP_LEVELS)
    for _ in range(n):
        what, kind, after = rng.randint(0, 9), "", ""
        cue = rng.choice(_CUES["email"]) if what < 4 and rng.random() < 0.5 else word() if rng.random() < 0.7 else rng.choice(_CUES[rng.choice(["none", "phone", "card"])])
        if what < 4:
            at, dot = rng.choice([" at ", "(at)", "[at]", " (at) ", " [at] "]), rng.choice([" dot ", "(dot)", "[dot]", " (dot) ", " [dot] ", "."])
            plain = at == " at " and dot in (" dot ", ".")  # only what stands before tells these from sentences
            kind, said = "email", local() + at + dot.join([*(word() + rng.choice(["", "-" + word(), num(2)]) for _ in range(rng.choice([1, 1, 2]))), rng.choice(tops)])
            cue = rng.choice(_CUES["email"]) if plain else cue
        elif what == 4:
            said = f"{word()} at {word()}{rng.choice([' dot ', '.'])}{rng.choice([word(), rng.choice(tops)])}"
            cue = word()
        elif what == 5:
            said = rng.choice([f"{word()} at {word()}. {word().title()}", f"{word()} dot {word()}", f"{word()} at {num(2)}.{num(4)}"])
        elif what == 6:
            body = rng.choice("3456") + num(14)
            body += next(d for d in "0123456789" if luhn(body + d))
            sep = rng.choice(" -")
            kind, said, after = "card", body if rng.random() < 0.5 else sep.join(body[i : i + 4] for i in range(0, 16, 4)), sep + num(rng.randint(2, 6))
        elif what < 9:
            sizes, sep = [rng.randint(1, 6) for _ in range(rng.randint(2, 6))], rng.choice(" -./,")
            if rng.random() < 0.4:  # often all groups are of one size
                sizes = sizes[:1] * len(sizes)
            if sizes[:3] == [3, 3, 4]:
                sizes = [2, *sizes]
            said = sep.join(str(rng.randint(1, 9)) + num(k - 1) for k in sizes) if rng.random() < 0.7 else "".join(num(k) + rng.choice(" -./") for k in sizes) + str(rng.randint(1, 9)) + num(5)
        else:
            said = f"{num(2)}.{num(rng.randint(2, 6))}{rng.choice([' ', ', ', '/'])}{num(2)}.{num(rng.randint(2, 6))}"
        text = f"{word()} {cue} "
        yield f"{text}{said}{after} {word()} {word()}", {(kind, len(text), len(text) + len(said)): True} if kind else {}


@cache
def trained(seed: int = 11, texts: int = 5000, precision: float = 0.99) -> tuple[Trees, dict[str, float]]:
    """Trees fitted on two thirds of the synthetic texts, and each kind's least threshold with that precision on the others."""
    rows: list[list[list[float]]] = [[], []]
    truth: list[list[float]] = [[], []]
    kinds: list[str] = []
    for i, (text, true) in enumerate(chain(_synthetic(random.Random(seed), texts), _spaced(random.Random(seed), texts // 3), _dotted(random.Random(seed), texts // 3), _mixed(random.Random(seed), texts))):
        part = int(i % 3 == 2)
        for c in candidates(text, *base(text)):
            rows[part].append(features(text, *c))
            truth[part].append(float(c in true))
            if part:
                kinds.append(c[0])
    trees = Trees(np.array(rows[0]), np.array(truth[0]))
    scores, y = np.array([trees.score(r) for r in rows[1]]), np.array(truth[1])
    thresholds = {}
    for kind in KINDS:
        of = np.array([k == kind for k in kinds])
        good = [t for t in np.linspace(0.5, 0.99, 50) if y[of & (scores >= t)].sum() >= precision * max(1, (of & (scores >= t)).sum())]
        if not good or not y[of & (scores >= good[0])].sum():
            raise ValueError(f"no threshold gives {kind} that precision")
        thresholds[kind] = float(good[0])
    return trees, thresholds


def spans(text: str, trees: Trees, thresholds: dict[str, float]) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) of a text by kind, each by start."""
    kept, dropped = base(text)
    found = candidates(text, kept, dropped)
    if not found:
        return kept, kept
    every, taken = {k: list(v) for k, v in kept.items()}, []
    scored: list[tuple[float, tuple[str, int, int]]] = []
    for i in range(0, len(found), 20_000):
        part = found[i : i + 20_000]
        scored += [(-s, c) for s, c in zip(trees.scores([features(text, *c) for c in part]), part, strict=True) if s >= thresholds[c[0]]]
    for _, (kind, a, b) in sorted(scored):
        # spans taken so far don't overlap each other, so only the last that starts before b can reach over a
        near = bisect_left(taken, (b,))
        if not near or taken[near - 1][1] <= a:
            insort(taken, (a, b))
            every[kind].append((a, b))
    return kept, {k: sorted(v) for k, v in every.items()}


def joined(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), a row per row; the counts are of base spans. Null texts are empty. No shuffle.

    Repeated rows stay, null ids too; texts of any length are searched whole; an empty table gives an empty one. Only the two named columns are read, so others may have any name.
    """
    trees, thresholds = trained()
    names = ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                kept, every = spans(text, trees, thresholds)
                said = joined(kept)
                n = [len(kept[k]) for k in KINDS]
                rows.append((*n, hashlib.sha256(said.encode()).hexdigest(), said if every is kept else joined(every), sum(map(len, every.values())) - sum(n)))
            columns = [pa.array([r[i] for r in rows], pa.string() if i in (4, 5) else pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, schema)


def redacted(text: str, trees: Trees, thresholds: dict[str, float]) -> str:
    _, every = spans(text, trees, thresholds)
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, found in every.items() for a, b in found):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; n_chars, where there is one, is set anew. Null texts stay null; rows and columns stay, whatever the columns' names.

    Repeated rows are redacted alike; texts of any length whole; an empty table gives an empty one.
    """
    trees, thresholds = trained()
    names, schema = docs.columns, docs.schema
    place, sized = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t if t is None else redacted(t, trees, thresholds) for t in batch.column(place).to_pylist()]
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            if sized is not None:
                batch = batch.set_column(sized, batch.schema.field(sized), pa.array([t if t is None else len(t) for t in texts], batch.schema.field(sized).type))
            yield batch.rename_columns(names)

    return numbered_columns(docs).mapInArrow(run, schema)


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
