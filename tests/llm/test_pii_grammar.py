"""op5 against spans that another grammar than the training one's plants into texts of the tables."""

import random
from collections import Counter

import duckdb

from quillstack.llm import pii

NAMES = "maria john.smith k_weber anne-lise tom99 p.garcia office sales.team info22 luc".split()
HOSTS = "posteo mailbox uni-bonn acme-corp web lacasa firma24 nordnet".split()
TOPS = "org net com de fr es eu info".split()


class Grammar:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def num(self, k):
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def byte(self):
        return str(self.rng.randint(0, 255))

    def visa(self):
        body = "4" + self.num(14)
        return body + next(d for d in "0123456789" if pii.luhn(body + d))

    def who(self, at, dot):
        return f"{self.rng.choice(NAMES)}{at}{self.rng.choice(HOSTS)}{dot}{self.rng.choice(TOPS)}"

    def groups(self, sep):
        s = self.visa()
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def planted(self):
        """(kind, before, span, after)"""
        r, n = self.rng, self.num
        return r.choice([
            lambda: ("email", "reach me under ", self.who(" (at) ", " (dot) "), ""), lambda: ("email", "my address is ", self.who("[at]", "."), ", thanks"), lambda: ("email", "e-mail: ", self.who(" at ", " dot "), "."),
            lambda: ("email", "send it to ", self.who(" [at] ", " [dot] "), " today"), lambda: ("email", "mail ", self.who(" at ", "."), " please"),
            lambda: ("ip", "seen from ", "[.]".join(self.byte() for _ in range(4)), " last night"), lambda: ("ip", "the gateway ", "(dot)".join(self.byte() for _ in range(4)), " answers"), lambda: ("ip", "ping ", " dot ".join(self.byte() for _ in range(4)), ""),
            lambda: ("card", "charged to ", self.groups(" "), f" {n(3)} yesterday"), lambda: ("card", "my visa ", self.groups("-"), f"-{n(4)} expires"), lambda: ("card", "number ", self.visa(), f" {n(4)} and so on"),
            lambda: ("phone", "call ", f"({n(3)}) {n(3)}-{n(4)}", " after six"), lambda: ("phone", "my cell is ", f"{r.randint(200, 999)}-{n(3)}-{n(4)}", "."), lambda: ("phone", "office: ", f"{r.randint(200, 999)}.{n(3)}.{n(4)}", " (days)"),
            lambda: ("phone", "from abroad ", f"00{r.choice(['44', '49', '33'])} {r.randint(20, 99)} {n(4)} {n(4)}", " only"), lambda: ("phone", "ring ", f"+49 {r.randint(30, 89)} {n(7)}", f" {n(6)} is the code"),
        ])()

    def decoy(self):
        r, n = self.rng, self.num
        return r.choice([
            lambda: f"ISBN 978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"from {r.randint(1900, 1999)}-{r.randint(2000, 2020)}", lambda: f"release {n(1)}.{n(2)}.{n(1)}.{n(1)}.{n(2)}", lambda: f"doi 10.{n(4)}/{n(3)}", lambda: f"order {n(4)}-{n(4)}-{n(4)}",
            lambda: f"look at {r.choice(HOSTS)}.{r.choice(TOPS)}", lambda: "we met at noon. Then home", lambda: f"{r.randint(2000, 2025)}-0{r.randint(1, 9)}-1{n(1)} 1{n(1)}:{n(1)}0:{n(1)}5", lambda: f"EUR {n(1)}.{n(3)}.{n(3)},{n(2)}",
            lambda: f"won {n(1)}-{n(1)}, {n(1)}-{n(1)}", lambda: f"at 52.{n(4)} 13.{n(4)}", lambda: f"invoice {n(3)}-{n(2)}-{n(4)}", lambda: f"section {n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}", lambda: f"serial {n(5)} {n(5)} {n(5)} {n(5)}",
            lambda: "look at dot matrix printers", lambda: "stay at home dot com bubble", lambda: f"part {n(3)}-{n(3)}-{n(3)}", lambda: f"lot {n(2)}.{n(3)}.{n(4)}",
        ])()


def test_spans_of_another_grammar():
    """Recall and precision of each kind over 3,000 texts, half of them with a look-alike in place of a span."""
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where length(text) > 300 order by doc_id limit 1500").fetchall()]
    g = Grammar(41)
    trees, thresholds = pii.trained()
    found, missed, wrong = Counter(), Counter(), Counter()
    for i in range(3000):
        words = g.rng.choice(texts).split(" ")
        start = g.rng.randint(0, max(0, len(words) - 120))
        words = words[start : start + g.rng.randint(30, 120)]
        at = g.rng.randint(1, len(words) - 1)
        left, right, true = " ".join(words[:at]) + " ", " " + " ".join(words[at:]), None
        if i % 2:
            kind, before, span, after = g.planted()
            true = kind, len(left + before), len(left + before + span)
            text = left + before + span + after + right
        else:
            text = left + g.decoy() + right
        kept, every = pii.spans(text, trees, thresholds)
        spans = {(k, *s) for k in pii.KINDS for s in every[k]}
        if true:
            (found if true in spans else missed)[true[0]] += 1
        wrong.update(k for k, a, b in spans - {true} if (a, b) not in kept[k])
    recall = {k: found[k] / (found[k] + missed[k]) for k in pii.KINDS}
    precision = {k: found[k] / (found[k] + wrong[k]) for k in pii.KINDS}
    print("recall", recall, "precision", precision)
    assert min(recall.values()) > 0.9 and min(precision.values()) > 0.9
