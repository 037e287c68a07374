r"""Personal data by weak supervision.

Wide patterns propose spans: whatever has an at sign, three or more dotted numbers, eight colon-separated hexadecimal groups, 12 or more
digits, 7 or more digits with phone separators, or a token of 12 or more characters with a digit. Five labelers vote on each (yes, no, abstain):
its strict pattern, a gazetteer (tables of known beginnings and endings, a parameter), words around it, a validity check and its borders. Spans with equal votes and
features are counted over all documents; expectation-maximisation over these counts estimates how often each labeler is right for each kind,
from a prior belief in each labeler (RATES) that weighs as ten spans and the square root of their number, so its share vanishes as spans are found. Its posteriors train a logistic classifier on the spans'
features, which decides. Both models see counts of patterns, of which there is a fixed number, never the spans themselves.

Base spans (email, ip, card, phone by the contract's expressions) always stay; the classifier's spans are added where
no span of their kind overlaps them. Offsets are code points of the whole text. All patterns are scanned in time linear in the text: runs are
taken whole, and an address is read from its at sign outward. Proposals have no bound of length, but for phone numbers, of which 7 to 31 characters are the pattern.

Null and empty texts have no spans. Very long texts and words are scanned whole. Repeated rows are judged each for itself. Extra columns pass
through, renamed if they clash; an empty table gives an empty one. A kind of which no span is proposed has no model and adds none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, unclash

#: Kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone", "secret"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match that starts within a run of digits fails or succeeds like one at the run's start, so only those are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

AT = re.compile(r"@|\(at\)|\[at\]")
BEFORE_AT = re.compile(r"\s?[\w.%+-]++")  # read backward
AFTER_AT = re.compile(r"\s?[\w-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]++)++")
WIDE = {
    "ip": re.compile(r"(?<![0-9A-Za-z_.])[0-9]++(?:\.[0-9]++){2,}+|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|\()?[0-9][0-9 ().-]{5,29}[0-9](?![0-9])"),
    "secret": re.compile(r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])[0-9A-Za-z+/_-]{12,}+"),
}
STRICT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"),
    "card": re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}"),
    "phone": re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}"),
    "secret": re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|[0-9a-f]{16,}|[0-9A-F]{16,}"),
}
#: The gazetteer's tables: what a span of a kind ends with (after its last dot or a spelled-out one) or begins with.
ENDINGS = {"email": {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"}}
BEGINNINGS = {
    "ip": {"10.", "127.", "172.", "192.", "8.", "1."},
    "card": {"4", "34", "37", "65", "6011", *map(str, range(51, 56)), *map(str, range(22, 28))},
    "phone": {"+", "00", "("},
    "secret": {"AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghr_", "ghs_", "sk-", "sk_", "xox"},
}
CUES = {
    "email": re.compile(r"(?i)e-?mail|contact|write"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login"),
    "card": re.compile(r"(?i)card|visa|credit|account|payment"),
    "phone": re.compile(r"(?i)phone|call|tel\b|mobile|fax|contact"),
    "secret": re.compile(r"(?i)token|password|passwd|secret|api[_-]?key|access"),
}
AGAINST = re.compile(r"(?i)version|isbn|page|chapter|http|www|sha\d|commit|§|invoice|order")
#: What is believed of each labeler before any count: chances of (no, abstain, yes) for a span that is none and for one that is.
RATES = {
    "strict": ((0.6, 0.0, 0.4), (0.1, 0.0, 0.9)),
    "gazetteer": ((0.0, 0.75, 0.25), (0.0, 0.5, 0.5)),
    "context": ((0.2, 0.75, 0.05), (0.02, 0.73, 0.25)),
    "check": ((0.9, 0.0, 0.1), (0.01, 0.0, 0.99)),
    "border": ((0.3, 0.0, 0.7), (0.05, 0.0, 0.95)),
}
LABELERS = list(RATES)


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def quad(span: str) -> bool:
    """Four dotted numbers of at most 255."""
    parts = span.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str):
    """The contract's addresses: of each at sign the characters before it back to the last address, and the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        here = text[last:at]
        start = last + len(here.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        last = m.end() if m else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), leftmost and non-overlapping for each kind; matches that fail are dropped."""
    out = [(0, *s) for s in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if quad(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def valid(kind: str, span: str) -> int:
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return 1 if ":" in span or quad(span) else -1
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 15 and span.count("(") == span.count(")") and not quad(span) else -1
    if kind == "secret":
        counts, n = Counter(span), len(span)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        return 1 if entropy >= 2.8 and 0 < len(digits) < n and len(digits) * 20 >= n else -1
    return 1 if re.fullmatch("[A-Za-z]{2}", span[-2:]) else -1


def votes(kind: str, text: str, start: int, end: int, gazetteer: Gazetteer | None = None) -> tuple[int, ...]:
    """By LABELERS: 1 yes, -1 no, 0 abstains."""
    span, before = text[start:end], text[max(0, start - 30) : start]
    border = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return (
        1 if STRICT[kind].fullmatch(span) else -1,
        1 if (gazetteer or DEFAULT).knows(kind, span) else 0,
        1 if CUES[kind].search(before) else -1 if AGAINST.search(before) else 0,
        valid(kind, span),
        1 if border else -1,
    )


def features(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Small whole numbers: length, digits, separators and letters in classes, what stands before, what after, a cue before, whether the check holds."""
    span = text[start:end]
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    cue = CUES[kind].search(text, max(0, start - 30), start) is not None
    return min(5, len(span) // 8), 4 * digits // len(span), min(4, len(span) - digits - letters), 3 * letters // len(span), side(text[start - 1 : start]), side(text[end : end + 1]), int(cue), int(valid(kind, span) > 0)


def wide_emails(text: str):
    last = 0
    for at in AT.finditer(text):
        # neither side reaches past another at sign, so no character is read for two of them
        head, tail = BEFORE_AT.match(text[last : at.start()][::-1]), AFTER_AT.match(text, at.end())
        if head and tail:
            yield at.start() - head.end(), tail.end()
        last = tail.end() if head and tail else at.end()


def proposals(text: str):
    """(number of the kind, start, end) of the wide patterns, in order of start within a kind."""
    some = DIGIT.search(text) is not None
    for k, kind in enumerate(KINDS):
        for start, end in wide_emails(text) if kind == "email" else (m.span() for m in WIDE[kind].finditer(text)) if some else ():
            yield k, start, end


def pattern(k: int, text: str, start: int, end: int, gazetteer: Gazetteer | None = None) -> str:
    v, f = votes(KINDS[k], text, start, end, gazetteer), features(KINDS[k], text, start, end)
    return f"{k}|{','.join(map(str, v))}|{','.join(map(str, f))}"


def prior_rates() -> np.ndarray:
    """[labeler, is one, vote + 1], each a little above nothing."""
    rates = np.array([RATES[x] for x in LABELERS]) + 1e-3
    return rates / rates.sum(2, keepdims=True)


@dataclass(frozen=True)
class Gazetteer:
    """Tables by kind, small enough to be sent to every task."""

    endings: dict[str, set[str]] = field(default_factory=lambda: ENDINGS)
    beginnings: dict[str, set[str]] = field(default_factory=lambda: BEGINNINGS)

    def knows(self, kind: str, span: str) -> bool:
        ends = self.endings.get(kind)
        if ends:
            last = re.search(r"[A-Za-z0-9-]*$", span[-64:])[0]
            before = span[: len(span) - len(last)]
            known = last.lower() in ends and (before.endswith(".") or re.search(r"(?i)dot[)\]]?\s?$", before[-6:]) is not None)
            return known or any(last.lower() == f"dot{e}" for e in ends)
        begins = self.beginnings.get(kind, ())
        return any(span.startswith(b) for b in begins)


DEFAULT = Gazetteer()


class Aggregator:
    """Posteriors of vote patterns of one kind by expectation-maximisation; given are votes by LABELERS, counts how many spans have them."""

    def __init__(self, given: np.ndarray, counts: np.ndarray, rounds: int = 50):
        believed, mass = prior_rates(), 10 + math.sqrt(counts.sum())
        self.rates, self.prior = believed, 0.5
        for _ in range(rounds):
            self.posterior = self.judge(given)
            self.prior = float(np.clip((counts @ self.posterior + 1) / (counts.sum() + 2), 0.01, 0.99))
            found = believed * mass
            for v in (-1, 0, 1):
                there = (given == v) * counts[:, None]
                found[:, 1, v + 1] += self.posterior @ there
                found[:, 0, v + 1] += (1 - self.posterior) @ there
            self.rates = found / found.sum(2, keepdims=True)
        self.posterior = self.judge(given)

    def judge(self, given: np.ndarray) -> np.ndarray:
        odds = np.full(len(given), math.log(self.prior / (1 - self.prior)))
        for j in range(given.shape[1]):
            odds += np.log(self.rates[j, 1] / self.rates[j, 0])[given[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


WIDTHS = (6, 5, 5, 4, 4, 4, 2, 2)


def one_hot(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(rows), 1)), *[np.eye(w)[rows[:, i]] for i, w in enumerate(WIDTHS)]], axis=1)


class Classifier:
    """Logistic, one for each kind, over the spans' features; weights by kind."""

    def __init__(self, patterns: dict[str, int]):
        self.weights, self.aggregators, self.known = {}, {}, {}
        for k in range(len(KINDS)):
            mine = [(p.split("|"), n) for p, n in sorted(patterns.items()) if p.startswith(f"{k}|")]
            if not mine:
                continue
            given = np.array([[int(x) for x in p[1].split(",")] for p, _ in mine])
            x = one_hot(np.array([[int(c) for c in p[2].split(",")] for p, _ in mine]))
            n = np.array([c for _, c in mine], float)
            self.aggregators[k] = Aggregator(given, n)
            y, w, scale = self.aggregators[k].posterior, np.zeros(x.shape[1]), n / n.sum() * min(n.sum(), 1e6)
            for _ in range(25):  # Newton
                q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h = (x * (scale * q * (1 - q) + 1e-9)[:, None]).T @ x + np.eye(len(w))
                w = w + np.clip(np.linalg.solve(h, x.T @ (scale * (y - q)) - w), -3, 3)
            self.weights[k] = w

    def reliabilities(self) -> list[tuple[str, str, bool, int, float]]:
        """(kind, labeler, whether a span is one, vote, how often it votes so), as estimated."""
        rows = [(KINDS[k], x, bool(real), v - 1, float(a.rates[j, real, v])) for k, a in self.aggregators.items() for j, x in enumerate(LABELERS) for real in (0, 1) for v in range(3)]
        return rows

    def accepts(self, k: int, text: str, start: int, end: int) -> bool:
        """Whether the classifier takes a span; there are few different features, so each answer is kept."""
        if k not in self.weights:
            return False
        key = (k, *features(KINDS[k], text, start, end))
        if key not in self.known:
            self.known[key] = bool((one_hot(np.array([key[1:]])) @ self.weights[k])[0] >= 0)
        return self.known[key]

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """base and the accepted proposals that overlap nothing of their kind."""
        taken = {k: [s for s in base if s[0] == k] for k in range(len(KINDS))}
        added, reach = [], {}
        for k, a, b in proposals(text):
            fixed = taken[k]
            i = bisect_left(fixed, (k, b, 0))  # base spans before start below b; they do not overlap, so the last one reaches farthest
            if (i and fixed[i - 1][2] > a) or reach.get(k, 0) > a or not self.accepts(k, text, a, b):
                continue
            added.append((k, a, b))
            reach[k] = b
        return sorted([*base, *added])


def train(documents: DataFrame, gazetteer: Gazetteer | None = None) -> Classifier:
    def count(batches):
        found = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(pattern(*p[:1], text, *p[1:], gazetteer) for p in proposals(text))
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = documents.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return Classifier({r.pattern: r.n for r in rows})


def find(documents: DataFrame, model: Classifier | None = None) -> DataFrame:
    """documents with base_spans and pii_spans, arrays of (kind, start, end) by kind and start."""
    documents = unclash(documents, {"base_spans", "pii_spans"})
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*documents.schema.fields, T.StructField("base_spans", span), T.StructField("pii_spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def run(batches):
        for batch in batches:
            base, every = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                b = base_spans(text or "")
                base.append(listed(b))
                every.append(listed(shared.value.spans(text or "", b)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(every, kind)], names=schema.names)

    return documents.mapInArrow(run, schema)


def digest(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_weak_pii(spark, sf_dir):
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_secret = F.size(F.filter("pii_spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(digest("base_spans"), 256).alias("base_sha256"), digest("pii_spans").alias("spans"), n_secret, F.size("pii_spans").cast("long").alias("n_spans"))
