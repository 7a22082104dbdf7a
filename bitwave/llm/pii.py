"""Personal data by gradient boosting over candidate spans.

Base spans follow four fixed patterns and always stay. High-recall generators propose more spans,
overlapping ones too: number groups of any form, words around an at sign (also spelled out), dotted
and colon-separated numbers. Trees boosted on format and context features score each candidate; a
calibrated threshold for each kind accepts it if it overlaps no base span.

Training has two sources. Written examples: TAUGHT snippets made by rule, that hold personal data in forms
the fixed patterns do not know (numbers without a plus or with dots, spelled-out addresses, long network
addresses) near words that speak of them, and look-alikes (order numbers, versions, dates, device
addresses, mentions). And candidates of a bounded sample of the texts themselves (parameters, picked by a
hash of the text): a positive if a fixed pattern validates it, a negative if none does and no word near it
speaks of its kind; the others teach nothing. A quarter of both is held out, and the threshold of a kind is
the lowest score at which PRECISION of the held-out candidates above it are positives; without such a score
the kind accepts nothing.

Defined results: a null text counts as empty; an empty text has no spans; equal rows give equal
rows; extra columns are ignored; an empty table gives an empty result. Scans are linear in a text's
length: runs are read once and no pattern is retried inside a run.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Texts in the training sample, on average, and candidates taken of them, at most.
SAMPLE_TEXTS, MOST_CANDIDATES = 4_000, 30_000
#: Written examples, and bytes of a text's part around its candidates that one row of the sample has, at most.
TAUGHT, PART = 6_000, 4_096
#: Of accepted calibration candidates, positives at least.
PRECISION = 0.98
CONTEXT = 24

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Generators: kind, and a pattern that is cheap and wide. Every run is read once.
WIDE = (
    ("phone", re.compile(r"(?<![0-9])[+(]?[0-9]{2,}+(?:[ ().-]{1,2}[0-9]{2,}+){2,}+(?![0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./-]?[0-9]{2,6}){2,5}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9a-fA-F:.])(?:[0-9a-fA-F]{1,4}:){2,7}(?::|[0-9a-fA-F]{1,4})(?::?[0-9a-fA-F]{1,4})*+(?![0-9a-fA-F:])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,}+)++")),
)
GATE = {"phone": re.compile("[0-9][ ().-]"), "card": re.compile("[0-9]{4}"), "ip": re.compile("[0-9a-fA-F]:[0-9a-fA-F:]"), "email": re.compile(r"@|\(at\)|\[at\]")}
#: Words that speak of a kind, and words that speak of something else.
CUES = {
    "email": ("mail", "contact", "write", "écri", "schreib", "escrib"), "ip": ("ip", "host", "server", "addr", "client"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "fax", "mobil", "anruf", "appel", "llam"),
}
OTHERWISE = ("order", "invoice", "ref", "serial", "version", "isbn", "date", "total", "part", "mac", "time", "token", "id")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        elif start < at:
            done = at  # a run is read once
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of the generators; spans of different kinds may overlap."""
    found = {}
    for kind, pattern in WIDE:
        if GATE[kind].search(text):
            for m in pattern.finditer(text):
                found.setdefault((kind, m.start(), m.end()))
    return list(found)


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features. What the fixed patterns validate is left out."""
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    groups = re.findall("[0-9]+", s)
    lens = [len(g) for g in groups] or [0]
    count = lambda chars: sum(s.count(c) for c in chars)
    digits = "".join(groups)
    return [
        KINDS.index(kind), float(13 <= len(digits) <= 19 and luhn(digits)), count("/"), float("::" in s), len(re.findall("[0-9a-fA-F]+", s)), len(s), sum(lens), len(groups), max(lens), min(lens), lens[0], lens[-1], count("."), count("-"), count(" "), count("()"), count("+"), count(":"), count("@"), count("[]"),
        float(s[:1] == "+"), float(s[:1] == "("), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "+-.,:/@#"), float(after[:1] in "-.,:/@%"),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), sum(c.isalpha() for c in before), *[float(any(c in before for c in CUES[k])) for k in KINDS], *[float(c in before) for c in OTHERWISE],
    ]


@dataclass
class Trees:
    """Boosted trees of a fixed depth for the logistic loss, on quantile bins."""

    rounds: int = 40
    depth: int = 4
    rate: float = 0.2
    least: int = 5
    bias: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 32), method="lower")) for j in range(x.shape[1])]
        b, width = self.binned(x), 34
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.bias)
        columns = np.arange(b.shape[1])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(len(y), int), {}
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == k)
                    if len(at) < 2 * self.least:
                        continue
                    flat = (b[at] + columns * width).ravel()
                    m = len(columns) * width
                    gs = np.bincount(flat, np.repeat(g[at], len(columns)), m).reshape(-1, width).cumsum(1)
                    hs = np.bincount(flat, np.repeat(h[at], len(columns)), m).reshape(-1, width).cumsum(1)
                    cs = np.bincount(flat, minlength=m).reshape(-1, width).cumsum(1)
                    gt, ht = g[at].sum(), h[at].sum()
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(cs < self.least) | (len(at) - cs < self.least)] = -1
                    f, cut = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, cut] > 1e-6:
                        tree[k] = (int(f), int(cut))
                        node[at] = np.where(b[at, f] <= cut, 2 * k + 1, 2 * k + 2)
            leaf = {int(k): float(-self.rate * g[node == k].sum() / (h[node == k].sum() + 1)) for k in np.unique(node)}
            self.trees.append((tree, leaf))
            margin += np.vectorize(leaf.get)(node)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        margin = np.full(len(b), self.bias)
        for tree, leaf in self.trees:
            node = np.zeros(len(b), int)
            for _ in range(self.depth):
                for k in np.unique(node):
                    if int(k) in tree:
                        f, cut = tree[int(k)]
                        at = node == k
                        node[at] = np.where(b[at, f] <= cut, 2 * k + 1, 2 * k + 2)
            margin += np.array([leaf.get(int(k), 0.0) for k in node])
        return 1 / (1 + np.exp(-margin))


@dataclass
class Detector:
    trees: Trees | None = None
    thresholds: dict = field(default_factory=dict)

    def spans(self, text: str) -> tuple[list, list]:
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text: base spans, and accepted candidates that overlap none of them nor each other.
        The candidates of all texts are scored at once."""
        bases, free = [base_spans(t) for t in texts], []
        for i, (text, base) in enumerate(zip(texts, bases, strict=True) if self.trees and self.thresholds else ()):
            # Only candidates outside every base span can be accepted, so only those are scored.
            marks = sorted((s, e) for _, s, e in base)
            ends = np.maximum.accumulate([e for _, e in marks]) if marks else []
            starts = [s for s, _ in marks]
            free += [(i, c) for c in candidates(text) if c[0] in self.thresholds and not ((j := np.searchsorted(starts, c[2])) and ends[j - 1] > c[1])]
        more: list[list] = [[] for _ in texts]
        if free:
            scores = self.trees.score(np.array([describe(texts[i], *c) for i, c in free], float))
            for s, (i, c) in sorted(zip(scores, free, strict=True), key=lambda x: (x[1][0], x[1][1][1], -x[0], x[1][1])):
                if s >= self.thresholds[c[0]] and not (more[i] and more[i][-1][2] > c[1]):
                    more[i].append(c)
        return list(zip(bases, more, strict=True))


def taught(number: int = TAUGHT) -> list[tuple[str, str, int, int, bool]]:
    """Written examples: (text, kind, start, end, whether it is personal data)."""
    import random

    r = random.Random(17)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    group = lambda: f"{r.randrange(1, 65536):x}"

    def card() -> str:
        d = str(r.choice((4, 5))) + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def spread(d: str, by: str) -> str:
        return by.join(d[i : i + 4] for i in range(0, len(d), 4))

    phones = [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", lambda: f"0{digits(3)} {digits(3)} {digits(4)}"]
    spelled_out = [lambda: f"{word()} (at) {word()} (dot) com", lambda: f"{word()}.{word()} [at] {word()}.example.org", lambda: f"{word()}{digits(2)}(at){word()}(dot)net", lambda: f"{word()} @ {word()}.com"]
    long = [lambda: ":".join(group() for _ in range(8)), lambda: f"{group()}:{group()}:{group()}::{group()}:{group()}", lambda: f"fe80:{group()}:{group()}::{group()}"]
    good = {"phone": phones, "card": [lambda: spread(card(), "."), lambda: spread(card(), "/")], "ip": long, "email": spelled_out}
    bad = {
        "phone": [*phones, lambda: f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(2)} {digits(2)} {digits(3)} {digits(2)}"],
        "card": [lambda: digits(16), lambda: spread(digits(16), "."), lambda: spread(digits(16), " "), lambda: spread(card(), "."), lambda: digits(20)],
        "ip": [lambda: ":".join(f"{r.randrange(256):02x}" for _ in range(6)), lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: ":".join(digits(2) for _ in range(4))],
        "email": [lambda: f"{word()} (at) {digits(2)}.{digits(2)}", lambda: f"{word()} @ {digits(1)}.{digits(2)}", lambda: f"{digits(2)} @ {digits(2)}.{digits(2)}"],
    }
    out = []
    while len(out) < number:
        kind, real = r.choice(KINDS), r.random() < 0.4
        cue = r.choice(CUES[kind]) + r.choice(("", "", word())) + r.choice((" ", ": ", " at ", " number ")) if real else r.choice((word() + " ", r.choice(OTHERWISE) + r.choice((" ", ": ", " no. ")), f"{word()} {word()} "))
        text = f"{word()} {word()} {cue}"
        span = r.choice((good if real else bad)[kind])()
        whole = f"{text}{span}{r.choice((' ', '. ', ', '))}{word()} {word()}"
        found = [c for c in candidates(whole) if c[0] == kind and c[1] < len(text) + len(span) and len(text) < c[2]]
        out += [(whole, *c, real and c[1:] == (len(text), len(text) + len(span))) for c in found if not real or c[1:] == (len(text), len(text) + len(span))] or [(whole, kind, len(text), len(text) + len(span), False)][: not real]
    return out


def fit(texts: list[str], examples: list | None = None) -> Detector:
    """Trees on three quarters of the candidates, thresholds on the rest."""
    rows, labels, kinds, hold = [], [], [], []
    for i, (text, kind, s, e, real) in enumerate(taught() if examples is None else examples):
        rows.append(describe(text, kind, s, e))
        labels.append(float(real))
        kinds.append(kind)
        hold.append(i % 4 == 3)
    for i, text in enumerate(texts):
        valid = set(base_spans(text))
        for kind, s, e in candidates(text):
            # One of another extent than the valid span it overlaps teaches nothing clear, nor does one of
            # a form of its own next to a word that speaks of it.
            if (kind, s, e) not in valid and (any(s < f and b < e for _, b, f in valid) or any(c in text[max(0, s - CONTEXT) : s].lower() for c in CUES[kind])):
                continue
            rows.append(describe(text, kind, s, e))
            labels.append(float((kind, s, e) in valid))
            kinds.append(kind)
            hold.append(i % 4 == 3)
    x, y, k, hold = np.array(rows, float), np.array(labels), np.array(kinds), np.array(hold, bool)
    if not len(y) or not (~hold).sum() or y[~hold].min() == y[~hold].max():
        return Detector()
    trees = Trees().fit(x[~hold], y[~hold])
    scores, thresholds = trees.score(x[hold]), {}
    for kind in KINDS:
        s, t = scores[k[hold] == kind], y[hold][k[hold] == kind]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        last = np.flatnonzero(np.append(s[order][1:] != s[order][:-1], True) & (right >= PRECISION)) if len(t) else []
        if len(last) and last[-1] >= 9:
            thresholds[kind] = max(0.5, float(s[order][last[-1]]))
    return Detector(trees, thresholds)


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Detector:
    """A detector from a bounded sample of texts with digits or at signs."""
    small_batches(docs.sparkSession)
    share = min(1.0, sample_texts / max(1, docs.count()))
    text = text_or_empty()
    picked = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003).where(F.col("text").rlike("[0-9@]")).distinct()

    def parts(batches):  # only what describe() can see of a text goes to the driver
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                spans = sorted([(max(0, s - CONTEXT - 2), e + CONTEXT + 2) for _, s, e in [*candidates(t), *base_spans(t)]])
                kept, at = [], -1
                for s, e in spans:
                    if s <= at:
                        kept[-1] = (kept[-1][0], max(e, at))
                    else:
                        kept.append((s, e))
                    at = kept[-1][1]
                out += [t[s:e] for s, e in kept if e - s < PART]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["part"])

    found = [r.part for r in picked.mapInArrow(parts, "part string").distinct().orderBy(F.xxhash64("part"), "part").limit(MOST_CANDIDATES).collect()]
    return fit(found)


def spelled(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, counts of base spans, the digest of base spans, all spans."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        for batch in batches:
            rows = sent.value.spans_of([t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in rows], pa.string())
            spans = pa.array([spelled(base + more) for base, more in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, spans], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, learn(docs))


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; n_chars, if there, follows."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(detector)
    at = docs.columns.index("text")

    def clean(text, found):
        if text is None:
            return None
        out, done = [], 0
        spans = [s for both in found for s in both]
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= done:
                out += [text[done:s], f"<{kind}>"]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = sent.value.spans_of([t or "" for t in texts])
            yield batch.set_column(at, batch.schema.names[at], pa.array(list(map(clean, texts, found)), batch.schema.types[at]))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
