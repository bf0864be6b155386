"""Personal data: fixed patterns, and spans of a semi-Markov conditional random field.

The field scores whole candidate segments - up to ``MAX_TOKENS`` tokens with a digit or an at
sign - by features of the span as one: its digit groups, check digits, separators, the cue
word before it and what touches its ends.  Dynamic programming over segment ends chooses
boundaries and kinds jointly; tokens outside segments have scores of their own.  Weights are
fit here, by gradient ascent on the conditional likelihood of a table of labelled sentences
that a rule makes.

Tokens without a digit or an at sign near them cannot be part of a segment, so the program
runs over the regions around such tokens, with ``REACH`` characters of context, and skips the
rest of a text without a change of the result.

Cases: a null or empty text has no spans; a null id is passed on; repeated rows give one
result each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .scratch import modest
from .spans import Span, free, scanned

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban")
MAX_TOKENS, MAX_CHARS, REACH = 16, 48, 24
SENTENCES, EPOCHS, RATE, RIDGE, SEED = 320, 8, 0.5, 1e-3, 11

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: What an address has from its at sign on, and what stands before it.  Looking from the sign
#: backwards takes every character once; a search for ``EMAIL`` takes a long run again from each of its characters.
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
TRIGGER = re.compile(r"[0-9@]")
#: Words before a span that name its kind.
CUES = {
    "email": ("mail", "email", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank"),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    out, done = [], 0
    for m in HOST.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end(), "email"))
            done = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    out: list[Span] = emails(text) if "@" in text else []
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _bucket(n: int) -> str:
    return str(n) if n < 4 else "4-6" if n < 7 else "7-9" if n < 10 else "10-13" if n < 14 else "14-19" if n < 20 else "20+"


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the segment ``text[a:b]`` as a whole."""
    span = text[a:b]
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    marks = re.sub(r"[^\W_]+", "", span)
    letters = sum(c.isalpha() for c in span)
    out = [
        "bias",
        f"digits {_bucket(len(digits))}",
        f"letters {_bucket(letters)}",
        f"groups {'-'.join(map(str, map(len, groups))) if len(groups) < 6 else 'many'}",
        f"marks {''.join(sorted(set(marks)))}",
        f"first {span[0] if not span[0].isalnum() else 'a' if span[0].isalpha() else '0'}",
        f"last {span[-1] if not span[-1].isalnum() else 'a' if span[-1].isalpha() else '0'}",
    ]
    if 14 <= len(digits) <= 19 and not letters:
        out.append(f"luhn {luhn(digits)}")
    if len(groups) == 4 and span.count(".") == 3 and not letters:
        out.append(f"octets {all(int(g) < 256 for g in groups)}")
    if EMAIL.fullmatch(span):
        out.append("address")
    if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,32}", span):
        out.append("country")
    before, after = text[a - 1 : a], text[b : b + 1]
    out.append(f"left {'edge' if not before else 'blank' if before.isspace() else 'word' if before.isalnum() else before}")
    out.append(f"right {'edge' if not after else 'blank' if after.isspace() else 'word' if after.isalnum() else after}")
    if after and text[b + 1 : b + 2].isalnum() and not after.isspace():
        out.append(f"joined {after if not after.isalnum() else 'word'}")
    cues = {CUE_OF[w] for w in re.findall(r"[^\W\d_]+", text[max(0, a - REACH) : a].lower())[-2:] if w in CUE_OF}
    out += [f"cue {c}" for c in sorted(cues)] or ["cue none"]
    return out


class Lattice:
    """The tokens of a region and its candidate segments, by their ends."""

    def __init__(self, text: str, low: int = 0, high: int | None = None):
        tokens = [m.span() for m in TOKEN.finditer(text, low, len(text) if high is None else high)]
        self.tokens = tokens
        self.outside = []
        trigger, blank = [], []
        for a, b in tokens:
            t = text[a:b]
            trigger.append(t[0].isdigit() or t == "@")
            blank.append(t[0].isspace())
            self.outside.append("o digit" + _bucket(b - a) if t[0].isdigit() else "o at" if t == "@" else "o word")
        counts = np.concatenate([[0], np.cumsum(trigger)]).tolist() if tokens else [0]
        self.segments, self.features = [], []
        for i, (a, _) in enumerate(tokens):
            if blank[i]:
                continue
            for j in range(i, min(i + MAX_TOKENS, len(tokens))):
                b = tokens[j][1]
                if b - a > MAX_CHARS:
                    break
                if not blank[j] and counts[j + 1] > counts[i] and "\n" not in text[a:b]:
                    self.segments.append((i, j + 1))
                    self.features.append(features(text, a, b))


def sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """The labelled table, by rule: sentences with spans of each kind and with numbers that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((13, 14, 14, 15)))
        body += next(c for c in "0123456789" if luhn(body + c))
        cut = rng.choice(("", " ", "-", "."))
        return cut.join(body[i : i + 4] for i in range(0, len(body), 4))

    makers = {
        "email": lambda: f"{word()}{rng.choice(('.', '_', '', '+'))}{rng.choice((word(), digits(2)))}@{word()}.{rng.choice(('com', 'org', 'example.net'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice((f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}")),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: rng.choice(("DE", "FR", "ES", "GB")) + digits(2) + rng.choice((digits(18), "".join(f" {digits(4)}" for _ in range(4)))),
    }
    others = (
        lambda: digits(rng.randint(1, 4)),
        lambda: f"{rng.randint(1, 19)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}",
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}/{digits(2)}/19{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}",
        lambda: f"{digits(rng.randint(5, 24))}",
        lambda: f"{word()}{digits(rng.randint(1, 4))}",
        lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{digits(2)}-{digits(3)}",
        lambda: f"@{word()}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40))),
        lambda: f"{digits(4)}-{digits(4)}",
        lambda: f"{rng.randint(1, 40)} x {rng.randint(1, 40)} - {rng.randint(1, 900)}",
    )
    rows = []
    for k in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.randint(1, 3)):
            kind = list(makers)[k % len(makers)] if rng.random() < 0.45 else None
            text += rng.choice((" ", " ", ", ", ". ")) if text else ""
            if kind and rng.random() < 0.35:
                text += rng.choice(CUES[kind]) + rng.choice((" ", ": "))
            piece = makers[kind]() if kind else rng.choice(others)()
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice(("", "", ".", ",", " " + word()))
        rows.append((text, spans))
    return rows


class Field:
    """Weights by feature and kind; the last column scores tokens outside segments."""

    def __init__(self, rows: list[tuple[str, list[Span]]], epochs: int = EPOCHS):
        lattices = [(Lattice(t), t, s) for t, s in rows]
        names = dict.fromkeys(f for lattice, *_ in lattices for fs in [*lattice.features, lattice.outside] for f in fs)
        self.index = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros((len(names), len(KINDS)))
        squares = np.full_like(self.weights, 1e-2)
        ready = [(lattice, [np.array([self.index[f] for f in fs]) for fs in lattice.features], self._gold(lattice, spans)) for lattice, _, spans in lattices]
        order = random.Random(SEED)
        for _ in range(epochs):
            order.shuffle(ready)
            for lattice, ids, gold in ready:
                slope = np.zeros_like(self.weights)
                self._slope(lattice, ids, gold, slope)
                slope -= RIDGE * self.weights
                squares += slope**2
                self.weights += RATE * slope / np.sqrt(squares)

    @staticmethod
    def _gold(lattice: Lattice, spans: list[Span]) -> dict[tuple[int, int], int]:
        start, end = {a: i for i, (a, _) in enumerate(lattice.tokens)}, {b: i + 1 for i, (_, b) in enumerate(lattice.tokens)}
        return {(start[a], end[b]): KINDS.index(k) for a, b, k in spans}

    def _scores(self, lattice: Lattice, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        inside = np.array([self.weights[i].sum(0) for i in ids]).reshape(-1, len(KINDS))
        outside = np.array([self.weights[self.index[f], 0] if f in self.index else 0.0 for f in lattice.outside])
        return inside, outside

    def _slope(self, lattice, ids, gold, slope) -> None:
        inside, outside = self._scores(lattice, ids)
        n, segments = len(lattice.tokens), lattice.segments
        whole = np.logaddexp.reduce(inside, axis=1) if len(inside) else np.zeros(0)
        by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(segments):
            by_end[j].append(k)
            by_start[i].append(k)
        ahead, back = np.zeros(n + 1), np.zeros(n + 1)
        for e in range(1, n + 1):
            ahead[e] = np.logaddexp.reduce([ahead[e - 1] + outside[e - 1], *(ahead[segments[k][0]] + whole[k] for k in by_end[e])])
        for e in range(n - 1, -1, -1):
            back[e] = np.logaddexp.reduce([back[e + 1] + outside[e], *(back[segments[k][1]] + whole[k] for k in by_start[e])])
        covered = np.zeros(n, bool)
        for (i, j), kind in gold.items():
            covered[i:j] = True
        for k, (i, j) in enumerate(segments):
            p = -np.exp(ahead[i] + inside[k] + back[j] - ahead[n])
            if (i, j) in gold:
                p[gold[i, j]] += 1
            np.add.at(slope, ids[k], p)
        for e in range(n):
            p = np.exp(ahead[e] + outside[e] + back[e + 1] - ahead[n])
            slope[self.index[lattice.outside[e]], 0] += (not covered[e]) - p

    def best(self, text: str, low: int = 0, high: int | None = None) -> list[Span]:
        """The most likely segmentation of ``text[low:high]``: its segments."""
        lattice = Lattice(text, low, high)
        ids = [np.array([self.index[f] for f in fs if f in self.index], np.int64) for fs in lattice.features]
        inside, outside = self._scores(lattice, ids)
        n = len(lattice.tokens)
        at_end = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(lattice.segments):
            at_end[j].append(k)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for e in range(1, n + 1):
            best[e] = best[e - 1] + outside[e - 1]
            for k in at_end[e]:
                kind = int(inside[k].argmax())
                score = best[lattice.segments[k][0]] + inside[k, kind]
                if score > best[e]:
                    best[e], back[e] = score, (lattice.segments[k][0], kind)
        out, e = [], n
        while e > 0:
            if back[e] is None:
                e -= 1
            else:
                i, kind = back[e]
                out.append((lattice.tokens[i][0], lattice.tokens[e - 1][1], KINDS[kind]))
                e = i
        return out[::-1]


@lru_cache(maxsize=1)
def default_field() -> Field:
    return Field(sentences())


def regions(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of the triggers, grown to the ends of words."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    for r in out:
        while r[0] > 0 and not text[r[0] - 1].isspace():
            r[0] -= 1
        while r[1] < len(text) and not text[r[1]].isspace():
            r[1] += 1
    return [(a, b) for a, b in out]


def scan(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those that the field adds."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    more = [s for a, b in regions(text) for s in field.best(text, a, b)]
    return base, free(list(dict.fromkeys(more)), base)


def find_personal(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document row: ``doc_id``, counts and digest of the base spans, and all spans."""
    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE_KINDS)}, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(lambda it: scanned(it, lambda t: scan(t, shared.value), BASE_KINDS, KINDS), schema)
