"""Secret scan: fixed rules, and formats learnt by grammar inference.

For each format of a table of labelled credentials a prefix tree is built, and states whose
frequencies are statistically compatible (Hoeffding bounds, checked along all common
continuations, down to the ends) are merged, the best attested first.  The result is a
probabilistic automaton over characters: a step is taken by a symbol, which is a character
that the labelled tokens of the format share at that place, a mark, or any other character,
and a state gives each class of those a probability.  Steps tell a format's fixed parts and
its length, classes its alphabet.

A candidate token is scored by its log-likelihood in each automaton against a background:
automata inferred in the same way from ordinary tokens of many shapes, random identifiers
among them.  The best format above ``MIN_BITS`` names the span.  All tokens of the text's
long-token class are candidates.

Cases: a null or empty text has no spans; a null id is passed on; repeated rows give one
result each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log, log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import modest
from .spans import Span, free, scanned

BASE_KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else f"{c}?" for c in word)


ASSIGN = re.compile(f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token', 'api_key')))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
ANY_WORD = re.compile("|".join(WORDS[:4]) + "|api_?key")
#: Tokens that the automata score.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{6,})*")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = LOWER + UPPER + DIGITS
#: Published credential formats, as prefixes and (alphabet, shortest, longest) of what follows.
FORMATS = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ((ALNUM, 36, 36),)),
    "slack": (("xoxb-", "xoxp-", "xoxa-"), ((DIGITS, 10, 12), "-", (DIGITS, 10, 12), "-", (ALNUM, 24, 24))),
    "google": (("AIza",), ((ALNUM + "_-", 35, 35),)),
    "stripe": (("sk_live_", "rk_live_", "sk_test_"), ((ALNUM, 24, 34),)),
    "jwt": (("eyJ",), ((ALNUM, 17, 40), ".eyJ", (ALNUM, 20, 80), ".", (ALNUM + "_-", 43, 43))),
    "base64": (("",), ((ALNUM + "+/", 40, 40),)),
    "uphex": (("",), ((DIGITS + "ABCDEF", 32, 64),)),
}
KINDS = (*BASE_KINDS, *FORMATS)

EXAMPLES, SEED = 160, 17
#: Bound of the chance of keeping apart two states that behave alike.
ALPHA = 0.05
#: Probabilities, in bits, of a step or a class that no example took and of an end where none ended.
UNSEEN, NO_END = -12.0, -24.0
#: Bits by which a format must be more likely than the background.
MIN_BITS = 2.0
#: Places at the front where a character can be a symbol of its own, and the share of examples that must have it there.
FRONT, SHARE = 8, 0.15


def labelled(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str]]:
    """The labelled table, by rule: (token, format), and ordinary tokens, whose formats begin with a dash."""
    rng = random.Random(seed)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    rows = []
    for name, (prefixes, parts) in FORMATS.items():
        for _ in range(n):
            rows.append((rng.choice(prefixes) + "".join(p if isinstance(p, str) else draw(p[0], rng.randint(*p[1:])) for p in parts), name))
    word = lambda: draw(LOWER, rng.randint(2, 9))
    shapes = (
        lambda: draw(LOWER, rng.randint(16, 30)),
        lambda: draw(UPPER, rng.randint(16, 24)),
        lambda: draw(ALNUM, rng.randint(16, 64)),
        lambda: draw(ALNUM + "_-", rng.randint(16, 64)),
        lambda: draw(LOWER + DIGITS, rng.randint(16, 40)),
        lambda: draw(UPPER + DIGITS, rng.randint(16, 40)),
        lambda: draw(DIGITS + "abcdef", rng.randint(16, 64)),
        lambda: "".join(word().title() for _ in range(rng.randint(3, 8))),
        lambda: "_".join(word().upper() for _ in range(rng.randint(3, 6))),
        lambda: "_".join(rng.choice((word(), word().title(), draw(DIGITS, 2))) for _ in range(rng.randint(4, 7))),
        lambda: "/".join(rng.choice((word(), word().title(), word().upper(), word() + word().title())) for _ in range(rng.randint(4, 8))),
        lambda: "-".join(word() for _ in range(4)),
        lambda: "_".join(word() for _ in range(4)),
        lambda: "/".join(word() for _ in range(4)),
        lambda: word() + "".join(word().title() for _ in range(3)),
        lambda: draw(DIGITS, rng.randint(16, 20)),
        lambda: f"20{draw(DIGITS, 2)}-{draw(DIGITS, 2)}-{draw(DIGITS, 2)}-{word()}-{word()}",
        lambda: f"{word()}-{word()}-{draw(DIGITS, 3)}-{word()}",
        lambda: f"{draw(DIGITS + 'abcdef', 8)}-" + "-".join(draw(DIGITS + "abcdef", 4) for _ in range(3)) + f"-{draw(DIGITS + 'abcdef', 12)}",
        lambda: rng.choice("=-_") * rng.randint(16, 40),
        lambda: rng.choice("+/" + UPPER + LOWER) * rng.randint(16, 80),
        lambda: "".join(rng.sample("=-_+/", 2)) * rng.randint(8, 30),
        lambda: "".join(rng.sample(UPPER + LOWER, 2)) * rng.randint(8, 40),
        lambda: "+" + "".join(rng.choice("-=") * rng.randint(3, 12) + "+" for _ in range(rng.randint(4, 6))),
        lambda: "".join("/" + word() for _ in range(rng.randint(4, 8))),
        lambda: "/".join(word() for _ in range(3)) + "/" + word().upper(),
        lambda: rng.choice(("", "/")) + "/".join(word().title() for _ in range(rng.randint(4, 8))),
    )
    rows += [(make(), f"-{k}") for k, make in enumerate(shapes) for _ in range(n)]
    return rows


#: Characters of a class, by its name; ``~`` stands for one of the two characters before.
CLASSES = {"a": 6, "z": 20, "A": 6, "Z": 20, "0": 10, "~": 2}
#: Characters that are marks of a format if this share of its examples has the same number of them, one at least.
MARKS, STEADY = ".-", 0.9


def classes(token: str) -> list[str]:
    """The class of every character; a mark is a class of its own."""
    out = []
    for i, c in enumerate(token):
        if i > 1 and c in token[i - 2 : i]:
            out.append("~")
        elif c.isalnum():
            out.append("0" if c.isdigit() else ("a" if c <= "f" else "z") if c.islower() else ("A" if c <= "F" else "Z"))
        else:
            out.append(c)
    return out


@dataclass
class State:
    total: int = 0
    ends: int = 0
    depth: int = 0
    counts: Counter = field(default_factory=Counter)
    kinds: Counter = field(default_factory=Counter)
    next: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic deterministic automaton, inferred by merging states of a prefix tree."""

    def __init__(self, tokens: list[str], alpha: float = ALPHA):
        fronts = Counter((i, c) for t in tokens for i, c in enumerate(t[:FRONT]))
        self.front = {key for key, n in fronts.items() if n > SHARE * len(tokens)}
        usual = {c: Counter(t.count(c) for t in tokens).most_common(1)[0] for c in MARKS}
        self.marks = {c for c, (n, times) in usual.items() if n and times > STEADY * len(tokens)}
        self.states: dict[int, State] = {0: State()}
        for token in tokens:
            at = 0
            for c, kind in zip(self.symbols(token), classes(token), strict=True):
                s = self.states[at]
                s.total += 1
                s.counts[c] += 1
                if c == "x":
                    s.kinds[kind] += 1
                if c not in s.next:
                    s.next[c] = len(self.states)
                    self.states[s.next[c]] = State(depth=s.depth + 1)
                at = s.next[c]
            self.states[at].total += 1
            self.states[at].ends += 1
        self.bound = sqrt(0.5 * log(2 / alpha))
        self._infer()
        self._score()

    def symbols(self, token: str) -> list[str]:
        """A shared character at the front, or a mark, with an equals sign before it; else ``x``."""
        return ["=" + c if (i, c) in self.front or c in self.marks else "x" for i, c in enumerate(token)]

    def _alike(self, x: int, y: int, depth: int = 160) -> bool:
        todo = [(x, y, 0)]
        while todo:
            x, y, d = todo.pop()
            a, b = self.states[x], self.states[y]
            if not a.total or not b.total:
                continue
            limit = self.bound * (1 / sqrt(a.total) + 1 / sqrt(b.total))
            if limit < 1:  # else nothing can differ enough
                if abs(a.ends / a.total - b.ends / b.total) > limit:
                    return False
                if any(abs(a.counts[c] / a.total - b.counts[c] / b.total) > limit for c in a.counts.keys() | b.counts.keys()):
                    return False
                if any(abs(a.kinds[c] / a.total - b.kinds[c] / b.total) > limit for c in a.kinds.keys() | b.kinds.keys()):
                    return False
            if d < depth:
                todo += [(a.next[c], b.next[c], d + 1) for c in a.next.keys() & b.next.keys() if a.next[c] != b.next[c]]
        return True

    def _fold(self, into: int, other: int) -> None:
        todo = [(into, other)]
        while todo:
            x, y = todo.pop()
            if x == y or y not in self.states:
                continue
            a, b = self.states[x], self.states.pop(y)
            a.total += b.total
            a.ends += b.ends
            a.counts.update(b.counts)
            a.kinds.update(b.kinds)
            for c, z in b.next.items():
                if c in a.next:
                    todo.append((a.next[c], z))
                else:
                    a.next[c] = z

    def _infer(self) -> None:
        """Red states stay; the best attested state next to them merges with a compatible red one, of its own depth if there is one, or turns red."""
        red, seen = [0], {0}
        while True:
            blue = [(r, c, t) for r in red for c, t in sorted(self.states[r].next.items()) if t not in seen]
            if not blue:
                return
            source, c, at = max(blue, key=lambda b: (self.states[b[2]].total, -self.states[b[2]].depth))
            depth = self.states[at].depth
            for r in sorted(red, key=lambda r: (self.states[r].depth != depth, abs(self.states[r].depth - depth), r)):
                if self._alike(r, at):
                    self.states[source].next[c] = r
                    self._fold(r, at)
                    break
            else:
                red.append(at)
                seen.add(at)

    def _score(self) -> None:
        self.steps, self.kinds, self.ends = {}, {}, {}
        for k, s in self.states.items():
            self.steps[k] = {c: (log2(n / s.total), s.next[c]) for c, n in s.counts.items()}
            free = sum(s.kinds.values())
            self.kinds[k] = {c: log2(n / free / CLASSES.get(c, 1)) for c, n in s.kinds.items()}
            self.ends[k] = log2(s.ends / s.total) if s.ends else NO_END

    def likelihood(self, token: str, kinds: list[str]) -> float:
        """Base-2 log-likelihood of the characters; what no example did costs its floor, and a step without a state stays where it is."""
        at, total = 0, 0.0
        front, marks, steps, known = self.front, self.marks, self.steps, self.kinds
        for i, (c, kind) in enumerate(zip(token, kinds, strict=True)):
            symbol = "=" + c if (i < FRONT and (i, c) in front) or c in marks else "x"
            here = at
            bits, at = steps[at].get(symbol, (UNSEEN, at))
            total += bits
            if symbol == "x":
                total += known[here].get(kind, UNSEEN)
        return total + self.ends[at]


class Model:
    """The automata of all formats and the background, learnt from labelled tokens."""

    def __init__(self, rows: list[tuple[str, str]]):
        learnt = {k: Automaton([t for t, label in rows if label == k]) for k in dict.fromkeys(label for _, label in rows)}
        self.automata = {k: a for k, a in learnt.items() if k[0] != "-"}
        # and one that merges all ordinary shapes, for tokens like none of them
        self.ordinary = [a for k, a in learnt.items() if k[0] == "-"] + [Automaton([t for t, label in rows if label[0] == "-"], alpha=1e-300)]

    def score(self, token: str) -> tuple[float, str]:
        """The best format and its bits over the background, the likeliest ordinary shape."""
        kinds = classes(token)
        background = max(a.likelihood(token, kinds) for a in self.ordinary)
        return max((a.likelihood(token, kinds) - background, k) for k, a in self.automata.items())


@lru_cache(maxsize=2)
def default_model() -> Model:
    return Model(labelled())


def scan(text: str, model: Model, min_bits: float = MIN_BITS) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those that only the automata find."""
    base: list[Span] = []
    if ANY_WORD.search(text.lower()):
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    more = []
    for m in CANDIDATE.finditer(text):
        bits, kind = model.score(m[0])
        if bits >= min_bits:
            more.append((*m.span(), kind))
    return base, free(more, base)


def find_secrets(docs: DataFrame, model: Model | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """Per document row: ``doc_id``, counts and digest of the base spans, and all spans."""
    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(lambda it: scanned(it, lambda t: scan(t, shared.value, min_bits), BASE_KINDS, KINDS), schema)


def masked(text: str | None, model: Model, min_bits: float = MIN_BITS) -> str | None:
    """The text with ``<kind>`` in place of every secret; of an assignment only the value goes, overlapping spans go as one."""
    if not text:
        return text
    base, more = scan(text, model, min_bits)
    if not base and not more:
        return text
    spans = [(ASSIGN.match(text, a).start(2), b, k) if k == "assign" else (a, b, k) for a, b, k in base + more]
    out, done = [], 0
    for a, b, k in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{k}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, model: Model | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """All rows and columns, the secrets in ``text`` masked."""
    modest(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model or default_model()), docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t, shared.value, min_bits) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.toDF(*map(str, range(len(docs.columns)))).mapInArrow(mask, docs.schema)
