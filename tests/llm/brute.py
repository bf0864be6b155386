"""Plain restatements of what the queries of the package must return, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import groupby

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, span=13):
    """rows (doc_id, text), (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated"""
    windows = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lower(text or ""))
        if i is not None and w:
            for k in range(max(1, len(w) - span + 1)):
                windows[tuple(w[k : k + span])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def repetition(text, grams, line_bound):
    text = text or ""
    spans = [m.span() for m in BLANKS.finditer(text)]
    w = [text[a:b] for a, b in spans]
    chars = sum(map(len, w))

    def hit(n):
        seen = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {k + j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(n)}

    lines = [x for x in text.split("\n") if BLANKS.search(x)]
    seen, again = set(), []
    for x in lines:
        if x in seen:
            again.append(x)
        seen.add(x)
    repeat = len(hit(5))
    failed = len(w) < 10 or 100 * repeat > 20 * len(w)
    some = max(chars, 1)
    bad = any(sum(len(w[k]) for k in hit(n)) / some > bound for n, bound in grams.items())
    bad |= sum(len(x) for y in again for x in BLANKS.findall(y)) / some > line_bound
    return (len(w), chars, sum(c in "#*$%&|<>" for c in text), len(again), repeat, failed, not failed and not bad)


def near(docs, percent=75, width=5):
    """rows (doc_id, text) -> doc_id: (n_shingles, component_id, kept)"""
    sets = {}
    for d, text in docs:
        w = BLANKS.findall(lower(text or ""))
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    common = Counter()
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def repeats(docs, width=50):
    """rows (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256"""
    split = [(d, BLANKS.findall(text or "")) for d, text in docs]
    least = {}
    for d, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = {k + j for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < d for j in range(width)}
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def _join(kinds, found):
    order = {k: n for n, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda x: (x[0], order[x[2]])))


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        x = int(c) * (2 if n % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    """-> n_email, n_ip, n_card, n_phone, base_sha256"""
    text = text or ""
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((*m.span(), "phone"))
    kinds = ("email", "ip", "card", "phone")
    n = Counter(k for *_, k in found)
    return (*(n[k] for k in kinds), sha(_join(kinds, found)))


def secrets(text):
    """-> n_assign, n_access, n_hex, base_sha256"""
    text = text or ""
    word = "".join
    keys = "|".join(word(f"[{c}{c.upper()}]" for c in k) for k in ("password", "passwd", "secret", "token"))
    keys += "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [(*m.span(), "assign") for m in re.finditer(rf"({keys})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    n = Counter(k for *_, k in found)
    return (*(n[k] for k in kinds), sha(_join(kinds, found)))


def runs(x):
    return [(k, len(list(g))) for k, g in groupby(x)]
