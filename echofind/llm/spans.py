"""Spans of a text and their digest form, shared by the scanners."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa

from . import kernel as K

#: start, end (exclusive), kind; in code points.
Span = tuple[int, int, str]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    order = {k: n for n, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def free(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``spans`` that share no character with a base span or an earlier one of their own."""
    taken: list[list[int]] = []
    for a, b, _ in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    out: list[Span] = []
    for a, b, k in sorted(spans):
        near = bisect_left(starts, b) - 1
        if (near < 0 or taken[near][1] <= a) and (not out or out[-1][1] <= a):
            out.append((a, b, k))
    return out


def scanned(batches: Iterator[pa.RecordBatch], scan: Callable[[str], tuple[list[Span], list[Span]]], base_kinds: tuple[str, ...], kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Columns id, text -> id, counts of the base kinds, digest of the base spans, all spans."""
    memo: dict[tuple, str] = {(): digest("")}
    for batch in batches:
        for texts in K.chunks(batch.column(1)):
            n = texts.rows.stop - texts.rows.start
            counts: list[list[int]] = [[] for _ in base_kinds]
            sums, spans = [], []
            for text in batch.column(1).slice(texts.rows.start, n).to_pylist():
                base, more = scan(text or "")
                for column, kind in zip(counts, base_kinds, strict=True):
                    column.append(sum(k == kind for *_, k in base) if base else 0)
                sums.append(digest(joined(base, kinds)) if base else memo[()])
                spans.append(joined(base + more, kinds) if base or more else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.rows.start, n), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())],
                [batch.schema.names[0], *(f"n_{k}" for k in base_kinds), "base_sha256", "spans"],
            )
