"""Packing of token sequences by non-negative least squares.

Documents are encoded once and cut into full windows and a remainder.  The histogram of piece
lengths, at most one row per length, is all the driver sees.  There, shallow combinations of
lengths that fill a window exactly are enumerated, repeat counts of the combinations are fit
to the histogram by non-negative least squares and rounded, and what is left is packed
greedily: the longest lengths first, repeated as often as they last, and a tail that runs on
from window to window and is cut at their borders.  So all windows but the last are full.

A piece finds its place from its rank among the pieces of its length: ranks within a task,
plus the counts of the tasks before, which are summed per length and task, never per row.

Cases: a null text counts as empty; every document ends with ``END``, so an empty one is one
token; a null id is passed on; repeated rows are packed each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import modest, stored

WINDOW, END = 2048, 1
#: The most frequent lengths that combinations of three and of four lengths draw from.
FREQUENT = {3: 48, 4: 16}
SWEEPS = 40


class Fit(NamedTuple):
    """Where the pieces of each length go: rows of ``ranges`` are length, first rank, end rank, first sequence,
    pieces per sequence (0: the tail), offset of the first (in the tail: its place there)."""

    ranges: np.ndarray
    sequences: int


def combinations(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Combinations of up to four lengths with pieces that fill the window exactly."""
    has = histogram > 0
    out = [(window,)] if has[window] else []
    out += [(a, window - a) for a in range(1, window // 2 + 1) if has[a] and has[window - a]]
    common = np.argsort(-histogram[:window], kind="stable")
    for depth, most in FREQUENT.items():
        some = [int(x) for x in common[:most] if has[x] and x]
        for chosen in combinations_with_replacement(sorted(some), depth - 1):
            rest = window - sum(chosen)
            if rest > 0 and has[rest]:
                out.append(tuple(sorted((*chosen, rest))))
    return list(dict.fromkeys(out))


def solve(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent: repeats x with sum of columns * x near the histogram."""
    parts = [np.unique(c, return_counts=True) for c in columns]
    rest, x = histogram.astype(float), np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, times) in enumerate(parts):
            step = max(-x[j], float(times @ rest[rows]) / float(times @ times))
            if step:
                x[j] += step
                rest[rows] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def fit(histogram: np.ndarray, window: int = WINDOW) -> Fit:
    """Place all pieces of a histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    ranges, sequence = [], 0

    def place(chosen: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, n in zip(*np.unique(chosen, return_counts=True), strict=True):
            length, n = int(length), int(n)
            ranges.append((length, used[length], used[length] + n * times, sequence, n, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequence += times

    columns = combinations(left, window)
    repeats = solve(columns, left)
    for j in np.argsort(-repeats, kind="stable"):
        lengths, n = np.unique(columns[j], return_counts=True)
        times = min(int(repeats[j] + 0.5), int((left[lengths] // n).min()))
        if times > 0:
            place(columns[j], times)
    # greedy: the longest length, then always the longest that still fits; kept where it fills the window
    for top in range(window, 0, -1):
        while left[top]:
            chosen, room, free = [top], window - top, left.copy()
            free[top] -= 1
            while room:
                fits = np.flatnonzero(free[1 : room + 1])
                if not len(fits):
                    break
                length = int(fits[-1]) + 1
                n = min(room // length, int(free[length]))
                chosen += [length] * n
                free[length] -= n
                room -= n * length
            if room:
                break
            lengths, n = np.unique(chosen, return_counts=True)
            place(tuple(chosen), int((left[lengths] // n).min()))
    at = 0
    for length in range(window, 0, -1):
        if left[length]:
            ranges.append((length, used[length], used[length] + left[length], sequence, 0, at))
            at += int(left[length]) * length
    table = np.array(ranges, np.int64).reshape(-1, 6)
    return Fit(table[np.lexsort((table[:, 1], table[:, 0]))], sequence + -(-at // window))


class Vocabulary(NamedTuple):
    """Files of one byte-level BPE vocabulary.

    ``tokenizer`` is the tokenizer that defines the ids.  ``ranks`` and ``pattern``, if given,
    are its merge ranks and the rule that cuts words, for a faster encoder of plain texts.
    """

    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None


class Encoder:
    """Token ids of texts.

    The faster encoder takes texts of Latin letters, ASCII and single kinds of blanks, for which
    the letter and blank classes of both libraries agree, and without special tokens.
    """

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = None
        if vocabulary.ranks:
            import tiktoken

            with open(vocabulary.ranks, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("plain", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("[^\t\n -~\u00a1-\u00ac\u00ae-\u024f]").search

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text, ``END`` after them."""
        if self.plain and not self.odd(text) and not any(s in text for s in self.special):
            ids = self.plain.encode_to_numpy(text, disallowed_special=())
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.append(np.asarray(ids, np.uint16), np.uint16(END))


_ENCODERS: dict[Vocabulary, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, window: int) -> Iterator[pa.RecordBatch]:
    encode, part = encoder(vocabulary), TaskContext.get().partitionId()
    seen, full = np.zeros(window + 1, np.int64), 0
    for batch in batches:
        for texts in K.chunks(batch.column(1)):
            n = len(texts.offsets) - 1
            column = batch.column(1).slice(texts.rows.start, n)
            ids = [encode(t or "") for t in column.to_pylist()]
            sizes = np.array([len(i) for i in ids], np.int64)
            ranks, fulls = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k, size in enumerate(sizes.tolist()):
                ranks[k], fulls[k] = seen[size % window], full
                seen[size % window] += 1
                full += size // window
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.rows.start, n), pa.array(np.full(n, part, np.int32)), pa.array(sizes), pa.array((sizes % window).astype(np.int32)), pa.array(ranks), pa.array(fulls), pa.array([i.tobytes() for i in ids], pa.binary())],
                ["doc_id", "part", "tokens", "rest", "rest_rank", "full_rank", "ids"],
            )


def _placed(batches: Iterator[pa.RecordBatch], plan: Fit, window: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, tokens, rest, rest_rank, full_rank, ids, with ranks over all tasks: the pieces."""
    ranges = plan.ranges
    first = np.searchsorted(ranges[:, 0], np.arange(window + 2))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def spot(length: int, rank: int):
        rows = ranges[first[length] : first[length + 1]]
        _, low, _, sequence, times, offset = rows[int(np.searchsorted(rows[:, 1], rank, "right")) - 1].tolist()
        k = rank - low
        if times:
            return [(0, length, sequence + k // times, offset + k % times * length)]
        at, out = offset + k * length, []
        done = 0
        while done < length:
            n = min(length - done, window - (at + done) % window)
            out.append((done, n, sequence + (at + done) // window, (at + done) % window))
            done += n
        return out

    for batch in batches:
        tokens, rests, rest_ranks, full_ranks = (batch.column(i).to_pylist() for i in range(1, 5))
        rows, cols = [], [[] for _ in range(6)]
        for k, (n, rest, rest_rank, full_rank, ids) in enumerate(zip(tokens, rests, rest_ranks, full_ranks, batch.column(5), strict=True)):
            ids = np.frombuffer(ids.as_buffer(), np.uint16)
            pieces = [(j * window + a, b, c, d) for j in range(n // window) for a, b, c, d in spot(window, full_rank + j)]
            if rest:
                pieces += [(n - rest + a, b, c, d) for a, b, c, d in spot(rest, rest_rank)]
            for start, length, sequence, offset in pieces:
                rows.append(k)
                for col, v in zip(cols, (start, length, ids[start : start + length].astype("<u4").tobytes(), n, sequence, offset), strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)


def packed(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``."""
    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, part int, tokens long, rest int, rest_rank long, full_rank long, ids binary"
    read = stored(docs.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, vocabulary, window), schema), "tokens")
    each = read.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("tokens") / window)).alias("full"))
    each = stored(each, "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for row in each.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():
        histogram[row.rest] += row.n
        histogram[window] += row.full
    histogram[0] = 0
    plan = read.sparkSession.sparkContext.broadcast(fit(histogram, window))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rests = each.select("part", "rest", F.coalesce(F.sum("n").over(before.partitionBy("rest")), F.lit(0)).alias("rest_base"))
    fulls = each.groupBy("part").agg(F.sum("full").alias("full"))  # a row per task
    fulls = fulls.select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_base"))
    bases = rests.join(fulls, "part")
    ranked = read.join(bases, ["part", "rest"]).select(
        "doc_id", "tokens", "rest", (F.col("rest_rank") + F.col("rest_base")).alias("rest_rank"), (F.col("full_rank") + F.col("full_base")).alias("full_rank"), "ids"
    )
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(lambda it: _placed(it, plan.value, window), schema)


def checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
