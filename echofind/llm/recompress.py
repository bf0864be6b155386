"""Removal of long word sequences repeated across documents, by recompression.

A text is a sequence of names, at first of its words.  A step of recompression renames it:
maximal runs of one name become a name for the run and its length; then, as every name falls
on a left or a right side, every left name followed by a right one becomes a name for the pair.
A name is a 64-bit hash of what it stands for, so equal content has one name in all tasks.
With every name goes the range of words that it depends on: the words it stands for and the
neighbours that kept it from joining.  Wherever those words stand, they bear this name.

The steps come in rounds over the whole corpus.  A round names the runs and pairs of all texts
that are still open, then groups the names globally: one that a single text holds shows that
no window of ``WIDTH`` words around the range it depends on stands in another text.  Texts
without an open window are done; the others go to the next round, where names stand for longer
sequences.  The names that texts share in the end reveal the repeats, and the windows that
they leave open are verified on two independent 64-bit hashes of their words, grouped over all
documents with the smallest document of each.  No window is ruled out but by a proof, so none
is missed, whatever the rounds.

Documents of equal word sequences, by SHA-256, are represented by the smallest id throughout.

Cases: a null or empty text has no words; texts of fewer words than a window keep all; a null
id neither removes nor loses words; rows of equal id are one document: none removes words of
the other, each is judged by its own text; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import spread
from .scratch import modest, stored

#: Words of a window.
WIDTH = 50
#: Pair namings of each round; a round begins with the naming of runs.
ROUNDS = (5, 3)
#: Ids up to this many are sent to all tasks to pick texts; more are joined.
BROADCAST_IDS = 1_000_000
_RUN = np.uint64(0x2545F4914F6CDD1D)


class Sequences(NamedTuple):
    """Names of a batch of texts, the words each depends on (``lo`` to ``hi``, counted over the batch), the first name and word of each text."""

    names: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    words: np.ndarray


def _edges(s: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last names of the texts that have any, and places just outside those texts, which no window holds."""
    some = np.flatnonzero(np.diff(s.first))
    return s.first[some], s.first[some + 1] - 1, s.words[some] - 1, s.words[some + 1] + 1


def name_runs(s: Sequences) -> Sequences:
    """Maximal runs become one name; every name depends on its neighbours, which end the run."""
    n = len(s.names)
    starts, ends, before, after = _edges(s)
    head = np.ones(n, bool)
    head[1:] = s.names[1:] != s.names[:-1]
    head[starts] = True
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, n))
    names = s.names[at]
    long = count > 1
    names[long] = K.mix(K.joined_hash(names[long], count[long].astype(np.uint64)) + _RUN)
    place = np.concatenate([[0], np.cumsum(head)])
    lo, hi = s.lo[at - 1] if n else s.lo, s.hi[np.minimum(at + count, n - 1)] if n else s.hi
    lo[place[starts]], hi[place[ends + 1] - 1] = before, after
    return Sequences(names, lo, hi, place[s.first], s.words)


def name_pairs(s: Sequences, step: int) -> Sequences:
    """Left names before right ones become names of pairs; another left name depends on its successor, another right one on its predecessor."""
    n = len(s.names)
    starts, ends, before, after = _edges(s)
    left = (K.mix(s.names + np.uint64(step + 1)) & np.uint64(1)).astype(bool)
    joins = np.zeros(n, bool)
    joins[:-1] = left[:-1] & ~left[1:]
    joins[ends] = False
    lo, hi = np.roll(s.lo, 1), np.roll(s.hi, -1)
    lo[starts], hi[ends] = before, after
    lo, hi = np.where(left, s.lo, lo), np.where(left, hi, s.hi)
    at = np.flatnonzero(joins)
    names = s.names.copy()
    names[at] = K.joined_hash(s.names[at], s.names[at + 1])
    hi[at] = s.hi[at + 1]
    keep = np.ones(n, bool)
    keep[at + 1] = False
    return Sequences(names[keep], lo[keep], hi[keep], np.concatenate([[0], np.cumsum(keep)])[s.first], s.words)


def renamed(s: Sequences, number: int) -> Sequences:
    """The names of one round."""
    s = name_runs(s)
    for step in range(ROUNDS[number]):
        s = name_pairs(s, sum(ROUNDS[:number]) + step)
    return s


def _parts(column: pa.Array):
    for texts in K.chunks(column):
        found = K.words(texts, K.SPACED)
        yield texts, found, K.word_hashes(texts.data, found)


def _signs(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.array(K.span_hash(hashes, first[:-1], first[1:]).view(np.int64))


def _lists(first: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values).cast(kind))


def _sequence_columns(s: Sequences) -> list[pa.Array]:
    base = np.repeat(s.words[:-1], np.diff(s.first))
    return [_lists(s.first, s.names, pa.int64()), _lists(s.first, s.lo - base, pa.int32()), _lists(s.first, s.hi - base, pa.int32())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text: words, signs, digests of all texts, and the first round's names of those that hold a window."""
    for batch in batches:
        for texts, found, hashes in _parts(batch.column(1)):
            n, first = len(found.first) - 1, found.first
            raw, o = texts.data.tobytes(), texts.offsets.tolist()
            whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(o[:-1], o[1:], strict=True)]
            long = np.diff(first) >= WIDTH
            some = np.flatnonzero(np.repeat(long, np.diff(first)))
            words = np.concatenate([[0], np.cumsum(np.diff(first) * long)])
            places = np.arange(len(some))
            s = renamed(Sequences(hashes[some], places, places + 1, words, words), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.rows.start, n), pa.array(np.diff(first)), _signs(hashes, first), pa.array(whole), *_sequence_columns(s)],
                ["id", "n", "f1", "whole", "names", "lo", "hi"],
            )


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy(zero_copy_only=False)


def _opened(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """Columns id, f1, n, names, lo, hi, open, shared: texts with windows that no name rules out, renamed for the round ``number``.

    ``open`` holds the starts and ends of ranges of window starts; null means all.  ``live`` are
    the new names that bear on open windows; past the last round there are none.
    """
    for batch in batches:
        size = batch.column(2).to_numpy().astype(np.int64)
        first, names = _flat(batch.column(3))
        names = names.astype(np.int64).view(np.uint64)
        lo, hi = (_flat(batch.column(k))[1].astype(np.int64) for k in (4, 5))
        spans, ranges = _flat(batch.column(6))
        mine, shared = _flat(batch.column(7))
        owner = np.repeat(np.arange(len(size)), np.diff(first))
        key = lambda text, name: K.joined_hash(text.astype(np.uint64), name)
        known = np.isin(key(owner, names), key(np.repeat(np.arange(len(size)), np.diff(mine)), shared.astype(np.int64).view(np.uint64)))

        windows = size - WIDTH + 1  # of texts of this table there is one at least
        at = np.concatenate([[0], np.cumsum(windows)])
        a, b = np.maximum(hi - WIDTH, 0), np.minimum(lo + 1, windows[owner])
        held = a < b
        a, b = a + at[owner], b + at[owner]
        out = held & ~known
        closed = np.cumsum(np.bincount(a[out], minlength=at[-1] + 1) - np.bincount(b[out], minlength=at[-1] + 1))[:-1] > 0
        if batch.column(6).null_count < len(size):
            base = np.repeat(at[:-1], np.diff(spans))
            edge = np.bincount((ranges + base)[0::2], minlength=at[-1] + 1) - np.bincount((ranges + base)[1::2], minlength=at[-1] + 1)
            was = np.cumsum(edge)[:-1] > 0
            closed |= ~was & np.repeat(np.diff(spans) > 0, windows)
        is_open = ~closed
        sums = np.concatenate([[0], np.cumsum(is_open)])
        keep = np.flatnonzero(sums[at[1:]] > sums[at[:-1]])
        if not len(keep):
            continue
        # ranges of open windows of each text
        border = np.zeros(at[-1] + 1, bool)
        border[at] = True
        flag = np.concatenate([[False], is_open, [False]])
        begins = np.flatnonzero(is_open & (~flag[:-2] | border[:-1]))
        stops = np.flatnonzero(is_open & (~flag[2:] | border[1:])) + 1
        text = np.searchsorted(at, begins, "right") - 1
        pairs = np.stack([begins - at[text], stops - at[text]], axis=1).ravel().astype(np.int32)
        opened = _lists(2 * np.searchsorted(text, np.append(keep, len(size))), pairs, pa.int32())
        columns = [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(size[keep])]
        fields = ["id", "f1", "n"]
        if number < len(ROUNDS):
            words = np.concatenate([[0], np.cumsum(size[keep])])
            some = np.isin(owner, keep)
            moved = np.zeros(len(size), np.int64)
            moved[keep] = words[:-1]
            base = moved[owner[some]]
            s = Sequences(names[some], lo[some] + base, hi[some] + base, np.concatenate([[0], np.cumsum(np.diff(first)[keep])]), words)
            s = renamed(s, number)
            own = np.repeat(keep, np.diff(s.first))
            base = np.repeat(words[:-1], np.diff(s.first))
            a, b = np.maximum(s.hi - base - WIDTH, 0), np.minimum(s.lo - base + 1, windows[own])
            live = a < b
            live[live] = sums[(b + at[own])[live]] > sums[(a + at[own])[live]]
            columns += [*_sequence_columns(s), _lists(np.concatenate([[0], np.cumsum(live)])[s.first], s.names[live], pa.int64())]
            fields += ["names", "lo", "hi", "live"]
        yield pa.RecordBatch.from_arrays([*columns, opened], [*fields, "open"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text, runs (of f1 and open ranges of the text of that sign): the open windows, one row for all places of a window in its text."""
    for batch in batches:
        for texts, found, hashes in _parts(batch.column(1)):
            n, first, total = len(found.first) - 1, found.first, len(hashes)
            f1 = _signs(hashes, first)
            begin, end = [], []
            for t, (sign, runs) in enumerate(zip(f1.to_pylist(), batch.column(2).slice(texts.rows.start, n), strict=True)):
                for run in runs.values:  # texts that share an id are told apart by their content
                    if run["f1"].as_py() == sign:
                        own = run["open"].values.to_numpy().astype(np.int64) + first[t]
                        begin.append(own[0::2])
                        end.append(own[1::2])
            if not begin:
                continue
            begin, end = np.concatenate(begin), np.concatenate(end)
            ok = np.flatnonzero(np.cumsum(np.bincount(begin, minlength=total + 1) - np.bincount(end, minlength=total + 1)) > 0)
            h1 = K.window_hashes(hashes, WIDTH)
            h2 = K.window_hashes(K.word_hashes(texts.data, found, second=True), WIDTH, second=True)
            group = np.searchsorted(first, ok, "right") - 1
            # a window that a text repeats is one row, with all its places
            order = np.lexsort((h2[ok], h1[ok], group))
            ok, group = ok[order], group[order]
            new = np.ones(len(ok), bool)
            new[1:] = (group[1:] != group[:-1]) | (h1[ok[1:]] != h1[ok[:-1]]) | (h2[ok[1:]] != h2[ok[:-1]])
            lead = np.flatnonzero(new)
            at = _lists(np.append(lead, len(ok)), (ok - first[group]).astype(np.int32), pa.int32())
            ok, group = ok[lead], pa.array(group[lead])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.rows.start, n).take(group), f1.take(group), at, pa.array(h1[ok].view(np.int64)), pa.array(h2[ok].view(np.int64))],
                ["id", "f1", "at", "h1", "h2"],
            )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text, runs (of f1 and the windows to remove from the text of that sign): what stays of each text."""
    for batch in batches:
        for texts, found, hashes in _parts(batch.column(1)):
            n = len(found.first) - 1
            f1 = _signs(hashes, found.first)
            raw, o = texts.data.tobytes(), texts.offsets.tolist()
            removed, sums, rows = [], [], []
            for t, (sign, runs) in enumerate(zip(f1.to_pylist(), batch.column(2).slice(texts.rows.start, n), strict=True)):
                for run in runs.values:
                    if run["f1"].as_py() == sign:
                        words = raw[o[t] : o[t + 1]].split()
                        gone = K.covered(run["starts"].values.to_numpy().astype(np.int64), WIDTH, len(words))
                        rows.append(t)
                        removed.append(int(gone.sum()))
                        sums.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.rows.start, n).take(rows), f1.take(rows), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], ["id", "f1", "removed", "rest"])


def _texts(texts: DataFrame, rows: DataFrame, few: bool, column: str) -> DataFrame:
    """``id, text, runs``: the texts of the ids of ``rows`` (id, f1 and ``column``), with all those rows of the id."""
    runs = rows.groupBy("id").agg(F.collect_list(F.struct("f1", column)).alias("runs"))
    ids = rows.select("id").distinct()
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").join(runs, "id").select("id", "text", "runs")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words, joined by spaces)."""
    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    sequence = "names array<long>, lo array<int>, hi array<int>"
    read = stored(texts.mapInArrow(_read, f"id {kind}, n long, f1 long, whole string, {sequence}"), "sequences")
    long = read.where(f"id is not null and n >= {WIDTH}")
    least = stored(long.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "copied")
    copies = spread.joined(long.select("id", "f1", "whole"), least.select("whole", "rep"), ["whole"], F.col("id"), least.select("whole", "rows"))
    copies = stored(copies.where("id != rep").select("id", "f1").distinct(), "copies")
    few_copies = copies.count() <= BROADCAST_IDS
    left = long.join(F.broadcast(copies) if few_copies else copies, ["id", "f1"], "left_anti")
    left = left.select("id", "f1", "n", "names", "lo", "hi", F.lit(None).cast("array<int>").alias("open"), F.col("names").alias("live"))

    for number in range(1, len(ROUNDS) + 1):
        each = left.select("id", "f1", F.explode(F.array_distinct("live")).alias("name"))
        names = each.groupBy("name").agg(F.min("f1").alias("low"), F.max("f1").alias("high"), F.count("*").alias("rows"))
        shared = stored(names.where("low != high").select("name", "rows"), "names")
        mine = spread.joined(each, shared.select("name"), ["name"], F.col("id"), shared)
        mine = mine.groupBy("id", "f1").agg(F.collect_set("name").alias("shared"))  # a text without shared names may still have windows that no name bears on
        after = left.select("id", "f1", "n", "names", "lo", "hi", "open").join(mine, ["id", "f1"], "left").select("id", "f1", "n", "names", "lo", "hi", "open", "shared")
        more = f"{sequence}, live array<long>, " if number < len(ROUNDS) else ""
        left = stored(after.mapInArrow(lambda it, k=number: _opened(it, k), f"id {kind}, f1 long, n long, {more}open array<int>"), "sequences")

    few = left.count() <= BROADCAST_IDS
    windows = _texts(texts, left.select("id", "f1", "open"), few, "open").mapInArrow(_windows, f"id {kind}, f1 long, at array<int>, h1 long, h2 long")
    windows = stored(windows, "windows")
    owners = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("rows"))
    owners = stored(owners.where("least < most").select("h1", "h2", "least", "rows"), "owners")
    later = spread.joined(windows, owners.select("h1", "h2", "least"), ["h1", "h2"], F.col("id"), owners.select("h1", "h2", "rows")).where("least < id")
    starts = stored(later.groupBy("id", "f1").agg(F.flatten(F.collect_list("at")).alias("starts")), "starts")

    few = starts.count() <= BROADCAST_IDS
    rest = _texts(texts, starts, few, "starts").mapInArrow(_kept, f"id {kind}, f1 long, removed long, rest string")
    rest = rest.groupBy("id", "f1").agg(F.min("removed").alias("removed"), F.min("rest").alias("rest"))
    gone = copies.select("id", "f1", F.lit(True).alias("copy"))
    out = read.select("id", "n", "f1", "whole").join(rest, ["id", "f1"], "left")
    out = out.join(F.broadcast(gone) if few_copies else gone, ["id", "f1"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )
