"""Benchmark decontamination by winnowing.

Every text is a sequence of words; the fingerprints of a text are, in each run of ``window``
consecutive k-gram hashes, the rightmost smallest one.  A span of ``k + window - 1`` words
that a document shares with a benchmark item holds a run of the same k-gram hashes on both
sides, so both sides select the same k-gram in it: no shared span of that length is missed.

Documents and items are winnowed alike and their fingerprints joined.  Around every match in
a document the windows of ``span`` words that hold the matching k-gram are joined with the
windows of the items, on two independent 64-bit hashes of their words; those that match are
the hits, and overlapping ones extend to spans.  Items with fewer words have one window, of
their own length, which is its own fingerprint.  One pass reads all documents and a second
one those with a match, whatever the size of the benchmark; texts never shuffle unless more
than ``BROADCAST_ROWS`` of them match.

Cases: a null text has no words, a null or empty item no windows; items with a null id are
not items; rows of equal id and text count once as items and once each as documents; the
extra columns of both tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import spread
from .scratch import modest, stored

#: Words of a window of an item.
SPAN = 13
#: Words of a k-gram; with it goes a window of ``SPAN - GRAM + 1`` k-grams.
GRAM = 6
#: Rows of three numbers, at most, that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_SHORT = np.uint64(0x94D049BB133111EB)


def selected(grams: np.ndarray, run: int) -> np.ndarray:
    """Places of the rightmost minimum in every run of ``run`` consecutive hashes, a place for each run."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for step in range(1, run):
        other = grams[step : step + n]
        better = other <= best
        best[better] = other[better]
        at[better] = np.flatnonzero(better) + step
    return at


def _short_key(hashes: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of a whole item of ``width`` words, apart from those of k-grams."""
    return K.mix(hashes + _SHORT * np.uint64(width))


def _prints(hashes: np.ndarray, first: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the fingerprints of texts, in their order."""
    grams = K.window_hashes(hashes, gram)
    at = selected(grams, span - gram + 1)
    at = np.unique(at[K.window_starts(first, span)[: len(at)]])
    return at, grams[at]


def _read(column: pa.Array):
    for texts in K.chunks(column):
        data = K.LOWER[texts.data]
        found = K.words(texts, K.ALNUM, data)
        yield texts, data, found, K.word_hashes(data, found)


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The distinct values of each of ``n`` owners."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))


def _fingerprints(batches: Iterator[pa.RecordBatch], span: int, gram: int, shorts: dict[int, np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    """Columns u, t, doc_id, text: the fingerprints of every text, with those of ``shorts``, a sorted choice by width (null: all)."""
    for batch in batches:
        for texts, _, found, hashes in _read(batch.column(3)):
            n, group = len(found.first) - 1, K.owner(found.first)
            at, values = _prints(hashes, found.first, span, gram)
            owners, prints = [group[at]], [values]
            for width, some in shorts.items():
                at = np.flatnonzero(K.window_starts(found.first, width))
                values = _short_key(K.window_hashes(hashes, width)[at], width)
                if some is not None:
                    place = np.minimum(np.searchsorted(some, values), len(some) - 1)
                    at, values = at[some[place] == values], values[some[place] == values]
                owners.append(group[at])
                prints.append(values)
            part = batch.slice(texts.rows.start, n)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(found.first)), _lists(np.concatenate(owners), np.concatenate(prints), n)], ["u", "t", "doc_id", "n", "prints"])


def _items(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Columns item, text: width of its windows, fingerprints, and both hashes of its windows, for each item with words."""
    for batch in batches:
        for texts, data, found, hashes in _read(batch.column(1)):
            second = K.word_hashes(data, found, second=True)
            rows = []
            for k, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
                if a < b:
                    own, other, width = hashes[a:b], second[a:b], min(b - a, span)
                    h1, h2 = K.window_hashes(own, width), K.window_hashes(other, width, second=True)
                    prints = _prints(own, np.array([0, b - a]), span, gram)[1] if width == span else _short_key(h1, width)
                    rows.append((batch.column(0)[texts.rows.start + k].as_py(), width, *(np.unique(x, axis=-1) for x in (prints.view(np.int64), np.stack([h1, h2]).view(np.int64)))))
            names, widths, prints, windows = zip(*rows, strict=True) if rows else ((), (), (), ())
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(widths, pa.int32()), pa.array(list(prints), many), pa.array([w[0] for w in windows], many), pa.array([w[1] for w in windows], many)],
                ["item", "width", "prints", "h1", "h2"],
            )


def _windows(batches: Iterator[pa.RecordBatch], span: int, gram: int, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Columns u, t, text, prints (that an item has): the windows around those, one row for all places of a window in its text."""
    for batch in batches:
        for texts, data, found, hashes in _read(batch.column(2)):
            n, first, group = len(found.first) - 1, found.first, K.owner(found.first)
            own = batch.column(3).slice(texts.rows.start, n)
            wanted = own.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(n), own.value_lengths().to_numpy())
            pair = lambda text, value: K.joined_hash(text.astype(np.uint64), value)
            wanted = pair(of, wanted)
            at, values = _prints(hashes, first, span, gram)
            at = at[np.isin(pair(group[at], values), wanted)]
            near = np.unique((at[:, None] - np.arange(span - gram + 1)).ravel())
            inside = np.flatnonzero(K.window_starts(first, span))
            places = {span: near[np.isin(near, inside)]}
            for width in widths:
                at = np.flatnonzero(K.window_starts(first, width))
                values = _short_key(K.window_hashes(hashes, width)[at], width)
                places[width] = at[np.isin(pair(group[at], values), wanted)]
            second = K.word_hashes(data, found, second=True)
            part = batch.slice(texts.rows.start, n)
            for width, at in places.items():
                if not len(at):
                    continue
                h1, h2 = K.window_hashes(hashes, width)[at], K.window_hashes(second, width, second=True)[at]
                order = np.lexsort((h2, h1, group[at]))
                at, h1, h2 = at[order], h1[order], h2[order]
                text = group[at]
                new = np.ones(len(at), bool)
                new[1:] = (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                lead = np.flatnonzero(new)
                where = pa.ListArray.from_arrays(pa.array(np.append(lead, len(at)), pa.int32()), pa.array((at - first[text]).astype(np.int32)))
                rows = pa.array(text[lead])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.full(len(lead), width, np.int32)), pa.array(h1[lead].view(np.int64)), pa.array(h2[lead].view(np.int64)), where],
                    ["u", "t", "width", "h1", "h2", "at"],
                )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns u, t, found (lists of width and places): the word ranges that those cover, merged."""
    for batch in batches:
        out = []
        for found in batch.column(2):
            widths = found.values.field("width").to_numpy()
            at = found.values.field("at")
            starts = at.flatten().to_numpy().astype(np.int64)
            ends = starts + np.repeat(widths, at.value_lengths().to_numpy())
            order = np.argsort(starts, kind="stable")
            starts, reach = starts[order], np.maximum.accumulate(ends[order])
            new = np.append(True, starts[1:] > reach[:-1])
            out.append(np.stack([starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]], axis=1).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.int64())))], ["u", "t", "spans"])


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """Two numbers that name a document row by its id and its text."""
    return F.xxhash64(F.col("doc_id")).alias("u"), F.xxhash64(F.col("text")).alias("t")


def _join(big: DataFrame, small: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return big.join(F.broadcast(small), keys) if few else spread.joined(big, small, keys, F.xxhash64("u", "t"))


def _found(docs: DataFrame, benchmark: DataFrame, span: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``u, t, doc_id, n`` of all rows, and ``u, t, spans, items`` of those with a hit."""
    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("x")).where("i is not null and x is not null").distinct()
    items = stored(items.mapInArrow(lambda it: _items(it, span, gram), "item string, width int, prints array<long>, h1 array<long>, h2 array<long>"), "items")
    keys = stored(items.select("width", F.explode("prints").alias("print")).distinct(), "keys")
    windows = items.select("item", "width", F.explode(F.arrays_zip("h1", "h2")).alias("w")).select("item", "width", "w.h1", "w.h2").distinct()
    windows = stored(windows, "windows")
    short = keys.where(F.col("width") < span)
    widths = sorted(r.width for r in short.select("width").distinct().collect())  # fewer than ``span``
    shorts: dict[int, np.ndarray | None] = dict.fromkeys(widths)
    if short.count() <= most:
        own = short.toPandas()
        shorts = {w: np.sort(own.print[own.width == w].to_numpy(np.int64).view(np.uint64)) for w in widths}

    named = docs.select(*_keyed(docs), "doc_id", "text")
    read = stored(named.mapInArrow(lambda it: _fingerprints(it, span, gram, shorts), f"u long, t long, doc_id {kind}, n long, prints array<long>"), "prints")
    each = read.select("u", "t", F.explode("prints").alias("print"))
    hits = _join(each, keys.select("print").distinct(), ["print"], keys.count() <= most)
    hits = stored(hits.groupBy("u", "t").agg(F.collect_set("print").alias("prints")), "hits")
    few = hits.count() <= most
    near = named.select("u", "t", "text").join(F.broadcast(hits.select("u", "t")) if few else hits.select("u", "t"), ["u", "t"], "left_semi")
    near = near.join(hits, ["u", "t"]).select("u", "t", "text", "prints")
    around = stored(near.mapInArrow(lambda it: _windows(it, span, gram, widths), "u long, t long, width int, h1 long, h2 long, at array<int>"), "around")
    around = around.dropDuplicates(["u", "t", "width", "h1", "h2"])
    small = windows.count() <= most
    full = _join(around, windows.select("width", "h1", "h2").distinct(), ["width", "h1", "h2"], small)
    spans = full.groupBy("u", "t").agg(F.collect_list(F.struct("width", "at")).alias("found")).mapInArrow(_spans, "u long, t long, spans array<array<long>>")
    names = _join(around.select("u", "t", "width", "h1", "h2"), windows, ["width", "h1", "h2"], small).select("u", "t", "item").distinct()
    names = names.groupBy("u", "t").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return read.select("u", "t", "doc_id", "n"), stored(spans.join(names, ["u", "t"]), "hits")


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, most: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: ``doc_id, n_words, spans`` (word ranges that occur in an item, ends exclusive, merged), ``items`` (their ids)."""
    read, hits = _found(docs, benchmark, span, gram, most)
    out = read.join(F.broadcast(hits) if hits.count() <= most // 100 else hits, ["u", "t"], "left")
    return out.select("doc_id", F.col("n").alias("n_words"), F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def verdicts(found: DataFrame) -> DataFrame:
    """Counts, the digest of the item ids and the contamination rule, from the rows of ``overlaps``."""
    return found.select(
        *(c for c in ("doc_id", "u", "t") if c in found.columns),
        "n_words",
        _hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((_hit() > 0) & (20 * _hit() >= F.col("n_words"))).alias("contaminated"),
    )


def _hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, whole and unchanged, that the contamination rule leaves."""
    read, hits = _found(docs, benchmark, span, gram, most)
    sizes = read.join(F.broadcast(hits.select("u", "t")) if hits.count() <= most else hits.select("u", "t"), ["u", "t"], "left_semi").select("u", "t", F.col("n").alias("n_words")).distinct()
    gone = stored(verdicts(hits.join(sizes, ["u", "t"])).where("contaminated").select(F.col("u").alias("_u"), F.col("t").alias("_t")), "contaminated")
    u, t = _keyed(docs)
    same = (u == F.col("_u")) & (t == F.col("_t"))
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, same, "left_anti")
