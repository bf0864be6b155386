"""Near-duplicate documents by SetSketch registers.

The set of a document holds its distinct shingles of ``width`` words.  Of every set, each of
``REGISTERS`` registers keeps the minimum of an exponentially distributed hash, truncated to
exponentially spaced levels (``1 - log_b``), so registers merge by maximum and agree with a
probability close to the Jaccard similarity.  Bands of four registers are the join keys of
candidates; the joint likelihood of the larger, smaller and equal registers of a pair gives
an estimate; only pairs well below the bound are dropped by it, all others are confirmed on
their full sets.

Groups are linked without pairing their members with each other:

1. Equal sets fall together first, by a 128-bit content hash.
2. Every set is compared with the smallest set it shares a band with, then, in bands that
   still hold several components, with the hub: the member that meets the most others.
3. What is left in such bands is compared block by block, on registers held as matrices, and
   near pairs are confirmed in place; only links become rows.  No link is lost between what
   bands bring together.

At a similarity of 0.75, 40 bands of four registers miss a pair with a probability of 2.5e-7
and the estimate drops one of equal set sizes with 3.1e-8: 3e-7 together.

Cases: a null or empty text has an empty set, links to nothing and is kept; with fewer words
than ``width`` the whole sequence is the only shingle; a null id links to nothing, its
component is null and it is kept; rows of equal id are one document in links and give one
row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import spread
from .scratch import modest, stored

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: How far the estimate may lie below the bound for a pair to be verified: about six standard errors.
SLACK = 0.2
#: Sets of a block that is compared as a matrix.
BLOCK = 96
#: Ids up to this many (of 8 bytes) are sent to all tasks to pick texts; more are joined.
BROADCAST_IDS = 1_000_000
#: Rows of a written table of ids, labels or bands up to which it goes to all tasks; a larger one is joined by shuffles.
SENT = 200_000

_SEEDS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 32, (2, REGISTERS), np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: K.Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and their offsets."""
    data = K.LOWER[texts.data]
    found = K.words(texts, K.SPACED, data)
    hashes, first = K.word_hashes(data, found), found.first
    grams = K.window_hashes(hashes, width)
    whole = K.span_hash(hashes, first[:-1], first[1:])
    sets = []
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            sets.append(whole[t : t + (b > a)])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers of each non-empty set, a row each."""
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    starts = offsets[:-1]
    least = np.empty((REGISTERS, len(starts)), np.uint32)
    t, s = np.empty_like(x), np.empty_like(x)
    for i in range(REGISTERS):
        np.multiply(x, _SEEDS[0, i], out=t)
        np.right_shift(t, np.uint32(15), out=s)
        np.bitwise_xor(t, s, out=t)
        np.multiply(t, _SEEDS[1, i], out=t)
        np.minimum.reduceat(t, starts, out=least[i])
    level = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(level) / log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    return K.mix(packed ^ K.mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs from their registers and set sizes."""
    up, down, same = (a > b).sum(1), (a < b).sum(1), (a == b).sum(1)
    u, v = n / (n + m), m / (n + m)
    j = np.linspace(0, 1, 129)[None, :-1] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / log(BASE)
    q, r = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    like = up[:, None] * np.log(q + tiny) + down[:, None] * np.log(r + tiny) + same[:, None] * np.log(np.maximum(1 - q - r, tiny))
    return j[np.arange(len(j)), like.argmax(1)]


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in K.chunks(batch.column(1)):
            values, offsets = shingle_sets(texts, width)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            n = len(sizes)
            sums = np.zeros((2, n), np.uint64)
            regs = np.zeros((0, REGISTERS), np.uint16)
            if len(full):
                starts = offsets[full]
                sums[0, full] = np.add.reduceat(values, starts)
                sums[1, full] = np.add.reduceat(K.mix(values), starts)
                regs = registers(values, np.append(starts, len(values)))
            keys = band_keys(regs).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]), pa.int32()), pa.array(keys.ravel()))
            blob = np.concatenate([[0], np.cumsum((sizes > 0) * REGISTERS * 2)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(blob), pa.py_buffer(np.ascontiguousarray(regs))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.rows.start, n), pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums), bands, binary],
                ["id", "n", "f1", "f2", "bands", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in K.chunks(batch.column(1)):
            values, offsets = shingle_sets(texts, width)
            n = len(offsets) - 1
            blob = (offsets * 8).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(blob), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.rows.start, n), binary], ["id", "members"])


def _near(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[pa.RecordBatch]:
    """Columns a, b, n, m, r, s: pairs whose sizes allow the bound and whose estimate comes near it."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
        some = np.flatnonzero(np.minimum(n, m) >= bound * np.maximum(n, m) - 1e-9)
        keep = np.zeros(len(n), bool)
        for at in np.array_split(some, len(some) // 2048 + 1):
            if len(at):
                x, y = (np.frombuffer(b"".join(batch.column(i).take(pa.array(at)).to_pylist()), np.uint16).reshape(len(at), REGISTERS) for i in (4, 5))
                keep[at] = estimate(x, y, n[at], m[at]) >= bound - SLACK
        yield batch.select([0, 1]).filter(pa.array(keep))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = _intersection(x, y)
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sent(table: DataFrame) -> DataFrame:
    """A written table, marked to go to all tasks if its counted rows allow it."""
    return F.broadcast(table) if table.count() <= SENT else table


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): ``id`` and ``c``, the smallest id of its component.

    In each round every id takes the smallest id next to it, twice what that one took, and the
    edges are drawn anew between what their ends took: they shrink until none is left.  Rounds
    are written, so a lost executor costs one round at most.  Labels of up to ``SENT`` ids go to
    all tasks; beyond, joins read written tables of ids alone, so adaptive execution deals a hot
    id's rows over several tasks.
    """

    def drawn(a: str, b: str, rows: DataFrame) -> DataFrame:
        return stored(rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct(), "edges")

    left, label = drawn("a", "b", edges), None
    while label is None or left.limit(1).count():
        both = left.union(left.select("b", "a"))
        took = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c")).select("id", F.least("id", "c").alias("c")), "labels")
        sent = F.broadcast if took.count() <= SENT else lambda table: table
        for _ in range(2):
            next_ = sent(took.select(F.col("id").alias("c"), F.col("c").alias("d")))
            took = stored(took.join(next_, "c").select("id", F.col("d").alias("c")), "labels")
        ends = left.join(sent(took.select(F.col("id").alias("a"), F.col("c").alias("x"))), "a")
        ends = ends.join(sent(took.select(F.col("id").alias("b"), F.col("c").alias("y"))), "b")
        left = drawn("x", "y", ends)
        if label is None:
            label = took
        else:
            next_ = sent(took.select(F.col("id").alias("c"), F.col("c").alias("d")))
            label = stored(label.join(next_, "c", "left").select("id", F.coalesce("d", "c").alias("c")), "labels")
    return label


def _intersection(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _rest(left: DataFrame, regs: DataFrame, members: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) that join the different components in the open bands ``left``.

    Members of bands that touch form a cluster.  It is dealt into blocks, and the registers and
    sets of two blocks meet in one task, which estimates all their pairs as matrices and
    confirms near pairs, the nearest first, unless links found there join them already.  No row
    is made for a pair that is not a link.
    """
    bound = percent / 100
    # bands touch through the smallest members of an id's bands: edges between those alone
    least = stored(left.groupBy("id").agg(F.min("lo").alias("b"), F.min("c").alias("c")), "least")
    touch = components(left.select("id", F.col("lo").alias("a")).join(_sent(least.select("id", "b")), "id").select("a", "b").distinct())
    cluster = least.join(_sent(touch.select(F.col("id").alias("b"), F.col("c").alias("t"))), "b", "left")
    cluster = stored(cluster.select("id", "c", F.coalesce("t", "b").alias("cluster")), "clusters")
    sizes = stored(cluster.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cluster-sizes")
    placed = cluster.join(_sent(sizes), "cluster").select("id", "c", "cluster", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    rows = placed.join(regs, "id").join(members, "id").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "c", "n", "regs", "members")

    def compare(table: pa.Table) -> pa.Table:
        i, j, block = (table.column(k).to_numpy() for k in (1, 2, 3))
        ids, comp, n = table.column(4), table.column(5).to_pylist(), table.column(6).to_numpy().astype(float)
        label = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        comp = np.array([label[c] for c in comp])
        sketch = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(8)]
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (comp[x][:, None] != comp[y][None]) & (np.minimum(n[x][:, None], n[y][None]) >= bound * np.maximum(n[x][:, None], n[y][None]) - 1e-9)
        if i[0] == j[0]:
            near = np.triu(near, 1)
        p, q = (z[k] for z, k in zip((x, y), np.nonzero(near), strict=True))
        alike = (sketch[p] == sketch[q]).mean(axis=1) >= bound - SLACK
        p, q = p[alike], q[alike]
        found: list[tuple[int, int]] = []
        if len(p):
            close = estimate(sketch[p], sketch[q], n[p], n[q])
            order = np.argsort(-close, kind="stable")
            parent = list(range(len(label)))

            def root(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for k in order[close[order] >= bound - SLACK].tolist():
                a, b = root(comp[p[k]]), root(comp[q[k]])
                if a != b:
                    s, t = sets[p[k]], sets[q[k]]
                    common = _intersection(s, t)
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        parent[a] = b
                        found.append((p[k], q[k]))
        a, b = ([f[k] for f in found] for k in (0, 1))
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return stored(rows.groupBy("cluster", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}"), "links")


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document row: ``doc_id, n_shingles, component_id, kept``."""
    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", "text")
    bound = percent / 100
    sketched = stored(text.mapInArrow(lambda it: _sketches(it, width), f"id {kind}, n long, f1 long, f2 long, bands array<long>, regs binary"), "sketches")
    linkable = sketched.where("n > 0 and id is not null")
    content = ["f1", "f2", "n"]
    reps = linkable.groupBy(*content).agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    reps = stored(reps.where("rows > 1"), "copied")
    copies = linkable.select("id", *content)
    if reps.count() <= SENT:
        copies = copies.join(F.broadcast(reps.select(*content, "rep")), content)
    else:
        copies = spread.joined(copies, reps.select(*content, "rep"), content, F.col("id"), reps.select(*content, "rows"))
    copies = stored(copies.where("id != rep").select("id", *content, "rep").distinct(), "copies")
    few_copies = copies.count() <= BROADCAST_IDS

    def with_copies(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(ids) if few_copies else ids, ["id", *content], how)

    classes = with_copies(linkable, copies.select("id", *content), "left_anti").select("id", "n", "bands", "regs")

    bands = classes.select("id", F.explode("bands").alias("band"))
    ends = bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    ends = stored(ends, "ends")
    shared = stored(bands.join(_sent(ends), "band"), "bands")

    ids = stored(shared.select("id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    chosen = F.broadcast(ids) if few else ids
    members = text.select(F.col("doc_id").alias("id"), "text").join(chosen, "id", "left_semi")
    members = stored(members.mapInArrow(lambda it: _sets(it, width), f"id {kind}, members binary"), "sets")
    regs = stored(classes.select("id", "n", "regs").join(chosen, "id", "left_semi"), "registers")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b)."""
        x = regs.select(F.col("id").alias("a"), "n", F.col("regs").alias("r"))
        y = regs.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("regs").alias("s"))
        pairs = stored(pairs, "pairs")
        many = [pairs.groupBy(side).agg(F.count("*").alias("rows")) for side in ("a", "b")]
        near = spread.joined(spread.joined(pairs, x, ["a"], F.col("b"), many[0]), y, ["b"], F.col("a"), many[1]).select("a", "b", "n", "m", "r", "s")
        near = stored(near.mapInArrow(lambda it: _near(it, bound), f"a {kind}, b {kind}"), "pairs")
        many = [near.groupBy(side).agg(F.count("*").alias("rows")) for side in ("a", "b")]
        x = members.select(F.col("id").alias("a"), F.col("members").alias("x"))
        y = members.select(F.col("id").alias("b"), F.col("members").alias("y"))
        full = spread.joined(spread.joined(near, x, ["a"], F.col("b"), many[0]), y, ["b"], F.col("a"), many[1]).select("a", "b", "x", "y")
        return stored(full.mapInArrow(lambda it: _confirmed(it, percent), f"a {kind}, b {kind}"), "links")

    first = confirm(shared.groupBy(F.col("id").alias("a")).agg(F.min("lo").alias("b")).where("a != b"))
    label = components(first)

    def open_bands(label: DataFrame) -> DataFrame:
        """The members of bands that hold more than one component, with their component ``c``."""
        now = shared.join(_sent(label), "id", "left").select("band", "id", "lo", "hi", F.coalesce("c", "id").alias("c"))
        mixed = now.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least != most").select("band")
        return now.join(_sent(stored(mixed, "mixed")), "band")

    def wider(label: DataFrame, found: DataFrame) -> DataFrame:
        if not found.limit(1).count():
            return label
        return components(label.select(F.col("id").alias("a"), F.col("c").alias("b")).union(found))

    left = stored(open_bands(label), "open")
    if left.limit(1).count():
        # the hub of a band: its member that meets the most others over all bands
        here = stored(left.groupBy("band").agg(F.count("*").alias("rows")), "open-sizes")
        meets = left.select("band", "id").join(_sent(here), "band").groupBy("id").agg(F.sum("rows").alias("meets"))
        hubs = stored(left.select("band", "id").join(meets, "id").groupBy("band").agg(F.max(F.struct("meets", "id")).alias("hub")), "hubs")
        spokes = left.join(_sent(hubs), "band").select(F.col("id").alias("a"), F.col("hub.id").alias("b"), "c").distinct()
        spokes = spokes.join(_sent(label.select(F.col("id").alias("b"), F.col("c").alias("d"))), "b", "left").where("c != coalesce(d, b)")
        label = wider(label, confirm(spokes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        left = stored(open_bands(label), "open")
        if left.limit(1).count():
            label = wider(label, _rest(left, regs, members, percent, kind))

    own = with_copies(linkable.select("id", *content), copies, "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    placed = own.join(_sent(label.select(F.col("id").alias("rep"), "c")), "rep", "left")
    placed = placed.select("id", "n", F.coalesce("c", "rep").alias("c"))
    alone = sketched.where("n = 0 or id is null").select("id", "n", F.col("id").alias("c"))
    return placed.union(alone).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept")
    )


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows, whole and unchanged, of one document of each group (its smallest id) and of those without one.

    Rows that repeat the id of a kept document are that document and stay with it.
    """
    gone = linked(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
