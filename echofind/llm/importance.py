"""Quality classification by importance resampling.

Texts are bags of hashed n-grams: words and runs of marks, pairs of neighbours among them, and
the beginnings of longer words.  Two generative models count them, one over a target sample
and one over all raw text.  A document's importance weight is the log of the ratio of its two
likelihoods: the plain sum of the log ratios of its n-grams.  Documents are drawn without
replacement by Gumbel top-k: the k largest sums of log weight and standard Gumbel noise.

Both models are smoothed by ``SMOOTH`` expected counts, and the target model backs off to the
raw one in buckets whose counts give no evidence (``EVIDENCE`` standard deviations) that the
two differ: a sample holds few of the corpus's many rare n-grams, and without this back-off
their noise outweighs what the sample does say.

The raw model and all scores cover all documents; the labelled sample is bounded by
``SAMPLE``, in the order of a hash of the id.  Without a given ``k``, as large a share of the
documents is drawn as of all labelled ids is wanted (good quality and not toxic).  The k-th
largest key comes from histograms of the keys, refined until a bin is small.

Cases: a null or empty text has weight 0; a null id has its own fixed noise; labels of unknown
ids count in the share but add nothing to the target; an id that labels contradict is wanted
if any of its rows is; repeated rows give one result each and share their noise, and keys that
tie with the k-th are drawn too; without wanted labels all weights are 0, and without labels
every document is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import modest, stored

#: Buckets as a power of two, and bytes of word beginnings.
BITS, BEGINNINGS = 20, (5, 6, 7, 8)
#: Expected counts added to both models, and standard deviations that count as evidence of a difference.
SMOOTH, EVIDENCE = 2.0, 4.0
#: Labelled ids of the target sample.
SAMPLE = 20_000
SEED = 29
#: Keys of a histogram bin that the driver reads.
FEW = 4096
MARKS = K.byte_class(lambda b: b < 0x80 and b not in (0x20, *range(0x09, 0x0E)) and not K.ALNUM[b] and not 0x41 <= b <= 0x5A)


def grams(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of every n-gram: single tokens, pairs of neighbours, beginnings of words."""
    data = K.LOWER[texts.data]
    found, marks = K.words(texts, K.ALNUM, data), K.words(texts, MARKS, data)
    words, group = K.word_hashes(data, found), K.owner(found.first)
    order = np.argsort(np.concatenate([found.starts, marks.starts]), kind="stable")
    owner = np.concatenate([group, K.owner(marks.first)])[order]
    token = np.concatenate([words, K.word_hashes(data, marks)])[order]
    near = owner[1:] == owner[:-1]
    owners, hashes = [owner, owner[1:][near]], [token, K.joined_hash(token[:-1], token[1:])[near]]
    for n in BEGINNINGS:
        long = found.ends - found.starts > n
        owners.append(group[long])
        hashes.append(K.mix(K.byte_hash(data, found.starts[long], found.starts[long] + n) + np.uint64(99)))
    return np.concatenate(owners), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], target: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw, own = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        hit = np.isin(np.array(batch.column(0).to_pylist(), object).astype(str), target)
        for texts in K.chunks(batch.column(1)):
            owner, bucket = grams(texts)
            raw += np.bincount(bucket, minlength=len(raw))
            own += np.bincount(bucket[hit[texts.rows][owner]], minlength=len(own))
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(own[some])], ["bucket", "raw", "target"])


def _weights(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in K.chunks(batch.column(1)):
            n = len(texts.offsets) - 1
            owner, bucket = grams(texts)
            size, total = np.bincount(owner, minlength=n), np.bincount(owner, ratio[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.rows.start, n), pa.array(size), pa.array(total)], ["doc_id", "n_grams", "weight"])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of the smoothed target model to the smoothed raw one for each bucket; 0 where the target backs off."""
    if not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + SMOOTH) / (expected + SMOOTH))
    return np.where(np.abs(target - expected) > EVIDENCE * np.sqrt(expected + 1), ratio, 0.0)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column ``key``, by refining histograms."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return np.inf
    above = 0
    while True:
        here = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if low == high:
            return low
        step = (high - low) / 1024
        bins = here.groupBy(F.least(F.lit(1023), F.floor((F.col("key") - low) / step)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        row = None
        for row in sorted(bins.collect(), key=lambda r: -r.bin):
            if above + row.n >= k:
                break
            above += row.n
        else:  # fewer than k keys: all of them
            return keys.agg(F.min("key")).first()[0]
        low, high = row.low, row.high
        if row.n <= FEW:
            own = sorted((r.key for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)
            return own[k - above - 1]


def weighed(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document row: ``doc_id, n_grams, weight``, the log importance weight."""
    spark = docs.sparkSession
    modest(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = _wanted(labels).where("wanted").select("id").orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample)
    target = spark.sparkContext.broadcast(np.array(sorted(r.id for r in ids.collect()), dtype=str))
    texts = docs.select("doc_id", "text")
    counts = texts.mapInArrow(lambda it: _counts(it, target.value), "bucket long, raw long, target long")
    raw, own = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # a row per bucket
    raw[sums.column(0).to_numpy()], own[sums.column(0).to_numpy()] = sums.column(1).to_numpy(), sums.column(2).to_numpy()
    ratio = spark.sparkContext.broadcast(log_ratios(raw, own))
    return texts.mapInArrow(lambda it: _weights(it, ratio.value), f"doc_id {kind}, n_grams long, weight double")


def _wanted(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)).alias("w")).where("id is not null")
    return known.groupBy("id").agg(F.max("w").alias("wanted"))


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Per document row: ``doc_id, n_grams, weight, key, kept``; ``k`` documents are drawn."""
    scored = weighed(docs, labels, sample)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed + 1)), 11) + 0.5) / float(1 << 53)
    keyed = stored(scored.withColumn("key", F.col("weight") - F.log(-F.log(uniform))), "weights")
    if k is None:
        n = _wanted(labels).agg(F.count("*").alias("all"), F.count(F.when(F.col("wanted"), 1)).alias("wanted")).first()
        rows = keyed.count()
        k = (2 * rows * n.wanted + n.all) // (2 * n.all) if n.all else rows
    return keyed.withColumn("kept", F.col("key") >= kth_largest(keyed, k))
