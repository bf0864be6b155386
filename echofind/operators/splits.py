"""Deterministic samples, splits and folds.

The order within a stratum is that of a hash of the id.  Exact ranks come from counts of
stratum and hash prefix: only those counts meet in one window, and rows are ranked inside
their prefix, so a stratum with a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that deal a stratum into parts.
PREFIX = 3


def order_key(ids: list[str], seed: int = 42) -> Column:
    return F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in ids), F.lit(str(seed))))


def ranked(df: DataFrame, stratum: str, ids: list[str], seed: int = 42) -> DataFrame:
    """With ``rank`` (from 1) and ``size`` of the row's stratum."""
    keyed = df.withColumn("_key", order_key(ids, seed)).withColumn("_part", F.substring("_key", 1, PREFIX))
    counts = keyed.groupBy(stratum, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    bases = counts.select(stratum, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("size"))
    own = Window.partitionBy(stratum, "_part").orderBy("_key", *ids)
    out = keyed.join(bases, [stratum, "_part"]).withColumn("rank", F.col("_base") + F.row_number().over(own))
    return out.select(*df.columns, F.col("rank").cast("long").alias("rank"), F.col("size").cast("long").alias("size"))


def stratified_split(df: DataFrame, stratum: str, ids: list[str], test: float = 0.3, seed: int = 42) -> DataFrame:
    """With ``split``: exactly the rounded share of each stratum is test."""
    own = ranked(df, stratum, ids, seed)
    return own.select(*df.columns, F.when(F.col("rank") <= F.floor(F.col("size") * test + 0.5), "test").otherwise("train").alias("split"))


def balanced(df: DataFrame, label: str, ids: list[str], seed: int = 42) -> DataFrame:
    """As many rows of every label as the rarest has."""
    own = ranked(df, label, ids, seed)
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return own.join(F.broadcast(least)).where(F.col("rank") <= F.col("least")).select(*df.columns)


def folds(df: DataFrame, stratum: str, ids: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """With ``fold``: each stratum dealt over k folds."""
    own = ranked(df, stratum, ids, seed)
    return own.select(*df.columns, ((F.col("rank") - 1) % k).alias("fold"))


def quick(train: DataFrame, test: DataFrame, stratum: str, ids: list[str], n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Small tables for a trial run: ``n`` training rows of each stratum and ``5 n`` test rows."""
    small = ranked(test.withColumn("_all", F.lit(0)), "_all", ids, seed).where(F.col("rank") <= 5 * n)
    return subset(train, stratum, ids, n, seed), small.select(*test.columns)


def subset(df: DataFrame, stratum: str, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, without replacement."""
    return ranked(df, stratum, ids, seed).where(F.col("rank") <= n).select(*df.columns)


def existing(pairs: DataFrame, ids: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with both ids, and per group how many there were, are valid and went."""
    flagged = pairs
    for side in ("id1", "id2"):
        own = ids.select(F.col("id").alias(side), F.lit(1).alias(f"_{side}")).distinct()
        flagged = flagged.join(own, side, "left")
    good = F.col("_id1").isNotNull() & F.col("_id2").isNotNull()
    stats = flagged.groupBy(group).agg(F.count("*").alias("original"), F.count(F.when(good, 1)).alias("valid"), F.count(F.when(~good, 1)).alias("removed"))
    return flagged.where(good).select(*pairs.columns), stats


def with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of pairs with their labels: as they are if they have one, else joined by both ids; pairs without a label go."""
    return features if "label" in features.columns else features.join(labels.select("id1", "id2", "label"), ["id1", "id2"])


def test_label(clone_set: Column) -> Column:
    """Labels of evaluation: the rule types 1 and 2, 3 for modified copies, 0 for others, -1 for unknown sets."""
    return F.when(clone_set == "type1", 1).when(clone_set == "type2", 2).when(clone_set.isin("type3", "type4"), 3).when(clone_set.isin("type5", "nonclone"), 0).otherwise(-1)


def training_label(clone_set: Column) -> Column:
    """Labels of training: 1 for modified copies, 0 for others, -1 for sets that take no part."""
    return F.when(clone_set.isin("type3", "type4"), 1).when(clone_set.isin("type5", "nonclone"), 0).otherwise(-1)


def datasets(valid: DataFrame, ids: list[str], test: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Balanced binary training pairs and multi-class test pairs of a catalogue with ``clone_set``."""
    labelled = valid.withColumn("label", test_label(F.col("clone_set")))
    split = stratified_split(labelled.where(F.col("label").isin(0, 3)), "label", ids, test, seed)
    train = split.where("split = 'train'").drop("split").withColumn("label", (F.col("label") == 3).cast("int"))
    rest = [split.where("split = 'test'").drop("split"), labelled.where(F.col("label").isin(1, 2))]
    return balanced(train, "label", ids, seed), reduce(DataFrame.unionByName, rest)
