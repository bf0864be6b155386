"""Readers of pair tables, snippets and corpora; every one is a lazy DataFrame."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_SCHEMA = "id1 string, id2 string, clone_type string, rare_token_ratio double, common_token_ratio double"
#: The sets of a clone catalogue and their file names.
CATALOGUE = {
    "type1": "type-1.csv",
    "type2": "type-2.csv",
    "type3": "type-3.csv",
    "type4": "type-4.csv",
    "type5": "type-5.csv",
    "nonclone": "nonclone.csv",
}
RENAMED = {"function_id_one": "id1", "function_id_two": "id2"}
NOT_FEATURES = ("label", "id1", "id2")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows holds ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def pairs_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """A pair table: without a header the clone columns, with one its own columns in lower case; ids are trimmed strings."""
    if header:
        df = spark.read.csv(path, header=True)
        names = [c.strip().lower() for c in df.columns]
        df = df.toDF(*(RENAMED.get(c, c) for c in names))
    else:
        df = spark.read.schema(PAIR_SCHEMA).csv(path)
    return df.withColumns({c: F.trim(F.col(c).cast("string")) for c in ("id1", "id2")})


def catalogue(spark: SparkSession, folder: str, files: Mapping[str, str] = CATALOGUE) -> tuple[DataFrame, list[str]]:
    """All sets of a folder with their name in ``clone_set``, and the names of missing ones."""
    found, missing = [], []
    for name, file in files.items():
        path = f"{folder}/{file}"
        if exists(spark, path):
            found.append(pairs_csv(spark, path, header=name == "nonclone").withColumn("clone_set", F.lit(name)))
        else:
            missing.append(name)
    if not found:
        return spark.createDataFrame([], PAIR_SCHEMA + ", clone_set string"), missing
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), missing


def snippets(spark: SparkSession, glob: str) -> DataFrame:
    """``id, text`` of files named by their id; invalid UTF-8 is replaced."""
    files = spark.read.format("binaryFile").load(glob)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.select(name.alias("id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def source_of(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the given ids; null where the corpus has none."""
    return ids.join(corpus, "id", "left")


def both_exist(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs with both ids in the corpus."""
    ids = corpus.select("id").distinct()
    for side in ("id1", "id2"):
        pairs = pairs.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return pairs


def tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def features_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A feature table and its feature columns: all but label and ids."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df, [c for c in df.columns if c not in NOT_FEATURES]


def prerequisites(spark: SparkSession, paths: Iterable[str], columns: Mapping[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    """What a run lacks: missing paths under '', and per Parquet path its missing columns."""
    found = {"": [p for p in paths if not exists(spark, p)]}
    for path, wanted in (columns or {}).items():
        if exists(spark, path):
            have = set(spark.read.parquet(path).columns)
            found[path] = [c for c in wanted if c not in have]
    return found


def fingerprint(df: DataFrame) -> str:
    """The number of rows and the sum of the hashes of all rows, in any order."""
    n = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*(f"`{c}`" for c in df.columns)).cast("decimal(38, 0)")).alias("sum")).first()
    return f"{n.rows}-{n.sum or 0}"


def cached(spark: SparkSession, path: str, build, params: Mapping[str, object] | None = None, columns: Iterable[str] = ()) -> DataFrame:
    """A table written once under ``path`` and a digest of ``params``, and anew if it lacks one of ``columns``.

    ``params`` should hold what the table was built with, the ``fingerprint`` of its input among it.
    """
    if params is not None:
        path = f"{path}/{hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS") or not set(columns) <= set(spark.read.parquet(path).columns):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
