"""The detection plan: rules, candidate filter, model, merge, evaluation, as one lazy DAG."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import clones, metrics, normalize, pair_features
from . import models


def digests(corpus: DataFrame, records: DataFrame) -> DataFrame:
    """``id, norm_md5, token_md5`` of snippets."""
    own = normalize.normalized(corpus).select("id", F.md5("norm_text").alias("norm_md5"))
    return own.join(records.select("id", F.md5(S.spelled(F.col("token_ids"))).alias("token_md5")), "id", "left")


def token_bands(records: DataFrame, hashes: int = 48, bands: int = 16, k: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Signatures and band keys of the token shingles of records."""
    from ..functions import hashing as H

    shingles = records.select("id", F.explode(F.array_distinct(H.packed_shingles(F.col("token_ids"), k))).alias("shingle"))
    signed = clones.signatures(shingles, hashes, seed)
    return signed, clones.band_keys(signed, hashes, bands)


def detected(pairs: DataFrame, corpus: DataFrame, model: Model, features: list[str], hashes: int = 48, bands: int = 16, k: int = 3, threshold: float = 0.30, similarity: float = 0.0, skip_lsh: bool = False, skip_rules: bool = False, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """``id1, id2, label, prediction``; features and the model see candidates only; without rules those are drawn from all pairs.

    ``keep`` may store the result of a step; it gets the step's name too.
    """
    records = keep("records", normalize.token_records(corpus))
    keys = pairs.select("id1", "id2").distinct()
    typed = keys.withColumn("clone_type", F.lit(0)) if skip_rules else clones.clone_types(keys, digests(corpus, records))
    typed = keep("rules", typed)
    open_ = typed.where("clone_type = 0").select("id1", "id2")
    if not skip_lsh:
        signed, keyed = token_bands(records, hashes, bands, k)
        open_ = clones.filtered(open_, keyed)
        if similarity > 0:
            open_ = clones.agreement(open_, signed, hashes).where(F.col("similarity") >= similarity).select("id1", "id2")
    open_ = keep("candidates", open_)
    table = pair_features.sanitized(pair_features.pair_features(open_, pair_features.describe(corpus, records)), features)
    hit = keep("model", models.scored(model, table, features).select("id1", "id2", (F.col("score") >= threshold).cast("int").alias("model")))
    return clones.merged_predictions(pairs, hit, typed)


def staged(pairs: DataFrame, corpus: DataFrame, model: Model, features: list[str], folder: str, **more) -> tuple[DataFrame, DataFrame]:
    """The predictions, and ``step, seconds, rows`` of all steps; each is written into ``folder``, so later ones read it and no snippet is parsed twice."""
    spark, steps = pairs.sparkSession, []

    def keep(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        steps.append((name, time.perf_counter() - began, out.count()))
        return out

    out = keep("predictions", detected(pairs, corpus, model, features, keep=keep, **more))
    steps.append(("total", sum(s for _, s, _ in steps), out.count()))
    return out, spark.createDataFrame(steps, "step string, seconds double, rows long")


def report(predictions: DataFrame) -> DataFrame:
    """Binary metrics of clones against the rest, with a flag for a very low recall."""
    cells = metrics.confusion(predictions, (F.col("label") > 0).cast("int"), (F.col("prediction") > 0).cast("int"))
    return metrics.classification(cells).withColumn("low_recall", F.col("recall") < 0.1)


def ablation(pairs: DataFrame, corpus: DataFrame, model: Model, features: list[str], **more) -> DataFrame:
    """Metrics of the plan as it is, without the candidate filter, and without the rules, each run for real."""
    runs = {
        "full": detected(pairs, corpus, model, features, **more),
        "no_lsh": detected(pairs, corpus, model, features, skip_lsh=True, **more),
        "no_rules": detected(pairs, corpus, model, features, skip_rules=True, **more),
    }
    parts = [report(df).select(F.lit(name).alias("config"), "*") for name, df in runs.items()]
    return parts[0].union(parts[1]).union(parts[2])
