"""Joins whose hot keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more than this part of all rows, and more than ``LEAST`` rows, is dealt over several tasks.
PARTS, LEAST = 2000, 200


def joined(big: DataFrame, small: DataFrame, keys: list[str], by: Column, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` by ``keys``; rows of ``big`` under a hot key are dealt by ``by``, its rows of ``small`` repeated.

    ``sizes`` has the keys and ``rows``, the rows of ``big`` under each; without it they are
    counted.  No more than ``PARTS`` keys can be hot, and no more than twice as many rows are
    repeated per row of ``small``, so what goes to the driver and to all tasks is bounded.
    """
    if sizes is None:
        sizes = big.groupBy(*keys).agg(F.count("*").alias("rows"))
    whole = sizes.agg(F.sum("rows").alias("total"), F.max("rows").alias("most")).first()
    bound = max(LEAST, (whole.total or 0) // PARTS)
    if (whole.most or 0) <= bound:
        return big.join(small, keys, how)
    hot = sizes.where(F.col("rows") > bound).select(*keys, F.ceil(F.col("rows") / bound).cast("int").alias("_salts")).collect()
    spark = big.sparkSession
    named = F.broadcast(spark.createDataFrame(hot, sizes.select(*keys, F.lit(0).alias("_salts")).schema))
    dealt = big.join(named, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    again = small.join(named, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(again, [*keys, "_salt"], how).drop("_salt")
