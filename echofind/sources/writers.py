"""Writers: tables, reports, models and the data behind plots."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def parquet(df: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def report_json(df: DataFrame, path: str) -> None:
    """A report of few rows, as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def nested_json(spark: SparkSession, value: object, path: str) -> None:
    """A nested report of the driver; numbers of array libraries become plain ones."""
    text = json.dumps(value, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)


def summary(df: DataFrame, numbers: Iterable[str], digits: int = 4) -> DataFrame:
    """The table with its numbers as text of fixed digits."""
    return df.withColumns({c: F.format_number(c, digits) for c in numbers})


def markdown(df: DataFrame, order: Column) -> DataFrame:
    """The rows of a small table as lines of a Markdown table, headed and in order: ``line_no, line``."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    from pyspark.sql import Window

    body = df.select((F.row_number().over(Window.orderBy(order)) + 1).cast("long").alias("line_no"), cells.alias("line"))
    spark = df.sparkSession
    head = [(0, f"| {' | '.join(df.columns)} |"), (1, f"|{'---|' * len(df.columns)}")]
    return spark.createDataFrame(head, "line_no long, line string").union(body)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins between two bounds; both ends included, values outside left out."""
    x = F.col(column).cast("double")
    place = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where(x.between(low, high)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
