"""The registered queries of this package, one per operator, and their SQL."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import html_blocks, importance, nnls_packing, pii_semicrf, recompress, repetition, secret_grammar, setsketch, sql, warc_store, winnow
from .scratch import folder, remove


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.verdicts(winnow.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(_table(spark, sf_dir, "documents")).drop("dup_gram_share", "dup_line_share")


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.linked(_table(spark, sf_dir, "documents"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.deduplicated(_table(spark, sf_dir, "documents"))


def op1_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(_table(spark, sf_dir, "pages"))


def op2_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_semicrf.find_personal(_table(spark, sf_dir, "documents"))


def op7_grammar_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.find_secrets(_table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc_store.write_archive(_table(spark, sf_dir, "pages"), path)
    atexit.register(remove, spark, path)
    return warc_store.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary() -> nnls_packing.Vocabulary:
    import public_tokenizers as public

    return nnls_packing.Vocabulary(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.checksums(nnls_packing.packed(_table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {
    f.__name__: f
    for f in (
        op1_text_blocks,
        op2_semi_markov,
        op3_warc,
        op4_winnowing,
        op5_repetition_coverage,
        op6_setsketch,
        op7_grammar_inference,
        op8_nnls_packing,
        op9_importance_resampling,
        op10_recompression,
    )
}
SQL: dict[str, str] = {
    "op3_warc": sql.WARC,
    "op4_winnowing": sql.WINNOWING,
    "op5_repetition_coverage": sql.REPETITION,
    "op6_setsketch": sql.SETSKETCH,
    "op10_recompression": sql.RECOMPRESSION,
}
