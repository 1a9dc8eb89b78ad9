"""Queries of the ten operators over whole tables, and the SQL for those that
SQL can express.  Each query is a thin wrapper: table in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import table


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.wavelet import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.licenses import scan_table

    return scan_table(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.toxicity import score_table

    return score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.htmlblocks import extract_table

    return extract_table(table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.langid import predict_table

    return predict_table(table(spark, sf_dir, "documents"))


def op8_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.separators import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.ann import search_table

    return search_table(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_wavelet, op2_licenses, op3_toxicity, op4_decontaminate, op5_simhash, op6_html, op7_langid, op8_separators, op9_ann, op10_packing)}


def oracle_sql() -> dict[str, str]:
    from sparkloom.llm.licenses import scan_sql

    return {"op2_licenses": scan_sql()}
