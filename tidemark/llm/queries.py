"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, license_scan, line_templates, media, neardup, packing, quality, secrets, token_files, toxicity
from tidemark.llm.common import table
from tidemark.llm.sql import SQL as SQL


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the owner, its part in one language the repository."""
    return secrets.secrets(table(spark, sf_dir, "documents"), F.col("source"), F.concat("source", F.lit("/"), "lang"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_dedup(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents name no URL: the source is the host, its part in one language the path."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_token_files(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_line_dedup, op3_quality, op4_media, op5_decontamination, op6_packing, op7_near_duplicates, op8_toxicity, op9_license_scan, op10_token_files)}
