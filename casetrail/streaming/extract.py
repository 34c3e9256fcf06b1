"""Extraction over a folder that grows: stateless, so a stream gives what a batch over the same files gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casetrail.functions.extraction import DEFAULT, Rules, apply_extraction
from casetrail.schemas import CASE_REPORT


def stream_reports(spark: SparkSession, folder: str, rules: Rules = DEFAULT) -> DataFrame:
    return apply_extraction(spark.readStream.schema(CASE_REPORT).json(folder), rules)


def write_stream(df: DataFrame, target: str, checkpoint: str):
    """Works off what is there and ends; a later call goes on behind it."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
