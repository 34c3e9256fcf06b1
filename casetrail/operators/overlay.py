"""Annotation decisions laid over figure rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casetrail.functions.figures import is_annotated


def apply_decisions(figures: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions hold the keys, new_type and remove. Rows not yet annotated take the new type or
    go; annotated rows and rows without a decision stay. Repeated decisions: the largest type,
    and removal wins."""
    d = decisions.groupBy(*keys).agg(F.max("new_type").alias("_new"), F.max(F.coalesce("remove", F.lit(False))).alias("_gone"))
    open_row = ~is_annotated(F.col("figure_type"))
    return (figures.join(d, keys, "left")
            .where(~(open_row & F.coalesce("_gone", F.lit(False))))
            .withColumn("figure_type", F.when(open_row, F.coalesce("_new", "figure_type")).otherwise(F.col("figure_type")))
            .drop("_new", "_gone"))


def progress(figures: DataFrame) -> DataFrame:
    return figures.agg(F.count("*").alias("total"), F.count_if(is_annotated(F.col("figure_type"))).alias("annotated"))
