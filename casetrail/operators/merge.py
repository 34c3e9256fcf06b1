"""Merging case reports and figures by article into nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by ``order``. Partial aggregation runs before the shuffle, so a
    key with a third of all rows sends one row per map task."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def merge_records(cases: DataFrame, figures: DataFrame, key: str, case_order: list[str], figure_order: list[str],
                  merged_at: Column | None = None) -> DataFrame:
    """Full outer join of cases and figures: one row per key with a case struct (or null) and the
    list of figures in ``figure_order`` (or an empty list).

    The case's disease stands where a case exists, even an empty one; else the first figure's; null
    becomes "". Null keys refer to nothing and are left out. Repeated cases: the last one.
    The figures of one article form one array by nature of the result.
    """
    c_cols, f_cols = ([key, *(c for c in d.columns if c != key)] for d in (cases, figures))  # nested records are whole
    c = (last_wins(cases.where(F.col(key).isNotNull()), key, *case_order)
         .select(key, F.struct(*[F.col(x) for x in c_cols]).alias("case_report")))
    item = F.struct(F.struct(*[F.col(x) for x in figure_order]).alias("_o"), F.struct(*[F.col(x) for x in f_cols]).alias("_f"))
    f = (figures.where(F.col(key).isNotNull()).groupBy(key)
         .agg(F.sort_array(F.collect_list(item)).alias("_l"))
         .select(key, F.transform("_l", lambda x: x["_f"]).alias("figures")))
    disease = F.when(F.col("case_report").isNotNull(), F.col("case_report.disease")).otherwise(
        F.try_element_at("figures", F.lit(1))["disease"])
    return c.join(f, key, "full").select(
        key, F.coalesce(disease, F.lit("")).alias("disease"), "case_report",
        F.coalesce("figures", F.array()).alias("figures"),
        (merged_at if merged_at is not None else F.current_timestamp()).alias("merged_at"))


def summary(merged: DataFrame, key: str) -> DataFrame:
    return merged.select(key, "disease", F.col("case_report").isNotNull().alias("has_case_report"),
                         F.coalesce(F.size("figures"), F.lit(0)).alias("n_figures"))


def merged_summary(cases: DataFrame, figures: DataFrame, key: str, case_order: list[str], figure_order: list[str]) -> DataFrame:
    """What summary() gives of the merged records, and their first figure, without building the lists: figures are
    counted before the shuffle, so an article with any number of them sends one row per map task."""
    c = last_wins(cases.where(F.col(key).isNotNull()), key, *case_order).select(key, F.struct("disease").alias("_case"))
    order = F.struct(*[F.col(x) for x in figure_order])
    f = (figures.where(F.col(key).isNotNull()).groupBy(key)
         .agg(F.count("*").cast("int").alias("_n"), F.min_by(F.struct(*[F.col(x) for x in figures.columns if x != key]), order).alias("first")))
    disease = F.when(F.col("_case").isNotNull(), F.col("_case.disease")).otherwise(F.col("first.disease"))
    return c.join(f, key, "full").select(key, F.coalesce(disease, F.lit("")).alias("disease"), F.col("_case").isNotNull().alias("has_case_report"),
                                         F.coalesce("_n", F.lit(0)).alias("n_figures"), "first")
