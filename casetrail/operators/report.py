"""Summary tables over extraction results and merged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casetrail.functions.scalar import ratio

BUCKETS = ("high", "medium", "gazetteer", "signal_only", "none", "no_abstract")


def level_counts(df: DataFrame) -> DataFrame:
    """Counts per evidence level, zeros included, with the totals derived from them."""
    c = F.col("evidence_level")
    d = df.agg(F.count("*").alias("total"), *[F.count_if(c == b).alias(f"n_{b}") for b in BUCKETS])
    return (d.withColumn("populated", F.col("n_high") + F.col("n_medium") + F.col("n_gazetteer"))
            .withColumn("no_signal_pct", 100 * ratio(F.col("n_none"), F.col("total"))))


def coverage(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """Rows, flagged rows and their share per group, with a total row where the group is null
    and is_total is 1."""
    return (df.rollup(group).agg(F.grouping(group).cast("int").alias("is_total"), F.count("*").alias("n"),
                                 F.count_if(flag).alias("n_flagged"))
            .withColumn("share", ratio(F.col("n_flagged"), F.col("n"))))


def topic_matrix(df: DataFrame, group: str, text: str, topics: dict[str, str]) -> DataFrame:
    """One row per group value and topic whose keywords a text has."""
    hit = F.array_compact(F.array(*[F.when(F.rlike(F.col(text), F.lit(p)), F.lit(t)) for t, p in topics.items()]))
    return df.select(group, F.explode(hit).alias("topic"))


def confusion_edges(df: DataFrame, sequence: str, target: str) -> DataFrame:
    """Edges from a wrong diagnosis to the final disease with their frequency."""
    return (df.select(F.explode(sequence).alias("wrong"), F.col(target).alias("disease"))
            .where(F.col("wrong").isNotNull()).groupBy("wrong", "disease").agg(F.count("*").alias("weight")))


def trail(sequence: Column) -> Column:
    return F.array_join(sequence, " → ")


def topic_table(df: DataFrame, group: str, text: str, topics: dict[str, str]) -> DataFrame:
    """Texts with a topic's keywords, one row per group value and one column per topic."""
    return df.groupBy(group).agg(*[F.count_if(F.rlike(F.col(text), F.lit(p))).alias(t) for t, p in topics.items()])


def figure_totals(figures: DataFrame, article: str, file: str) -> DataFrame:
    """The running totals of a figure job at its end: articles with figures, figures, figures with a file, figures left unclassified."""
    return figures.agg(F.countDistinct(article).alias("articles"), F.count("*").alias("figures"), F.count(file).alias("saved"),
                       F.count_if(F.lower("figure_type") == "other").alias("unclassified"))


def direction(entities: Column, disease: Column) -> Column:
    """forward where a record names wrong diagnoses before its disease, reverse where its disease was the wrong diagnosis, none else."""
    own = F.exists(entities, lambda e: F.lower(e) == F.lower(disease))
    return F.when(F.coalesce(own, F.lit(False)), "reverse").when(F.coalesce(F.size(entities), F.lit(0)) > 0, "forward").otherwise("none")
