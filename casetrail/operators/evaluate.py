"""Scoring predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casetrail.functions.scalar import ratio


def confusion(pairs: DataFrame, key: str, predicted: str, truth: str, with_ids: bool = False) -> DataFrame:
    """One row of tp, fp, fn, tn and the metrics derived from them; every ratio is 0.0 where its
    denominator is 0. ``with_ids`` adds the sorted ids of the false cases."""
    p, t = F.col(predicted), F.col(truth)
    aggs = [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"),
            F.count_if(~p & ~t).alias("tn")]
    if with_ids:
        aggs += [F.array_sort(F.collect_list(F.when(p & ~t, F.col(key)))).alias("fp_ids"),
                 F.array_sort(F.collect_list(F.when(~p & t, F.col(key)))).alias("fn_ids")]
    d = pairs.agg(*aggs)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    d = d.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return (d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .withColumn("accuracy", ratio(tp + tn, n)).withColumn("baseline", ratio(F.greatest(tp + fn, fp + tn), n)))


def join_predictions(preds: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    return preds.join(truth, key, "inner")


def has_overlap(pairs: DataFrame) -> bool:
    return not pairs.isEmpty()
