"""Repetition inside a document, judged by document and by the source it comes from.

A document's repeated share is the share of its words that stand in runs of five or more words which
came earlier in the same document. Rules on it fail documents; failures are counted by source, each
source's rate is shrunk towards the whole corpus by a beta prior fitted to all sources (empirical Bayes),
and the source's verdict is joined back to its documents. The rates alone cannot tell which document
repeats itself, so a document's own rule decides about it and the verdict stands beside it.

Defined results: null, empty and blank texts and texts under six words have share 0; a null source is a
source of its own; letters' case, look-alike characters, punctuation, spacing and the numbering
of lines do not matter; numbers elsewhere are words. Texts are handled whole; repeated rows each count.
Counting by source is partial before the shuffle, so a source with a third of all rows costs one row per
map task; what is joined back is one row per source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from casetrail.llm.fold import fold
from casetrail.session import cut, ship

RUN = 5
LIMIT = 1 / 3
NUMBERING = re.compile(r"(?m)^[ \t]*(?:[-*•·–—>#]+[ \t]*)*(?:\(?(?:\d{1,4}|[ivxIVX]{1,5}|[a-zA-Z])[.):\]](?=\s|$)|#\d+|\d{1,4}(?=\s+[^\W\d]))?")
WORD = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD(fold(NUMBERING.sub("", text)).lower())


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def shares(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words, repeated words) of each text."""
    all_words = [words(t) if t else [] for t in texts]
    n = np.array([len(w) for w in all_words], np.int64)
    total = int(n.sum())
    seq = np.fromiter(map(_Codes().__getitem__, chain.from_iterable(all_words)), np.uint64, total)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    out = np.zeros(len(texts), np.int64)
    if total <= RUN:
        return n, out
    grams = total - RUN + 1
    with np.errstate(over="ignore"):
        h = (doc[:grams] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(31)
        for k in range(RUN):
            h = (h ^ (seq[k:k + grams] + np.uint64(k + 1))) * _MIX
            h ^= h >> np.uint64(29)
    inside = np.flatnonzero(doc[:grams] == doc[RUN - 1:])
    h = h[inside]
    order = np.argsort(h, kind="stable")
    again = inside[order[1:][h[order[1:]] == h[order[:-1]]]]
    covered = np.zeros(total, bool)
    for k in range(RUN):
        covered[again + k] = True
    return n, np.bincount(doc[covered].astype(np.int64), minlength=len(texts))


def repeated_share(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """(key, keep..., n_words, n_repeated, share)."""
    ship(df.sparkSession)
    source = df.select(key, *keep, text)
    schema = StructType([*[source.schema[c] for c in (key, *keep)], StructField("n_words", IntegerType()),
                         StructField("n_repeated", IntegerType()), StructField("share", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, r = shares(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(n.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(r / np.maximum(n, 1))],
                    names=schema.names)

    return source.mapInArrow(run, schema)


def beta_prior(rates: DataFrame, n: str, failed: str) -> DataFrame:
    """One row (alpha, beta): a beta distribution fitted by moments to the sources' rates, weighted by
    their sizes. Where the rates do not vary beyond chance, the prior is as strong as all rows together."""
    s = rates.agg(F.sum(n).cast("double").alias("N"), F.sum(failed).cast("double").alias("K"), F.count("*").cast("double").alias("g"),
                  F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"),
                  F.sum(F.pow(F.col(failed), F.lit(2.0)) / F.col(n)).alias("kk"))
    mean = F.try_divide(F.col("K"), F.col("N"))
    between = F.col("kk") - F.col("N") * mean * mean  # weighted squares around the mean
    spread = F.try_divide(between - (F.col("g") - 1) * mean * (1 - mean), F.col("N") - F.try_divide(F.col("nn"), F.col("N")))
    strength = F.when(spread > 0, F.greatest(F.try_divide(mean * (1 - mean), spread) - 1, F.lit(1.0))).otherwise(F.col("N"))
    mean, strength = F.coalesce(mean, F.lit(0.0)), F.coalesce(strength, F.lit(1.0))
    # half a failure and half a success keep both parameters above zero
    return s.select((mean * strength + 0.5).alias("alpha"), ((1 - mean) * strength + 0.5).alias("beta"))


def source_verdicts(judged: DataFrame, source: str, failed: str) -> DataFrame:
    """(source, n_docs, n_failed, rate, shrunk_rate, corpus_rate, is_suspect): a source is suspect when
    its shrunk rate is at least twice the corpus's."""
    by = judged.groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed"))
    prior = beta_prior(by, "n_docs", "n_failed")
    prior = prior.withColumn("corpus_rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    return by.crossJoin(F.broadcast(prior)).select(  # the prior is one row
        source, "n_docs", "n_failed", (F.col("n_failed") / F.col("n_docs")).alias("rate"), shrunk.alias("shrunk_rate"), "corpus_rate",
        (shrunk >= 2 * F.col("corpus_rate")).alias("is_suspect"))


def judge(df: DataFrame, key: str, text: str, source: str, limit: float = LIMIT) -> DataFrame:
    """Every document with its share, whether it fails its rule, and its source's verdict."""
    d = repeated_share(df.select(F.col(key), F.col(source).alias("source"), F.col(text).alias("text")), key, "text", ["source"])
    d = cut(d.withColumn("is_repetitive", F.col("share") >= limit - 1e-12))
    v = source_verdicts(d, "source", "is_repetitive").withColumnRenamed("source", "_source")
    return (d.join(v, F.col("source").eqNullSafe(F.col("_source")), "left")
            .select(key, "source", "n_words", "n_repeated", "share", "is_repetitive", "rate", "shrunk_rate", "is_suspect"))
