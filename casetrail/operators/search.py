"""Vector and keyword search over chunks, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casetrail.functions.scalar import dot
from casetrail.session import ship


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def top_k_by_vector(df: DataFrame, id_col: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows nearest to one stated query vector, ties by id; a top-k plan, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_col, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def _blocks(df: DataFrame, id_col: str, vector: str, prefix: str, size: int) -> DataFrame:
    """(ids, dim, units): up to ``size`` vectors of one length a row, scaled to 1; dim 0 where there is no direction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([dim], pa.int32()),
                                               pa.array([np.array(vectors, "<f8").tobytes()], pa.binary())], names=names)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.array([] if v is None or None in v else v, np.float64)
                norm = float(np.sqrt(v @ v))
                v = v / norm if norm > 0 else v[:0]
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    names = [f"{prefix}ids", f"{prefix}dim", f"{prefix}units"]
    return df.select(F.col(id_col).cast("long"), vector).mapInArrow(run, f"{names[0]} binary, {names[1]} int, {names[2]} binary")


def top_k_of_queries(df: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int, size: int = 2048) -> DataFrame:
    """(query_id, id, score): the k rows nearest to every row of ``queries``, ties by id. Blocks of queries meet
    blocks of rows; each meeting gives k rows a query at most, and of those the k best are kept."""
    ship(df.sparkSession)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_dim, q_units, ids, dim, units in zip(*(c.to_pylist() for c in b.columns)):
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                score = np.zeros((len(q_ids), len(ids)))
                if q_dim == dim and dim:
                    score = np.frombuffer(q_units, "<f8").reshape(-1, dim) @ np.frombuffer(units, "<f8").reshape(-1, dim).T
                score = np.round(score, 12)  # so that equal vectors tie, whatever the order of additions
                n = min(k, len(ids))
                least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                q, row = np.nonzero(score >= least[:, None])
                order = np.lexsort((ids[row], -score[q, row], q))
                q, row = q[order], row[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < n
                q, row = q[keep], row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[row]), pa.array(score[q, row])], names=["query_id", id_col, "score"])

    both = _blocks(queries, id_col, vector, "q_", size).crossJoin(_blocks(df, id_col, vector, "", size))
    best = both.mapInArrow(meet, f"query_id long, `{id_col}` long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return best.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def bm25(df: DataFrame, id_col: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of every row holding one of a few stated terms. Corpus statistics cover all rows and
    form one aggregate row; no shuffle of texts."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def count(term: str) -> Column:
        """Occurrences as a whole word; the pattern runs only where the letters are there at all."""
        word = F.regexp_count(F.col("_t"), F.lit(rf"(?U)(?<!\w)\Q{term}\E(?!\w)"))
        return F.when(F.contains(F.col("_t"), F.lit(term)), word).otherwise(0)

    base = df.select(id_col, low.alias("_t")).select(
        id_col, F.regexp_count("_t", F.lit(r"(?U)\w+")).alias("_n"),
        *[count(t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = base.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"),
                     *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, n = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_docs") - n + 0.5) / (n + 0.5) + 1.0)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    hit = F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return base.where(hit).crossJoin(F.broadcast(stats)).select(id_col, score.alias("score"))


def ranked(hits: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best hits with their rank, ties by id."""
    best = hits.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # over k rows


def fuse(ranked: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of result lists that carry id and rank."""
    both = None
    for r in ranked:
        part = r.select(id_col, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("_s"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(id_col).agg(F.sum("_s").alias("score"))
