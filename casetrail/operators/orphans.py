"""References to records that do not exist, found by bitmap algebra over key ranges and periods.

References are first reduced to distinct (table, key, month) before the shuffle, so a key that a
third of all rows name costs one row per map task, table and month. Partitions hold whole keys in
sorted order; each is walked in ranges of at most 65,536 keys. A range's keys become integers through
its own dictionary, and every (table, month) becomes a compressed bitmap over them, as does the set
of parents alive for the whole month. Reference AND-NOT parent leaves the bits of keys that were
missing for at least a part of the month; they are decoded and the month's rows are then held against
the parent's exact life, as a parent may come or go within the month.

Defined results: a null key and a key without a digit refer to nothing and are no orphans; a row
without a time is held against the whole of history (orphan if no parent ever came, or it was withdrawn);
a parent row without a time counts as never loaded; a withdrawal without one is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from casetrail.functions.keys import article_key
from casetrail.session import ship

RANGE = 65_536
END = 2**63 - 1  # "never": after every time in microseconds


class Bitmap:
    """A set of integers below 65,536, kept as a sorted array while sparse and as bits when dense."""

    __slots__ = ("low", "bits")

    def __init__(self, values: np.ndarray):
        if len(values) > 4096:
            self.low, self.bits = None, np.zeros(RANGE // 8, np.uint8)
            np.bitwise_or.at(self.bits, values >> 3, (1 << (values & 7)).astype(np.uint8))
        else:
            self.low, self.bits = np.unique(values).astype(np.uint16), None

    def holds(self, values: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return (self.bits[values >> 3] >> (values & 7).astype(np.uint8)) & 1 == 1
        if not len(self.low):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(self.low, values), len(self.low) - 1)
        return self.low[at] == values

    def values(self) -> np.ndarray:
        if self.bits is None:
            return self.low.astype(np.int64)
        return np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))

    def and_not(self, other: "Bitmap") -> "Bitmap":
        if self.bits is not None and other.bits is not None:
            out = Bitmap(np.empty(0, np.int64))
            out.low, out.bits = None, self.bits & ~other.bits
            return out
        mine = self.values()
        return Bitmap(mine[~other.holds(mine)])


def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def parents(reports: DataFrame, withdrawals: DataFrame, key: str, loaded: str, withdrawn: str) -> DataFrame:
    """(key, first_loaded, withdrawn) in microseconds; one shuffle for both tables."""
    a = reports.select(article_key(key).alias("key"), _micros(F.col(loaded)).alias("first_loaded"),
                       F.lit(None).cast("long").alias("withdrawn"))
    b = withdrawals.select(article_key(key).alias("key"), F.lit(None).cast("long").alias("first_loaded"),
                           _micros(F.col(withdrawn)).alias("withdrawn"))
    return (a.unionByName(b).where(F.col("key").isNotNull()).groupBy("key")
            .agg(F.coalesce(F.min("first_loaded"), F.lit(END)).alias("first_loaded"),
                 F.coalesce(F.min("withdrawn"), F.lit(END)).alias("withdrawn")))


def references(tables: dict[str, tuple[DataFrame, str]], key: str, loaded: str) -> DataFrame:
    """(table_name, row_id, key, at, period) of every row that refers to something."""
    out = None
    for name, (df, row_id) in tables.items():
        part = df.select(F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"),
                         article_key(key).alias("key"), F.col(loaded).cast("timestamp").alias("at"))
        out = part if out is None else out.unionByName(part)
    return (out.where(F.col("key").isNotNull())
            .withColumn("period", F.coalesce(F.year("at") * 12 + F.month("at") - 1, F.lit(-1)).cast("long"))
            .withColumn("at", F.coalesce(F.unix_micros("at"), F.lit(END - 1))))


SURVIVOR = StructType([StructField("table_name", StringType()), StructField("key", StringType()),
                       StructField("period", LongType()), StructField("first_loaded", LongType()),
                       StructField("withdrawn", LongType())])


def _month_start(period: int) -> int:
    return int(np.datetime64(f"{period // 12:04d}-{period % 12 + 1:02d}", "us").astype(np.int64))


def _solve(chunk: pa.Table) -> pa.RecordBatch | None:
    """The surviving (table, key, period) of one range. Rows without a table are the parents."""
    keys = chunk.column("key").combine_chunks().dictionary_encode()
    code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = chunk.column("table_name").combine_chunks().dictionary_encode()
    is_parent = np.asarray(names.indices.is_null())
    first = np.full(len(keys.dictionary), END, np.int64)
    gone = np.full(len(keys.dictionary), END, np.int64)
    first[code[is_parent]] = chunk.column("first_loaded").fill_null(END).to_numpy()[is_parent]
    gone[code[is_parent]] = chunk.column("withdrawn").fill_null(END).to_numpy()[is_parent]
    if is_parent.all():
        return None
    table = np.where(is_parent, -1, np.asarray(names.indices.fill_null(-1)))
    period = chunk.column("period").fill_null(-2).to_numpy()
    out_t, out_k, out_p = [], [], []
    for p in np.unique(period[~is_parent]):
        if p < 0:
            alive = (first < END) & (gone == END)
        else:
            alive = (first <= _month_start(int(p))) & (gone >= _month_start(int(p) + 1))
        alive_bits = Bitmap(np.flatnonzero(alive))
        for t in np.unique(table[(period == p) & ~is_parent]):
            left = Bitmap(code[(period == p) & (table == t)]).and_not(alive_bits).values()
            out_t.append(np.full(len(left), t))
            out_k.append(left)
            out_p.append(np.full(len(left), p))
    k = np.concatenate(out_k)
    if not len(k):
        return None
    return pa.RecordBatch.from_arrays([
        names.dictionary.take(pa.array(np.concatenate(out_t))).cast(pa.string()),
        keys.dictionary.take(pa.array(k)).cast(pa.string()), pa.array(np.concatenate(out_p), pa.int64()),
        pa.array(first[k]), pa.array(gone[k])], names=SURVIVOR.names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a stream sorted by key into ranges of whole keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < RANGE:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column("key").combine_chunks()
        last = keys[len(keys) - 1].as_py()
        cut = pa.compute.index(keys, last).as_py()
        if cut:
            yield from _ranges(whole.slice(0, cut))
            held, rows = whole.slice(cut).to_batches(), len(keys) - cut
    if held:
        yield from _ranges(pa.Table.from_batches(held))


def _ranges(whole: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = whole.column("key").combine_chunks()
    code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    for lo in range(0, int(code[-1]) + 1, RANGE):
        a, b = np.searchsorted(code, [lo, lo + RANGE])
        if (out := _solve(whole.slice(a, b - a))) is not None:
            yield out


def find_orphans(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """(table_name, row_id, key, at, period) of the references whose parent was not alive."""
    ship(refs.sparkSession)
    distinct = refs.select("table_name", "key", "period").distinct().select(
        "table_name", "key", "period", F.lit(None).cast("long").alias("first_loaded"), F.lit(None).cast("long").alias("withdrawn"))
    own = parent.select(F.lit(None).cast("string").alias("table_name"), "key", F.lit(None).cast("long").alias("period"),
                        "first_loaded", "withdrawn")
    both = distinct.unionByName(own).repartition("key").sortWithinPartitions("key")
    left = both.mapInArrow(_walk, SURVIVOR)
    return (refs.join(left, ["table_name", "key", "period"])
            .where((F.col("at") < F.col("first_loaded")) | (F.col("at") >= F.col("withdrawn")))
            .select("table_name", "row_id", "key", "at", "period"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan rows per table and month; month is "unknown" for rows without a time."""
    month = F.when(F.col("period") < 0, "unknown").otherwise(
        F.format_string("%04d-%02d", F.floor(F.col("period") / 12), F.col("period") % 12 + 1))
    return orphans.groupBy("table_name", month.alias("month")).agg(F.count("*").alias("n_orphans"))
