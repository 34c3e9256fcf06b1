"""Items of varying length packed into containers of fixed capacity by patterns of few items.

Lengths are rounded up to units of the capacity, so what fits by units fits by tokens. All patterns of up
to MOST_PARTS lengths that fill a container are enumerated, repeat counts are fitted to the histogram of
lengths by non-negative least squares, rounded down and capped by what is there; the residual is packed
by the fullest pattern that its own histogram still allows. Where the mean item is far below the capacity,
containers of a quarter of it are packed first and packed again as items, so patterns stay short.

The driver sees histograms only (at most UNITS lengths a level, by SALTS), never items. Every item then
finds its container by its rank among the items of its length, which is counted within salts, so a length
that a third of all items have is spread over tasks.

Defined results: an item over the capacity fills whole containers and leaves one piece to be packed; items
of length 0 (null and empty texts) take no room and are spread over the containers by their keys; without
items of any length they all lie in container 0; an empty table gives no rows. Keys need to be unique.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from casetrail.session import ship

UNITS = 64
MOST_PARTS = 4
SALTS = 128


@functools.cache
def patterns(units: int = UNITS, parts: int = MOST_PARTS) -> np.ndarray:
    """All multisets of up to ``parts`` lengths that sum to ``units``, a row each: how often every length occurs."""
    rows = []

    def extend(left: int, most: int, so_far: list[int]) -> None:
        if left == 0:
            row = np.zeros(units, np.int16)
            for x in so_far:
                row[x - 1] += 1
            rows.append(row)
        elif len(so_far) < parts:
            for x in range(min(left, most), 0, -1):
                if x * (parts - len(so_far)) < left:
                    break
                extend(left - x, x, [*so_far, x])

    extend(units, units, [])
    return np.array(rows)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x with the least |a x - b| (active sets)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0.0)) * a.shape[0]
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / (x[at][bad] - z[bad] + 1e-300))
            x[at] += step * (z - x[at])
            active[at[(x[at] <= 1e-12)]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(lengths of a container's items, how many such containers) for items by length in units (1..)."""
    left = histogram.astype(np.int64).copy()
    units = len(left)
    out: list[tuple[np.ndarray, int]] = []
    if not left.any():
        return out
    table = patterns(units)
    usable = table[(table[:, left == 0] == 0).all(axis=1)]
    if len(usable):
        # relative to the counts, so that rare lengths weigh as much as frequent ones
        weight = 1 / np.sqrt(np.maximum(left, 1))
        x = nnls(usable.T.astype(float) * weight[:, None], left * weight)
        for k in np.argsort(-x, kind="stable"):
            need = usable[k].astype(np.int64)
            times = min(int(x[k] + 1e-6), int((left[need > 0] // need[need > 0]).min()))
            if times > 0:
                out.append((need, times))
                left -= times * need
    while left.any():  # residuals: the largest item, then whatever fits best
        room, need = units, np.zeros(units, np.int64)
        while room:
            fit = np.flatnonzero(left[:room] - need[:room] > 0)
            if not len(fit):
                break
            x = int(fit[-1]) + 1
            n = min(room // x, int(left[x - 1] - need[x - 1]))
            need[x - 1] += n
            room -= n * x
        times = int((left[need > 0] // need[need > 0]).min())
        out.append((need, times))
        left -= times * need
    return out


class Level:
    """One level of packing: which container the r-th item of a length lies in."""

    def __init__(self, histogram: np.ndarray):
        self.plan = plan(histogram)
        first = np.cumsum([0, *[t for _, t in self.plan]])
        self.containers = int(first[-1])
        self.filled = np.array([int((need * np.arange(1, len(need) + 1)).sum()) for need, _ in self.plan], np.int64)
        self.first = first.astype(np.int64)
        self.ends, self.slots = [], []
        for x in range(len(histogram)):
            slots = [(k, int(need[x]), times) for k, (need, times) in enumerate(self.plan) if need[x]]
            self.slots.append(np.array([(k, c) for k, c, _ in slots], np.int64).reshape(-1, 2))
            self.ends.append(np.cumsum([c * t for _, c, t in slots]).astype(np.int64))

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            slot = np.searchsorted(self.ends[x - 1], rank[at], "right")
            k, c = self.slots[x - 1][slot].T
            before = np.r_[0, self.ends[x - 1]][slot]
            out[at] = self.first[k] + (rank[at] - before) // c
        return out

    def pattern_of(self, container: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, container, "right") - 1


class Packing:
    """Levels from the smallest containers up. Level i has capacity / 4^(levels-1-i); items longer than a
    level's capacity wait for the next."""

    def __init__(self, capacity: int, levels: int, counts: list[np.ndarray]):
        self.capacity, self.levels = capacity, []
        carried = np.zeros(UNITS, np.int64)
        for i in range(levels):
            level = Level(counts[i] + carried)
            self.levels.append((level, counts[i].copy()))
            carried = np.zeros(UNITS, np.int64)
            if i + 1 < levels:
                up = self._up(level.filled)
                np.add.at(carried, up - 1, np.diff(level.first))
        self.containers = self.levels[-1][0].containers

    @staticmethod
    def _up(filled: np.ndarray) -> np.ndarray:
        return -(-filled // 4)

    def container(self, entry: int, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the items that enter at a level with a length and a rank, the top container each."""
        for i in range(entry, len(self.levels)):
            level = self.levels[i][0]
            at = level.place(length, rank)
            if i + 1 == len(self.levels):
                return at
            # a container becomes an item of the next level; those rank behind the items that enter there
            up = self._up(level.filled)
            of = level.pattern_of(at)
            length = up[of]
            before = np.zeros(len(up), np.int64)
            times = np.diff(level.first)
            for x in np.unique(up):
                mine = up == x
                before[mine] = np.cumsum(times[mine]) - times[mine]
            rank = self.levels[i + 1][1][length - 1] + before[of] + (at - level.first[of])
        return at


def level_capacities(capacity: int, mean: float) -> list[int]:
    """Capacities from the lowest level up: quarters, while the mean item would need over MOST_PARTS parts."""
    out = [capacity]
    while mean * MOST_PARTS < out[0] and out[0] % 4 == 0 and out[0] // 4 >= UNITS:
        out.insert(0, out[0] // 4)
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start, n_tokens, container_id): every item's pieces with their container.
    ``items`` should lie in a written table, as it is read three times."""
    spark = items.sparkSession
    ship(spark)
    n = F.col(size).cast("long")
    items = items.select(F.col(key), n.alias("n"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    rest = F.when(F.col("n") > capacity, F.pmod("n", F.lit(capacity))).otherwise(F.col("n"))
    items = items.withColumn("whole", F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(0).cast("long")).withColumn("rest", rest)
    stats = items.agg(F.avg(F.when(F.col("rest") > 0, F.col("rest"))).alias("mean"), F.sum("whole").alias("whole"), F.count("*").alias("rows")).first()
    sizes = level_capacities(capacity, stats["mean"] or 1.0)
    entry, unit = F.lit(len(sizes) - 1), F.lit(sizes[-1])
    for i in range(len(sizes) - 2, -1, -1):
        entry = F.when(F.col("rest") <= sizes[i], i).otherwise(entry)
        unit = F.when(F.col("rest") <= sizes[i], sizes[i]).otherwise(unit)
    # ceil(rest * UNITS / capacity of the level), in integers
    part = items.withColumn("entry", entry.cast("int")).withColumn(
        "length", F.floor((F.col("rest") * UNITS + unit - 1) / unit).cast("int"))
    packed = part.where("rest > 0")
    by = packed.groupBy("entry", "length", "salt").agg(F.count("*").alias("c")).toArrow()  # at most levels * UNITS * SALTS rows
    counts = [np.zeros(UNITS, np.int64) for _ in sizes]
    offsets = np.zeros((len(sizes), UNITS + 1, SALTS), np.int64)
    for e, x, s, c in zip(*(by.column(i).to_pylist() for i in range(4))):
        counts[e][x - 1] += c
        offsets[e, x, s] = c
    offsets = np.cumsum(offsets, axis=2) - offsets
    packing = Packing(capacity, len(sizes), counts)
    shared = spark.sparkContext.broadcast((packing, offsets))
    top, whole = packing.containers, int(stats["whole"] or 0)
    w = Window.partitionBy("entry", "length", "salt").orderBy(key)
    ranked = packed.withColumn("r", F.row_number().over(w) - 1).select(key, "whole", "n", "rest", "entry", "length", "salt", "r")
    schema = StructType([items.schema[key], StructField("piece_no", IntegerType()), StructField("start", LongType()),
                         StructField("n_tokens", LongType()), StructField("container_id", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing, offsets = shared.value
        for b in batches:
            whole, n, rest, entry, length, salt, r = (b.column(i).to_numpy().astype(np.int64) for i in range(1, 8))
            at = np.zeros(len(n), np.int64)
            for e in np.unique(entry):
                mine = entry == e
                at[mine] = packing.container(int(e), length[mine], offsets[e, length[mine], salt[mine]] + r[mine])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((whole + 1).astype(np.int32)), pa.array(n - rest), pa.array(rest), pa.array(at)],
                                             names=schema.names)

    ends = ranked.mapInArrow(run, schema)
    # whole pieces of long items fill containers of their own, numbered within salts behind the others
    long_items = part.where("whole > 0")
    per_salt = {r["salt"]: r["w"] for r in long_items.groupBy("salt").agg(F.sum("whole").alias("w")).collect()} if whole else {}
    before = np.cumsum([0, *[per_salt.get(s, 0) for s in range(SALTS)]])[:-1]
    base = F.element_at(F.array(*[F.lit(int(x) + top) for x in before]), F.col("salt") + 1)
    run_sum = F.sum("whole").over(Window.partitionBy("salt").orderBy(key)) - F.col("whole")
    wholes = (long_items.withColumn("first", base + run_sum)
              .select(key, F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("p"), "first")
              .select(key, (F.col("p") + 1).cast("int").alias("piece_no"), (F.col("p").cast("long") * capacity).alias("start"),
                      F.lit(capacity).cast("long").alias("n_tokens"), (F.col("first") + F.col("p")).alias("container_id")))
    empty = (part.where("n = 0 or n is null").select(key, F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("start"),
                                                      F.lit(0).cast("long").alias("n_tokens"),
                                                      F.pmod(F.xxhash64(key), F.lit(max(1, top + whole))).alias("container_id")))
    return ends.unionByName(wholes).unionByName(empty)
