"""Shared helpers of operators that read documents in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a vectorised operator holds; a longer document is a step of its own.
STEP_BYTES = 1 << 20


#: Rows of an Arrow batch that few_rows() sets: whole texts in batches of Spark's 10,000 rows (64 MB at most) fill a small executor's memory outside the heap.
BATCH_ROWS = 512
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows(spark: SparkSession) -> None:
    """Keeps the Arrow batches of a session small, unless it has been told otherwise. For applications; operators leave the session alone."""
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


#: What the running Python worker keeps between tasks: one model, so that those of earlier stages don't fill its memory.
_kept: tuple = (None, None)


def only(key, make: Callable[[], object] = lambda: None):
    """The worker's one kept model: the one of this key, made if another is kept. What earlier tasks have left free goes back to the system."""
    global _kept
    if _kept[0] != key:
        _kept = (None, None)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _kept = (key, make())
    return _kept[1]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns beside those of df: the given ones, with as many _ behind them as make them new."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: What the hashes of sampled() are below.
TOP = 1 << 63


def sampled(rows: DataFrame, by: str, keys: list[str], most: int, size: Column | None = None, most_size: int = 0, least: int = 1) -> DataFrame:
    """About `most` different rows by their keys, taken by a hash, for all values of `by`; rows that repeat are taken together.

    Of each value `least` different rows are taken where there are as many, and
    the one with the smallest hash always, so no value is lost. With a size of
    a row, the sizes of those taken add up to about most_size. Shares are parts
    of 2^63, so any table has a sample. A row for each value of `by` reaches
    the driver.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("__hash", F.xxhash64(*(F.col(f"`{k}`") for k in keys)).bitwiseAND(F.lit(TOP - 1)))
    counts = hashed.groupBy(F.col(f"`{by}`").alias("v")).agg(F.approx_count_distinct("__hash").alias("n"), F.min("__hash").alias("low"), F.sum(size if size is not None else F.lit(0)).cast("double").alias("size")).collect()
    n, total = sum(r.n for r in counts), sum(r.size for r in counts)
    share = min(1.0, most / max(n, 1), most_size / total if most_size and total else 1.0)
    if share == 1.0:
        return rows
    edges = [(r.v, max(min(TOP - 1, int(TOP * max(share, min(1.0, least / max(r.n, 1))))), r.low)) for r in counts]
    limits = spark.createDataFrame(edges, f"__value {rows.schema[by].dataType.simpleString()}, __edge long")
    return hashed.join(F.broadcast(limits), F.col(f"`{by}`") == F.col("__value")).where("__hash <= __edge").select(*(F.col(f"`{c}`") for c in rows.columns))


def text_keys(text_col: str) -> list[Column]:
    """text_low and text_high: 128 bits that tell the texts of one id apart, by two hashes of different seeds."""
    text = F.col(f"`{text_col}`")
    return [F.xxhash64(text).alias("text_low"), F.xxhash64(F.lit(5), text).alias("text_high")]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, and one row at least."""
    at, held = 0, 0
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def arrow_rows(df: DataFrame, column: str, add: Callable, schema: str, key) -> DataFrame:
    """df with more columns, which add(texts) gives as Arrow arrays for slices of bounded text."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(key)
        for batch in batches:
            for part in steps(batch, column):
                new = add(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], [*names, *new])

    from pyspark.sql.types import StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(schema).fields]))


def map_steps(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text", limit: int = STEP_BYTES) -> DataFrame:
    """mapInArrow over slices of about `limit` bytes of text. make() runs once in a task and returns the step; it names the model that the worker keeps with only()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in steps(batch, column, limit):
                yield step(part)

    return df.mapInArrow(run, schema)


class Numbers:
    """Numbers by 64-bit hash (never 0): open addressing in a table that grows, so that six of ten slots at most are taken."""

    def __init__(self, slots: int):
        """slots: a power of two."""
        self.keys, self.number, self.taken = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(20)).astype(np.int64) & (len(self.keys) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of known hashes, -1 for others. There always is a free slot, at which an unknown one ends."""
        out = np.full(len(h), -1, np.int32)
        left, at, last = np.arange(len(h)), self._first(h), len(self.keys) - 1
        while len(left):
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.number[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], (at[go] + 1) & last
        return out

    def add(self, h: np.ndarray, number: np.ndarray) -> None:
        """Adds distinct hashes that are not there yet."""
        slots = len(self.keys)
        while 10 * (self.taken + len(h)) > 6 * slots:
            slots *= 2
        if slots > len(self.keys):
            own = np.flatnonzero(self.keys)
            h, number = np.concatenate([self.keys[own], h]), np.concatenate([self.number[own], number])
            self.keys, self.number, self.taken = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0
        self.taken += len(h)
        left, at, last = np.arange(len(h)), self._first(h), slots - 1
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            won = free & (self.keys[at] == h[left])
            self.number[at[won]] = number[left[won]]
            left, at = left[~won], (at[~won] + 1) & last


class Spelling:
    """The bytes of numbered units, to compare units that have one hash."""

    def __init__(self):
        self.raw, self.first, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, units: list[bytes]) -> None:
        size = np.array([len(u) for u in units], np.int64)
        self.first = np.append(self.first, len(self.raw) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.raw = np.append(self.raw, np.frombuffer(b"".join(units), np.uint8))

    def differ(self, number: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the units at begin, those whose bytes are not those of their number."""
        same = self.size[number] == size
        if same.all():
            at = np.arange(int(size.sum()))
            shift = np.cumsum(size) - size
            bad = self.raw[at + np.repeat(self.first[number] - shift, size)] != flat[at + np.repeat(begin - shift, size)]
            return np.unique(np.repeat(np.arange(len(size)), size)[bad]) if bad.any() else np.zeros(0, np.int64)
        some = np.flatnonzero(same)
        return np.union1d(np.flatnonzero(~same), some[self.differ(number[some], flat, begin[some], size[some])])
