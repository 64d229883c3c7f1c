"""Operator 11: what each of several filters removes, in every order that they can be applied in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import held

#: White space between words.
GAPS = r"[\x20\x09-\x0D]+"


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 200


def few_distinct(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long")


def many_capitals(text: Column, words: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long")


def markup_signs(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: What a text fails a filter by, by the filter's letter; a filter gets the text and its words.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": markup_signs}
#: Letter of the filter that removes texts of a smaller id.
TWIN = "E"

ROWS = "edge boolean, doc_id {kind}, part string, mask int, slot int, run int, low long, high long, text string"


def predecessors(twin_bit: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares each row of a sorted partition with the one before it.

    A row of the same text as its predecessor, with another id than the first
    of that text, fails. What can't be known here is left to edges(): rows that
    are the first of their text within the partition's first fingerprint carry
    the number of their text as `run`, and one edge row for each text of the
    first and of the last fingerprint tells its smallest id here.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edge, ids, part, mask, slot, runs, low, high, text):
            cols = [pa.array(edge, pa.bool_()), ids, part, mask, slot, runs, low, high, text]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def edge(items, low: int, high: int, slot: int):
            """Edge rows of (run, text, smallest id)."""
            n = len(items)
            none = pa.nulls(n)
            return out([True] * n, pa.array([i for _, _, i in items], schema.field("doc_id").type), none, none, pa.array([slot] * n, pa.int32()), pa.array([r for r, _, _ in items], pa.int32()), pa.array([low] * n), pa.array([high] * n), pa.array([t for _, t, _ in items], pa.string()))

        last = None  # the row before: its fingerprint, text, and the first id of that text
        opening = True  # within the partition's first fingerprint
        runs = 0
        tail: list = []  # texts of the present fingerprint, each with its first id
        slot = 0
        for b in source:
            if not b.num_rows:
                continue
            n, slot = b.num_rows, b.column("slot")[0].as_py()
            low, high = b.column("low").to_numpy(zero_copy_only=False), b.column("high").to_numpy(zero_copy_only=False)
            text, ids = b.column("text"), b.column("doc_id")
            print_new, text_new = np.ones(n, bool), np.ones(n, bool)
            print_new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            text_new[1:] = print_new[1:]
            if n > 1:
                text_new[1:] |= pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if last is not None:
                print_new[0] = (int(low[0]), int(high[0])) != last[0]
                text_new[0] = bool(print_new[0]) or text[0].as_py() != last[1]
            starts = np.flatnonzero(text_new)
            # the first id of each row's text; place 0 is that of the row before this batch
            firsts = pa.concat_arrays([pa.array([last[2] if last else None], ids.type), ids.take(pa.array(starts))])
            own = firsts.take(pa.array(np.cumsum(text_new)))
            fails = pc.fill_null(pc.not_equal(ids, own), False).to_numpy(zero_copy_only=False)
            # of each new text: is it still within the first fingerprint?
            number = np.full(n, -1, np.int64)
            stop = n if opening else 0
            if opening:
                later = np.flatnonzero(print_new[1:] if last is None else print_new)
                if len(later):
                    stop = int(later[0]) + (last is None)
            items = []
            for k in starts[starts < stop].tolist():
                items.append((runs, text[k].as_py(), ids[k].as_py()))
                runs += 1
            if stop:
                number[:stop] = runs - len(items) - 1 + np.cumsum(text_new[:stop])
                number[:stop][fails[:stop]] = -1
            if items:
                yield edge(items, int(low[0]), int(high[0]), slot)
            opening = opening and stop == n
            newest = int(np.flatnonzero(print_new)[-1]) if print_new.any() else -1
            if newest >= 0:
                tail = []
            tail += [(None, text[k].as_py(), ids[k].as_py()) for k in starts[starts >= max(newest, 0)].tolist()]
            last = ((int(low[-1]), int(high[-1])), text[n - 1].as_py(), own[n - 1].as_py())
            none = pa.nulls(n)
            mask = pc.add(b.column("mask"), pa.array(np.where(fails, twin_bit, 0).astype(np.int32)))
            yield out([False] * n, ids, b.column("part"), mask, b.column("slot"), pa.array(number, mask=number < 0).cast(pa.int32()), none, none, none)
        if last is not None and not opening:
            yield edge(tail, *last[0], slot)

    return run


def masks(docs: DataFrame, conditions: dict = CONDITIONS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: bit k of the mask stands for the k-th condition, the highest bit for a text that a smaller id has too.

    Rows are range-sorted by a 128-bit fingerprint of the text, the text and
    the id, so a large group of copies spreads over as many partitions as its
    rows need; each row is compared with the one before it, and the borders of
    partitions by a table with a row or two for each. A null text counts as
    empty, a null part as the empty one. A row without an id has no smaller one
    and is no smaller one; rows that repeat an id and a text fail alike. Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    # the place in the table comes last, so rows that repeat in all else can be dealt to several tasks
    keyed = src.withColumns({"low": F.xxhash64("text"), "high": F.xxhash64(F.lit(11), "text"), "place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange("low", "high", F.col("doc_id").asc_nulls_last(), "place").sortWithinPartitions("low", "high", "text", F.col("doc_id").asc_nulls_last())
    words = dealt.withColumn("words", F.array_remove(F.split("text", GAPS), ""))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(conditions.values())), F.lit(0))
    judged = words.select("doc_id", "part", "text", "low", "high", F.spark_partition_id().alias("slot"), mask.cast("int").alias("mask"))
    ddl = ROWS.format(kind=kind)
    arrow = arrow_schema(ddl)
    rows = held(judged.mapInArrow(predecessors(1 << len(conditions), arrow), ddl), "masks")
    edges = rows.where("edge")
    least = edges.groupBy("low", "high", "text").agg(F.min("doc_id").alias("least"))
    late = edges.where("run is not null").join(least, ["low", "high", "text"]).where("least < doc_id").select("slot", "run", F.lit(1 << len(conditions)).alias("more"))
    # a row for each partition at most, and for each text that shares another one's fingerprint
    return rows.where("not edge").join(F.broadcast(late), ["slot", "run"], "left").select("doc_id", "part", (F.col("mask") + F.coalesce("more", F.lit(0))).alias("mask"))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def counters(marks: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, docs, good, toxic): rows with each mask in each part, and how many of them have a label quality=1 or toxic=1 in any row of labels.

    Counters of any two sets of rows add up. Labels without an id, and ids
    without a document, count nothing.
    """
    docs = marks.groupBy("part", "mask").agg(F.count("*").alias("docs")).withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    if labels is None:
        return docs
    flags = labels.groupBy(F.col(f"`{id_col}`").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    flags = flags.select("labelled", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).where("good + toxic > 0")
    more = marks.join(flags, F.col("doc_id") == F.col("labelled")).groupBy("part", "mask").agg(F.lit(0).cast("long").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return docs.unionByName(more).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic")))


def orders(spark: SparkSession, letters: Sequence[str]) -> DataFrame:
    """(mask, filter_order, step, ...): what becomes of documents of each mask at each step of each order. Its size depends on the number of filters only."""
    n = len(letters)
    rows = []
    for order in permutations(range(n)):
        name, before = "".join(letters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            bit = 1 << k
            for mask in range(1 << n):
                fails, earlier = bool(mask & bit), bool(mask & before)
                # an order's first filter that a document fails removes it; each of its filters is first in an equal share of all orders
                weight = factorial(n) // mask.bit_count() if fails else 0
                rows.append((mask, name, step, int(not fails and not earlier), int(fails and not earlier), int(fails and earlier), int(mask == bit), weight))
            before |= bit
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, weight long")


def audit(docs: DataFrame, labels: DataFrame | None = None, conditions: dict = CONDITIONS, twin: str = TWIN, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, every order of all filters and every step of it.

    Each document fails a set of filters, whatever the order; so documents are
    counted once by part and set, and all orders are computed from these
    counters. An empty table has no parts and gives no rows; see masks() and
    counters() for nulls and repeated rows.
    """
    sums = counters(masks(docs, conditions, id_col, text_col, part_col), labels, id_col)
    each = sums.join(F.broadcast(orders(docs.sparkSession, [*conditions, twin])), "mask")
    total = {c: F.sum(F.col("docs") * F.col(c)) for c in ("kept", "removed", "redundant", "unique_fails")}
    total |= {"good_lost": F.sum(F.col("good") * F.col("removed")), "toxic_lost": F.sum(F.col("toxic") * F.col("removed")), "shapley": F.sum(F.col("docs") * F.col("weight"))}
    return each.groupBy("part", "filter_order", "step").agg(*(v.alias(c) for c, v in total.items()))
