"""Operator 13: vector codes by product quantisation, with Lloyd rounds that keep two distance bounds for each part."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.session import discard, held

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are clamped to this, so that all distances and their sums stay exact in 64 bits.
LIMIT = 1 << 27
#: Rows of a step: as many distances as entries for each are held at a time.
STEP = 2048
#: What rounding can change a bound by, relatively.
SLACK = 1e-9


def whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the usable rows, with v as integers, and the width of a part.

    Rows whose vector is null, empty, or holds null or non-finite components
    are dropped, and so are those of another length than most have (ties: the
    longest). A length that parts don't divide is filled up with zeros.
    """
    x = F.col(f"`{vec_col}`")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), x.cast("array<double>").alias("x"))
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = sizes.n if sizes else parts
    width = -(-size // parts)
    near = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * scale))).cast("int"))
    filled = F.concat(near, F.array_repeat(F.lit(0), parts * width - size)) if parts * width > size else near
    return rows.where(F.size("x") == size).select("vec_id", "label", filled.alias("v")), width


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, all integers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 1 << 53:  # every product and sum is a whole number that floats hold
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - book[None]) ** 2).sum(2)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full scan: the nearest entry (ties: the lower index), its squared distance and that of the second-nearest, which is as near where two tie."""
    nearest, first, second = (np.empty(len(x), np.int64) for _ in range(3))
    for a in range(0, len(x), STEP):
        d = distances(x[a : a + STEP], book)
        k = d.argmin(1)
        row = np.arange(len(d))
        nearest[a : a + STEP], first[a : a + STEP] = k, d[row, k]
        if len(book) > 1:
            d[row, k] = np.iinfo(np.int64).max
            second[a : a + STEP] = d.min(1)
        else:
            second[a : a + STEP] = np.iinfo(np.int64).max
    return nearest, first, second


@dataclass
class Books:
    """The codebooks of all parts, and how far entries moved in the last round: each one's own way, and the longest way of any other."""

    entries: np.ndarray  # (parts, entries, width)
    moved: np.ndarray  # (parts, entries)
    others: np.ndarray  # (parts, entries)
    #: Half the distance from each entry to the nearest other one: whoever is nearer than that has found its nearest.
    half: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Books:
        parts, n, _ = entries.shape
        moved = np.zeros((parts, n)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        others, half = np.zeros((parts, n)), np.full((parts, n), np.inf)
        for p in range(parts if n else 0):
            order = np.argsort(-moved[p], kind="stable")
            others[p] = moved[p, order[0]]
            if n > 1:
                others[p, order[0]] = moved[p, order[1]]
                d = np.stack([distances(e[None], entries[p])[0] for e in entries[p]]).astype(np.float64)
                np.fill_diagonal(d, np.inf)
                half[p] = np.sqrt(d.min(1)) / 2 * (1 - SLACK)
        return Books(entries, moved, others, half)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, others: np.ndarray, half: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New codes and bounds of one part, and how many rows were scanned in full.

    upper bounds the distance to a row's own entry, lower that to any other.
    The bounds follow the entries' moves; only where the own entry isn't surely
    the nearest one, strictly, even by its exact distance, are all entries
    looked at. So a tie is always scanned, and its lower index wins.
    """
    upper = (upper + moved[code]) * (1 + SLACK)
    lower = np.maximum((lower - others[code]) - SLACK * np.abs(lower), 0)
    safe = np.maximum(lower, half[code])
    open_ = np.flatnonzero(~(upper < safe))
    if len(open_):
        own = np.sqrt(((x[open_] - book[code[open_]]).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        upper[open_] = own
        open_ = open_[~(own < safe[open_])]
    code = code.copy()
    if len(open_):
        nearest, first, second = scan(x[open_], book)
        code[open_] = nearest
        upper[open_] = np.sqrt(first.astype(np.float64)) * (1 + SLACK)
        lower[open_] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
    return code, upper, lower, len(open_)


def fixed(array: pa.Array, width: int) -> np.ndarray:
    """Rows of lists of one length as a matrix."""
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def assigned(rows: DataFrame, books: Books) -> DataFrame:
    """rows with new codes, bounds, and in each row the number of its parts that were scanned in full."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x width integers, whatever the table
    parts, _, width = books.entries.shape

    def run(source):
        batches.only("vector codes")
        own = shared.value
        for b in source:
            if not b.num_rows:
                continue
            v = fixed(b.column("v"), parts * width).astype(np.int64)
            if "code" in b.schema.names:
                code, upper, lower = fixed(b.column("code"), parts).astype(np.int64), fixed(b.column("upper"), parts), fixed(b.column("lower"), parts)
            else:  # nothing is known: every row is scanned
                code, upper, lower = np.zeros((len(v), parts), np.int64), np.full((len(v), parts), np.inf), np.zeros((len(v), parts))
            done = [assign(v[:, p * width : (p + 1) * width], own.entries[p], own.moved[p], own.others[p], own.half[p], code[:, p], upper[:, p], lower[:, p]) for p in range(parts)]
            code, upper, lower = (np.stack([d[k] for d in done], 1) for k in range(3))
            scans = np.zeros(len(v), np.int64)
            scans[0] = sum(d[3] for d in done)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), b.column("v"), listed(code, pa.int16()), listed(upper, pa.float64()), listed(lower, pa.float64()), pa.array(scans)],
                ["vec_id", "label", "v", "code", "upper", "lower", "scans"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, code array<smallint>, upper array<double>, lower array<double>, scans long")


def sums(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(place, n, s0, s1, ...): number and component sums of the parts that each entry was given, place = part * entries + entry. A task sends parts x entries rows at most."""

    def run(source):
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in source:
            v, place = fixed(b.column("v"), parts * width).astype(np.int64), fixed(b.column("code"), parts) + np.arange(parts) * entries
            for p in range(parts):
                order = np.argsort(place[:, p], kind="stable")
                at, first = np.unique(place[order, p], return_index=True)
                if len(at):
                    total[at] += np.add.reduceat(v[order, p * width : (p + 1) * width], first, axis=0)
                    count[at] += np.diff(np.append(first, len(order)))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, k]) for k in range(width))], ["place", "n", *(f"s{k}" for k in range(width))])

    names = ["n", *(f"s{k}" for k in range(width))]
    partial = rows.select("v", "code").mapInArrow(run, ", ".join(f"{c} long" for c in ["place", *names]))
    return partial.groupBy("place").agg(*(F.sum(c).alias(c) for c in names))


def moved_to(books: Books, rows: DataFrame) -> Books:
    """Each entry at the floor of the mean of its parts; entries without any stay."""
    parts, n, width = books.entries.shape
    new = books.entries.reshape(parts * n, width).copy()
    for r in sums(rows, parts, n, width).collect():  # parts x entries rows at most
        new[r.place] = np.array(r[2:], np.int64) // r.n
    return Books.of(new.reshape(books.entries.shape), books.entries)


def digest(books: Books) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and place, with commas between them."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books, list[int]]:
    """Rows (vec_id, label, v, code, upper, lower, scans) with their final codes, the final codebooks, and the full scans of each pass.

    Codebooks start as the rows with the smallest ids (fewer, if there aren't
    as many; rows that repeat an id in the order of their vectors; null ids
    last). Between rounds the rows with their codes and bounds are a table in
    the shared folder, and the table of the round before goes, so two of them
    exist at most. Only entries, and sums by entry, reach the driver. An empty
    table has no entries and gives no rows.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits")
    usable, width = whole(vectors, id_col, vec_col, label_col, parts, scale)
    rows = held(usable, "vectors")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = np.array([r.v for r in start], np.int64).reshape(len(start), parts, width)
    books = Books.of(np.ascontiguousarray(first.transpose(1, 0, 2)))
    if not start:
        empty = rows.selectExpr("*", "cast(null as array<smallint>) code", "cast(null as array<double>) upper", "cast(null as array<double>) lower", "0L scans")
        return empty, books, []
    scans = []
    for k in range(rounds + 1):
        new = held(assigned(rows, books), "codes")
        discard(rows)
        rows = new
        scans.append(rows.agg(F.sum("scans")).first()[0])
        if k < rounds:
            books = moved_to(books, rows)
    return rows, books, scans


def errors(rows: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error): code as two hex digits for each part, error the sum of the squared distances to the final entries."""
    shared = rows.sparkSession.sparkContext.broadcast(books.entries)
    parts, _, width = books.entries.shape

    def run(source):
        book = shared.value
        for b in source:
            v, code = fixed(b.column("v"), parts * width).astype(np.int64), fixed(b.column("code"), parts)
            far = sum(((v[:, p * width : (p + 1) * width] - book[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            text = code.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(far)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row; label_error sums the error of all rows with an equal label, nulls together. Rows that repeat each give a row; see compress() and whole() for the rest."""
    rows, books, _ = compress(vectors, id_col, vec_col, label_col, **how)
    each = errors(rows, books)
    by_label = each.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    out = each.join(by_label, F.col("label").eqNullSafe(F.col("own")))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
