"""Operator 5: substring dedup over content-defined chunks of a gear rolling hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.llm.batches import text_keys
from weftline.session import held

#: A cut is the least gear hash among so many bytes on either side, so chunks have 49 bytes on average and 25 at least.
REACH = 24
#: Bytes that the gear hash remembers.
MEMORY = 16
#: Bytes of neighbouring shared chunks from which a passage counts as shared.
LEAST = 80
#: Size of a chunk beside its start in one number.
SHIFT = 31
MASK = (1 << SHIFT) - 1


def gear() -> np.ndarray:
    """A pseudo-random number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=49) for b in range(256)], np.uint32)


GEAR = gear()


def cuts(raw: list[bytes]) -> list[np.ndarray]:
    """Where each text is cut (byte after the cut), by content alone.

    The gear hash of a place depends on the MEMORY bytes that end there. A
    place is a cut if its hash is the least within REACH places before and
    after it and a character ends there. So the cuts of a passage, but for its
    first REACH + MEMORY and its last REACH bytes, are the same wherever it
    stands. Where equal hashes stand within REACH of one another, as in text
    that repeats with a short period, those more than REACH apart are cuts:
    whole periods, so the chunks of such a stretch are equal too.
    """
    gap = b"\0" * (MEMORY + REACH)
    begin = np.cumsum([len(gap), *(len(r) + len(gap) for r in raw)])[:-1]
    flat = np.frombuffer(gap + gap.join(raw) + gap, np.uint8) if raw else np.empty(0, np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    inside = np.zeros(len(flat) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + sizes, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    h = np.where(inside, GEAR[flat], np.uint32(0))
    for k in (1, 2, 4, 8):  # h of 2k bytes from those of k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    most = np.uint32(0xFFFFFFFF)
    follows = np.ones(len(flat), bool)
    follows[:-1] = (flat[1:] & 0xC0) != 0x80
    h = np.where(inside & follows, h >> np.uint32(1), most)
    m = h
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    m = np.minimum(m[:-8], m[8:])  # m[i]: least of h[i : i + REACH]
    n = len(h) - 2 * REACH
    mid = h[REACH : REACH + n]
    hit = np.flatnonzero((mid < most) & (mid <= m[:n]) & (mid <= m[REACH + 1 : REACH + 1 + n])) + REACH if n > 0 else np.empty(0, np.int64)
    hit = spaced(hit)
    own = np.searchsorted(begin, hit, side="right") - 1
    at = hit + 1 - begin[own] if len(begin) else hit
    real = at < sizes[own] if len(begin) else np.zeros(0, bool)
    own, at = own[real], at[real]
    return np.split(at, np.cumsum(np.bincount(own, minlength=len(raw)))[:-1]) if raw else []


def spaced(at: np.ndarray) -> np.ndarray:
    """Of places, those that stand more than REACH after the last one that is kept, in each run of places at most REACH apart."""
    near = np.flatnonzero(np.diff(at) <= REACH) + 1
    if not len(near):
        return at
    keep, places, last = np.ones(len(at), bool), at.tolist(), -1
    for k in near.tolist():
        if keep[k - 1]:
            last = places[k - 1]
        if places[k] - last <= REACH:
            keep[k] = False
    return at[keep]


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_low, text_high, low, high, place) of every chunk of every text: the 128-bit digest of the chunk, and its start and size in bytes as one number. Null and empty texts and null ids have none."""
    kind = df.schema[id_col].dataType.simpleString()
    own = ["doc_id", "text_low", "text_high"]
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *text_keys(text_col)).where("doc_id is not null and text is not null and text <> ''")

    def make():
        batches.only("passages")
        digest = xxhash.xxh3_128_digest

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode() for t in part.column("text").to_pylist()]
            digests, starts, sizes, count = [], [], [], []
            for r, c in zip(raw, cuts(raw), strict=True):
                edge = [0, *c.tolist(), len(r)]
                view = memoryview(r)
                digests += [digest(view[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
                starts.append(np.array(edge[:-1]))
                sizes.append(np.diff(edge))
                count.append(len(edge) - 1)
            place = (np.concatenate(starts) << SHIFT | np.concatenate(sizes)) if raw else np.empty(0, np.int64)
            owner = pa.array(np.repeat(np.arange(len(raw)), count))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([*(part.column(c).take(owner) for c in own), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(place)], [*own, "low", "high", "place"])

        return step

    return batches.map_steps(src, make, f"doc_id {kind}, text_low bigint, text_high bigint, low bigint, high bigint, place bigint")


def shared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, text_low, text_high, first_doc, n_passages, shared_bytes, removed_bytes, removed) of every document that shares a passage with another.

    A document is an id and a text (told by text_keys()), so rows that repeat
    both count as one and rows that repeat an id with other texts as several.
    A passage is a stretch of neighbouring chunks, `least` bytes long at
    least, that all stand in other documents too. The document with the
    smallest id (then the smallest text_low, text_high) keeps a chunk; others
    list it in removed, as spans of bytes of their text. first_doc is the
    smallest id that holds part of the passages. Copies within one document
    are left. Rows with a null id or a null or empty text give none; other
    columns are not read.
    """
    rows = chunks(df, id_col, text_col)
    who = F.struct("doc_id", "text_low", "text_high")
    known = rows.groupBy("low", "high").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("first < last").select("low", "high", "first")
    known = held(known, "shared")  # a table of its own, so that the join can split a chunk that very many documents hold
    found = rows.join(known, ["low", "high"]).select("doc_id", "text_low", "text_high", F.struct("place", F.col("first.doc_id").alias("first"), (F.col("first") == who).alias("keeps")).alias("chunk"))
    mine = found.groupBy("doc_id", "text_low", "text_high").agg(F.collect_set("chunk").alias("held"))
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    names = ["doc_id", "text_low", "text_high", "first_doc", "n_passages", "shared_bytes", "removed_bytes", "removed"]

    def run(parts):
        for part in parts:
            out = []
            for k, held in enumerate(part.column("held").to_pylist()):
                own = merged([(h["place"] >> SHIFT, h["place"] & MASK, h["first"], h["keeps"]) for h in held], least)
                if own:
                    out.append((k, *own))
            which, first, *counts, removed = zip(*out, strict=True) if out else [()] * 6
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(take) for c in names[:3]), pa.array(first, part.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in counts), pa.array([[{"begin": a, "end": b} for a, b in c] for c in removed], pa.list_(span))],
                names,
            )

    out = mine.mapInArrow(run, f"doc_id {kind}, text_low bigint, text_high bigint, first_doc {kind}, n_passages bigint, shared_bytes bigint, removed_bytes bigint, removed array<struct<begin: bigint, `end`: bigint>>")
    return out.withColumnRenamed("doc_id", id_col)


def merged(held: list[tuple], least: int) -> tuple | None:
    """Passages of one document from its shared chunks (start, size, first document, whether this document keeps it): smallest first document, passages, their bytes, bytes that go, spans that go."""
    held = sorted(held)
    runs: list[list[tuple]] = []
    for h in held:
        if runs and runs[-1][-1][0] + runs[-1][-1][1] == h[0]:
            runs[-1].append(h)
        else:
            runs.append([h])
    runs = [r for r in runs if sum(h[1] for h in r) >= least]
    if not runs:
        return None
    flat = [h for r in runs for h in r]
    gone: list[list[int]] = []
    for start, size, _, keeps in flat:
        if not keeps:
            if gone and gone[-1][1] == start:
                gone[-1][1] += size
            else:
                gone.append([start, start + size])
    return min(h[2] for h in flat), len(runs), sum(h[1] for h in flat), sum(b - a for a, b in gone), gone


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """df with the removed spans of shared() cut out of the texts.

    A document of which only white space is left goes; one that lost nothing
    stays as it is, null and empty texts and null ids included. Rows that
    repeat an id are cut each by its own text; repeated rows stay repeated.
    Columns of any other name are carried along.
    """
    doc, low, high, gone = batches.fresh(df, "doc", "low", "high", "gone")
    found = shared(df, id_col, text_col, least).where("removed_bytes > 0")
    found = found.select(F.col(f"`{id_col}`").alias(doc), F.col("text_low").alias(low), F.col("text_high").alias(high), F.col("removed").alias(gone))

    @F.pandas_udf("string")
    def cut(text, spans):
        out = text.copy()
        for k in np.flatnonzero(spans.notna()):
            raw, at, parts = text.iloc[k].encode(), 0, []
            for s in spans.iloc[k]:
                parts.append(raw[at : s["begin"]])
                at = s["end"]
            out.iloc[k] = b"".join([*parts, raw[at:]]).decode(errors="replace")
        return out

    text, (text_low, text_high) = F.col(f"`{text_col}`"), text_keys(text_col)
    joined = df.join(found, (F.col(f"`{id_col}`") == F.col(doc)) & (text_low == F.col(low)) & (text_high == F.col(high)), "left")
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(cut(text, gone))).where(F.col(gone).isNull() | text.rlike(r"[^ \t\r\n]")).drop(doc, low, high, gone)
