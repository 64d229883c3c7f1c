"""Operator 8: benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.llm.batches import text_keys

#: Bytes of a q-gram, of a window of a benchmark item and between windows.
Q, WINDOW, STRIDE = 12, 64, 16
#: Edits that a region may hold, as a share of its window.
EDITS = 0.05
#: Shorter items (in normalised bytes) are searched as whole words in a row, without edits.
EXACT = 40
#: Benchmark text (bytes) that one pass holds in memory; a larger benchmark takes more passes.
BLOCK = 4 << 20
#: Bits of the table that rules out most q-grams.
TABLE = 22
#: Candidate regions that are aligned at once.
ALIGN = 4096
#: Bytes of text whose q-grams are looked up at once, and hits that are counted at once.
SLICE, HITS = 1 << 18, 1 << 18
#: Factor of the hash of short items.
BASE = np.uint64(0x9E3779B97F4A7C15)


def shape() -> np.ndarray:
    """What each byte counts as: letters lower-cased, other ASCII marks a space."""
    t = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        t[b] = ord(c.lower()) if c.isalnum() else 32
    return t


SHAPE = shape()


def normal(flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with case, marks and runs of spaces levelled, and the place of each in flat. begin: where texts begin; a space stands between them."""
    out = SHAPE[flat]
    high = np.flatnonzero(flat[:-1] == 0xC3) + 1  # two-byte letters from À to Þ
    up = high[(flat[high] >= 0x80) & (flat[high] <= 0x9E) & (flat[high] != 0x97)]
    out[up] += 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[begin] = True
    place = np.flatnonzero(keep)
    return out[place], place


def grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes that begin at each place."""
    x = b.astype(np.uint64)
    x2 = x[:-1] | x[1:] << np.uint64(8)
    x4 = x2[:-2] | x2[2:] << np.uint64(16)
    a, c = x4[:-8] | x4[4:-4] << np.uint64(32), x4[8:]
    return a * np.uint64(0x9E3779B97F4A7C15) ^ (c + np.uint64(0x632BE59B)) * np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Index:
    """Distinct windows of benchmark items, where their q-grams stand and which items hold them; short items by their size and hash."""

    text: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    window: np.ndarray
    place: np.ndarray
    #: The rows by key and window, as one ascending number.
    order: np.ndarray
    table: np.ndarray
    items: list[list[int]]
    short: dict[int, dict[int, list[tuple[bytes, list[int]]]]]

    @property
    def reach(self) -> int:
        return int(self.edits.max()) + 1 if len(self.edits) else 1


def slot(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(29)) >> np.uint64(64 - TABLE)


def levelled(text: str | None) -> np.ndarray:
    """Normalised bytes of an item, without spaces at its ends."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return raw
    b, _ = normal(raw, np.zeros(1, np.int64))
    return np.frombuffer(b.tobytes().strip(b" "), np.uint8)


def hashed(b: np.ndarray) -> int:
    return int((b.astype(np.uint64) * power(len(b))).sum(dtype=np.uint64)) if len(b) else 0


def power(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))


def build(items: list[tuple[int, str]]) -> Index:
    """Index of items; those that are null or without a letter or digit have no window."""
    rows: dict[bytes, list[int]] = {}
    short: dict[int, dict[int, list[tuple[bytes, list[int]]]]] = {}
    for i, text in items:
        b = levelled(text)
        if 0 < len(b) < EXACT:
            same = short.setdefault(len(b), {}).setdefault(hashed(b), [])
            own = next((own for raw, own in same if raw == b.tobytes()), None)
            if own is None:
                same.append((b.tobytes(), own := []))
            own.append(i)
        elif len(b):
            last = max(len(b) - WINDOW, 0)
            for at in sorted({*range(0, last + 1, STRIDE), last}):
                own = rows.setdefault(b[at : at + WINDOW].tobytes(), [])
                if not own or own[-1] != i:
                    own.append(i)
    size = np.array([len(r) for r in rows], np.int64)
    text = np.full((len(rows), WINDOW), 256, np.int16)
    keys, window, place = [], [], []
    for k, r in enumerate(rows):
        own = np.frombuffer(r, np.uint8)
        text[k, : len(r)] = own
        keys.append(grams(own))
        window.append(np.full(len(r) - Q + 1, k, np.int64))
        place.append(np.arange(len(r) - Q + 1))
    edits = (size * EDITS).astype(np.int64)
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    unique, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << TABLE, bool)
    table[slot(unique)] = True
    window, place = (np.concatenate(x)[order] if x else np.empty(0, np.int64) for x in (window, place))
    first = np.append(first, len(flat))
    by_window = np.repeat(np.arange(len(unique)), np.diff(first)) * len(size) + window
    return Index(text, size, edits, size - Q + 1 - Q * edits, unique, first, window, place, by_window, table, list(rows.values()), short)


def align(index: Index, window: np.ndarray, low: np.ndarray, width: int, text: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window against the text between begin and stop, along diagonals low to low + width - 1, and the diagonal where it ends."""
    k = np.arange(width)
    cost = np.zeros((len(window), width), np.int32)
    begin, stop = begin[:, None], stop[:, None]
    for i in range(WINDOW):
        at = low[:, None] + k + i
        inside = (at >= begin) & (at < stop)
        seen = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 255)
        step = cost + (seen != index.text[window, i][:, None])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        step = np.minimum.accumulate(step - k, axis=1) + k
        live = index.size[window] > i
        cost = np.where(live[:, None], step, cost)
    end = cost.argmin(1)
    best = cost[np.arange(len(window)), end]
    return best, low + end


def candidates(index: Index, level: np.ndarray, edge: np.ndarray):
    """(text, window, band, votes) of every band of diagonals that holds as many different q-grams of a window as the lemma asks for, in parts.

    Band b holds diagonals b * reach to (b + 2) * reach - 1, so any reach
    neighbouring ones share a band. Its hits stand within a short stretch of
    text: a slice of text counts the bands that begin in it, from the hits in
    it and shortly behind, cut in halves (of the text, then of the windows)
    until its hits are few enough to hold. None is left out.
    """
    s, order, n = index.reach, index.order, len(index.size)
    beyond = 2 * s + WINDOW
    lead = -(-WINDOW // s) * s
    for p in range(-lead, len(level), SLICE // s * s):
        stop = p + SLICE // s * s
        a = max(p, 0)
        h = grams(level[a : stop + beyond + Q]) if len(level) - a >= Q else np.empty(0, np.uint64)
        at = np.flatnonzero(index.table[slot(h)])
        key = np.searchsorted(index.keys, h[at])
        key[key == len(index.keys)] = 0
        real = index.keys[key] == h[at]
        at, key = at[real] + a, key[real]
        todo = [(p, stop, 0, n)] if len(at) else []
        while todo:
            p0, p1, w0, w1 = todo.pop()
            x, y = np.searchsorted(at, [p0, p1 + beyond])
            if x == y:
                continue
            first, last = np.searchsorted(order, key[x:y] * n + w0), np.searchsorted(order, key[x:y] * n + w1)
            count = last - first
            own0, own1 = np.searchsorted(edge, at[[x, y - 1]], side="right") - 1
            bands, windows = (p1 - p0) // s, w1 - w0
            if count.sum() > HITS or float(own1 - own0 + 1) * bands * windows * WINDOW > 2.0**62:
                if bands > 1:
                    mid = p0 + bands // 2 * s
                    todo += [(mid, p1, w0, w1), (p0, mid, w0, w1)]
                    continue
                if windows > 1:
                    mid = (w0 + w1) // 2
                    todo += [(p0, p1, mid, w1), (p0, p1, w0, mid)]
                    continue
            row = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            where, place, window = np.repeat(at[x:y], count), index.place[row], index.window[row] - w0
            own = np.searchsorted(edge, where, side="right") - 1 - own0
            # every hit votes for the two overlapping bands that hold its diagonal; text, band, window and place as one number
            band = (where - place) // s - p0 // s
            votes = []
            for b in (band, band - 1):
                mine = (b >= 0) & (b < bands)
                votes.append((((own[mine] * bands + b[mine]) * windows + window[mine]) * WINDOW) + place[mine])
            votes = np.sort(np.concatenate(votes))
            new = np.ones(len(votes), bool)
            new[1:] = votes[1:] != votes[:-1]
            votes = votes[new] // WINDOW
            start = np.flatnonzero(np.diff(votes, prepend=-1))
            group, votes = votes[start], np.diff(np.append(start, len(votes)))
            window, rest = group % windows + w0, group // windows
            good = votes >= index.bound[window]
            if good.any():
                yield np.stack([rest // bands + own0, window, rest % bands + p0 // s], 1)[good], votes[good]


def phrases(index: Index, level: np.ndarray, edge: np.ndarray):
    """(text, item, first byte, last byte) of every place where the words of a short item stand in a row."""
    if not index.short:
        return
    space = level == 32
    before = np.ones(len(level), bool)
    before[1:] = space[:-1]
    before[edge[edge < len(level)]] = True
    head = np.flatnonzero(before & ~space)
    for a in range(0, len(head), SLICE):
        part = head[a : a + SLICE]
        low, stop = int(part[0]), min(len(level), int(part[-1]) + max(index.short))
        own = np.searchsorted(edge, part, side="right") - 1
        limit = np.append(edge, len(level))[own + 1]
        h, grown = np.zeros(len(part), np.uint64), 0
        times = power(max(index.short))
        for size, known in sorted(index.short.items()):
            while grown < size:  # one more byte of each phrase
                h += level[np.minimum(part + grown, stop - 1)].astype(np.uint64) * times[grown]
                grown += 1
            end = part + size
            whole = (end <= limit) & ((end == limit) | space[np.minimum(end, len(level) - 1)])
            hit = np.flatnonzero(whole & np.isin(h, np.fromiter(known, np.uint64, len(known))))
            for k in hit.tolist():
                at = int(part[k])
                raw = level[at : at + size].tobytes()
                for phrase, items in known[int(h[k])]:
                    if phrase == raw:
                        yield from ((int(own[k]), i, at, at + size - 1) for i in items)


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, item, begin, end, edits, q-grams, windows) of each text and each item of which it holds verified regions, in bytes of the text: where the first begins and the last ends, the fewest edits, the most shared q-grams, and their number."""
    raw = [(t or "").encode() for t in texts]
    if not raw:
        return []
    flat = np.frombuffer(b" ".join(raw) + b" " * (Q + 1), np.uint8)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    level, source = normal(flat, begin)
    edge = np.searchsorted(source, begin)
    out: dict[tuple[int, int], list[int]] = {}

    def add(o: int, item: int, head: int, tail: int, edits: int, votes: int) -> None:
        head, tail = max(0, int(source[head]) - int(begin[o])), min(int(source[tail]) + 1 - int(begin[o]), len(raw[o]))
        own = out.get((o, item))
        if own is None:
            out[o, item] = [head, tail, edits, votes, 1]
        else:
            own[:] = min(own[0], head), max(own[1], tail), min(own[2], edits), max(own[3], votes), own[4] + 1

    for o, item, head, tail in phrases(index, level, edge):
        add(o, item, head, tail, 0, max(tail + 2 - head - Q, 0))
    if len(index.keys):
        limit = np.append(edge, len(level))
        for cand, votes in candidates(index, level, edge):
            for a in range(0, len(cand), ALIGN):
                own, window, band = cand[a : a + ALIGN].T
                low = band * index.reach
                edits, end = align(index, window, low, 2 * index.reach, level, limit[own], limit[own + 1])
                last = np.clip(end + index.size[window] - 1, limit[own], limit[own + 1] - 1)
                head = np.maximum(end - edits, limit[own])
                for k in np.flatnonzero(edits <= index.edits[window]).tolist():
                    for item in index.items[window[k]]:
                        add(int(own[k]), item, int(head[k]), int(last[k]), int(edits[k]), int(votes[a + k]))
    return [(*key, *own) for key, own in sorted(out.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in blocks of bounded text; they stream to the driver, one block at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        if held and size + len(r["t"]) * 2 > BLOCK:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"]) * 2
    if held:
        yield held


def regions(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_low, text_high, item_id, begin, end, edits, grams, windows): for each document and each item that it holds, the stretch of its text (bytes).

    A region is a stretch that a window of WINDOW normalised bytes of an item
    (all of it, if shorter) matches within EDITS of its length. It is found if
    a band of diagonals holds as many shared q-grams as the q-gram lemma asks
    for, and kept if banded alignment verifies it. Windows begin every STRIDE
    bytes, so any quote of WINDOW + STRIDE - 1 bytes holds one. Of an item
    shorter than EXACT a region is all its words in a row, without edits, so
    an item of one common word is found in every text that has it.

    A document is an id and a text, told by 128 bits of hash (text_low,
    text_high); repeated rows give the row once, a null id is a value like
    others. Documents without a region give no row, nor do null or empty
    texts and items that are null or without a letter or digit. item_id is a
    whole number. Texts are searched whole; only the benchmark is held in
    memory, in blocks of BLOCK bytes, and hits in slices of HITS.
    """
    kind = df.schema[id_col].dataType.simpleString()
    key = ["doc_id", "text_low", "text_high"]
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *text_keys(text_col))
    schema = f"doc_id {kind}, text_low bigint, text_high bigint, item_id bigint, `begin` bigint, `end` bigint, edits int, grams int, windows bigint"
    found = df.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, item_col, item_text):
        held = df.sparkSession.sparkContext.broadcast(items)

        def make(held=held):
            batches.only("bench_leaks")
            index = build(held.value)

            def step(part: pa.RecordBatch) -> pa.RecordBatch:
                rows = search(index, part.column("text").to_pylist())
                which, item, begin, end, edits, votes, windows = zip(*rows, strict=True) if rows else [()] * 7
                take = pa.array(which, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in key), *(pa.array(x, pa.int64()) for x in (item, begin, end)), *(pa.array(x, pa.int32()) for x in (edits, votes)), pa.array(windows, pa.int64())],
                    [*key, "item_id", "begin", "end", "edits", "grams", "windows"],
                )

            return step

        found = found.unionByName(batches.map_steps(src, make, schema))
    # a repeated row has the same of all
    once = [f(c).alias(c) for f, c in ((F.min, "begin"), (F.max, "end"), (F.min, "edits"), (F.max, "grams"), (F.max, "windows"))]
    return found.groupBy(*key, "item_id").agg(*once).withColumnRenamed("doc_id", id_col)


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose documents hold no region of a benchmark item; see regions(). Each row is judged by its own text, also where ids repeat or are null; columns of any other name are carried along."""
    doc, low, high = batches.fresh(df, "doc", "low", "high")
    bad = regions(df, benchmark, id_col, text_col).select(F.col(f"`{id_col}`").alias(doc), F.col("text_low").alias(low), F.col("text_high").alias(high)).distinct()
    text_low, text_high = text_keys(text_col)
    return df.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (text_low == F.col(low)) & (text_high == F.col(high)), "left_anti")
