"""Operator 6: exact n-gram Jaccard join through a token-group matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.llm.components import components
from weftline.session import discard, held

#: Words of a shingle. Two documents link if 5 * intersection >= 4 * union of their shingle sets (0.8).
SHINGLE = 5
#: Buckets of the frequency sketch, in slices.
BUCKETS, SLICES = 1 << 20, 64
#: Tasks whose sketches are added up at a time.
TOGETHER = 64
#: Bins of the minimum sketch and bins of a band.
BINS, BAND = 64, 4
#: Documents of a group and queries of a block, at most about.
GROUP, BLOCK = 128, 256
#: Bits of the filter that keeps texts of uninvolved documents out of a shuffle.
FILTER = 1 << 23

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(0, 1 << 63, 256, np.int64).astype(U) | U(1)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
STEP = U(0x9E3779B97F4A7C15)
PLACES = (_rng.integers(0, 1 << 63, SHINGLE, np.int64).astype(U) << U(1)) | U(1)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: of SHINGLE words in a row, or of all words where there are fewer; none without words."""
    raw = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.cumsum([0, *(len(r) + 1 for r in raw)])
    blank = BLANK[flat]
    inside = np.flatnonzero(~blank)
    none = np.empty(0, U)
    if not len(inside):
        return [none] * len(raw)
    new = np.ones(len(inside), bool)
    new[1:] = inside[1:] != inside[:-1] + 1
    start = np.flatnonzero(new)
    word = np.cumsum(new) - 1
    place = inside - inside[start][word]
    power = np.cumprod(np.full(int(place.max()) + 1, STEP, U))
    words = mix(np.add.reduceat(BYTES[flat[inside]] * power[place], start))
    first = np.searchsorted(inside[start], edge)  # first word of each text
    n = np.diff(first)
    total = sum(words[k : len(words) - SHINGLE + 1 + k] * PLACES[k] for k in range(SHINGLE)) if len(words) >= SHINGLE else none
    total = mix(total)
    out = []
    for a, c in zip(first.tolist(), n.tolist(), strict=False):
        if c >= SHINGLE:
            out.append(np.unique(total[a : a + c - SHINGLE + 1]))
        elif c:
            out.append(mix((words[a : a + c] * PLACES[:c]).sum(keepdims=True) + U(c)))
        else:
            out.append(none)
    return out


def bucket(u: np.ndarray) -> np.ndarray:
    return (u >> U(44)).astype(np.int64)


def bands(u: np.ndarray) -> np.ndarray:
    """Band hashes of a set: the least hash of each bin, empty bins borrowing from the next, in bands of BAND bins."""
    least = np.zeros(BINS, U)
    back = u[::-1]
    at = (back & U(BINS - 1)).astype(np.int64)
    filled = np.zeros(BINS, bool)
    least[at] = back
    filled[at] = True
    if not filled.all():
        full = np.flatnonzero(filled)
        own = np.arange(BINS)
        nxt = full[np.searchsorted(full, own) % len(full)]
        least = least[nxt] + ((nxt - own) % BINS).astype(U)
    rows = least.reshape(-1, BAND)
    h = np.arange(len(rows)).astype(U)
    for k in range(BAND):
        h = mix(h * STEP + rows[:, k])
    return h.view(np.int64)


def prefix_size(n):
    """A set and any that it links with share one of so many first tokens, in any order of all tokens: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def described(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each document (doc_id, n, low, high, bands): size, digest and bands of its set. Of each task also its share of the frequency sketch (slice, counts, the task's number as n), on rows of their own."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(parts):
        batches.only("similar")
        sketch = np.zeros(BUCKETS, np.uint32)
        id_type = pa.int64()
        names = ["doc_id", "n", "low", "high", "bands", "slice", "counts"]
        for batch in parts:
            id_type = batch.schema.field("doc_id").type
            for part in batches.steps(batch):
                sets = shingles(part.column("text").to_pylist())
                digests = [xxhash.xxh3_128_intdigest(u.tobytes()) for u in sets]
                if sum(map(len, sets)):
                    sketch += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS).astype(np.uint32)
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(u) for u in sets], pa.int64()),
                        pa.array(np.array([d & (1 << 64) - 1 for d in digests], U).view(np.int64)),
                        pa.array(np.array([d >> 64 for d in digests], U).view(np.int64)),
                        pa.array([bands(u) if len(u) else None for u in sets], pa.list_(pa.int64())),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()),
                    ],
                    names,
                )
        wide = BUCKETS // SLICES
        if sketch.any():
            none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            task = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, id_type), task, *none, pa.array(range(SLICES), pa.int32()), pa.array([np.minimum(sketch[k * wide : (k + 1) * wide], 65535).astype("<u2").tobytes() for k in range(SLICES)], pa.binary())], names)

    return src.mapInArrow(run, f"doc_id {kind}, n bigint, low bigint, high bigint, bands array<bigint>, slice int, counts binary")


def levels(described_rows: DataFrame) -> np.ndarray:
    """Of each bucket of the sketch a level: 0 where its tokens are as frequent as most, else higher with their frequency. BUCKETS bytes, whatever the input."""

    wide = BUCKETS // SLICES

    def add(key, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(wide, np.int64)
        for raw in part["counts"]:
            total += np.frombuffer(raw, np.int64 if len(raw) == 8 * wide else "<u2")
        return pd.DataFrame({"slice": [key[0]], "task": [key[1]], "counts": [total.tobytes()]})

    # the shares of TOGETHER tasks are added up at a time, so no group grows with the number of tasks
    rows = described_rows.where("slice is not null").select("slice", F.col("n").alias("task"), "counts")
    most = rows.agg(F.max("task")).first()[0] or 0
    steps: list[DataFrame] = []
    while True:
        rows = rows.groupBy("slice", F.floor(F.col("task") / TOGETHER).alias("task")).applyInPandas(add, "slice int, task bigint, counts binary")
        most //= TOGETHER
        if not most:
            break
        rows = held(rows, "sketch")
        steps.append(rows)
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.toLocalIterator():
        out[r["slice"] * wide : (r["slice"] + 1) * wide] = np.frombuffer(r["counts"], np.int64)
    discard(*steps)
    mean = out.mean()
    hot = out > mean + 6 * np.sqrt(mean) + 16
    return np.where(hot, np.minimum(1 + np.log2(np.maximum(out - mean, 1)), 255), 0).astype(np.uint8)


def prefixes(df: DataFrame, level: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tokens): the first tokens of each set, rare ones first. Which token comes first only has to be the same everywhere."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")
    shared = df.sparkSession.sparkContext.broadcast(level)

    def make():
        batches.only("similar")
        own = shared.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for u in shingles(part.column("text").to_pylist()):
                order = np.argsort(own[bucket(u)], kind="stable")[: prefix_size(len(u))] if len(u) else []
                out.append(u[order].view(np.int64) if len(u) else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "tokens"])

        return step

    return batches.map_steps(src, make, f"doc_id {kind}, tokens array<bigint>")


def among(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of docs (doc_id, text) that may be wanted: a filter of FILTER bits is made of the wanted ids, so most other texts stay out of the join that follows."""
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER))
    words = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    bits = np.zeros(FILTER // 64, np.int64)
    for r in words.toLocalIterator():
        bits[r["w"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value[s.to_numpy(np.int64)])

    return docs.where("doc_id is not null").where(maybe(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER))))


def verify(docs: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, links, root) of what queries of groups link with: asked against members, both (doc_id, grp, comp, own, docs), by whole shingle sets.

    Queries of a group are dealt to blocks of about BLOCK. A block holds the
    texts of its group (GROUP at most) and of its queries. The group's tokens
    are united; a query that shares too few tokens with the union for any
    member is passed over, else its overlap with every member is counted. A
    pair counts where its later side (by comp, own, doc_id) is the query.
    links are the documents (docs of each class) that a node links with in the
    block, and root is a node that links lead to from it, so a block gives a
    row for each node and not for each pair.
    """
    size = asked.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rest = ["comp", "own", "docs"]
    queries = asked.join(size, "grp").select("doc_id", "grp", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("query"), F.lit(False).alias("member"), *rest)
    opened = members.join(size, "grp").select("doc_id", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("query"), F.lit(True).alias("member"), *rest)
    once = queries.unionByName(opened).groupBy("doc_id", "grp", "block").agg(F.max("query").alias("query"), F.max("member").alias("member"), *[F.first(c).alias(c) for c in rest])
    parts = held(once, "opened")
    texts = among(docs, parts, "doc_id").join(parts, "doc_id")

    def look(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["doc_id", "text"])
        sets = shingles(part["text"].tolist())
        ids, query, count_of = part["doc_id"].to_numpy(), part["query"].to_numpy(bool), part["docs"].to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, part["own"].to_numpy(), part["comp"].to_numpy()))] = np.arange(len(ids))
        own = np.array([k for k in np.flatnonzero(part["member"].to_numpy(bool)) if len(sets[k])], np.int64)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(own):
            flat = np.concatenate([sets[k] for k in own])
            order = np.argsort(flat, kind="stable")
            union, first = np.unique(flat[order], return_index=True)
            first = np.append(first, len(flat))
            holder = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own])[order]
            sizes = np.array([len(sets[k]) for k in own])
            for k in np.flatnonzero(query):
                q = sets[k]
                if not len(q):
                    continue
                at = np.searchsorted(union, q)
                at[at == len(union)] = 0
                at = at[union[at] == q]
                if 9 * len(at) < 4 * (len(q) + max(sizes.min(), (4 * len(q) + 4) // 5)):
                    continue
                count = first[at + 1] - first[at]
                row = np.arange(count.sum()) + np.repeat(first[at] - (np.cumsum(count) - count), count)
                overlap = np.bincount(holder[row], minlength=len(own))
                hit = own[(9 * overlap >= 4 * (len(q) + sizes)) & (rank[own] < rank[k]) & (ids[own] != ids[k])]
                if len(hit):
                    links[k] += count_of[hit].sum()
                    links[hit] += count_of[k]
                    roots = np.unique(root[np.append(hit, k)])
                    if len(roots) > 1:
                        root[np.isin(root, roots)] = roots[0]
        some = links > 0
        return pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[root[some]]}).astype("int64")

    out = held(texts.groupBy("grp", "block").applyInPandas(look, "node bigint, links bigint, root bigint"), "links")
    discard(parts)
    return out


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: size of its shingle set and the smallest id that links reach; see linked()."""
    return linked(df, id_col, text_col).drop("n_links")


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, n_links, component_id) of every row: size of its shingle set, number of other documents that it links with and the smallest id that links reach.

    Exact: two documents link if their sets of SHINGLE-word shingles (A-Z
    lower-cased, words between white space) have a Jaccard similarity of 0.8 or
    more. A document with fewer words has all of them as its one shingle; one
    without words, or with a null text, has none and links with nothing. Equal
    sets are one class from the start. A null id has a null component and null
    links; rows that repeat an id count as one document.

    1. Classes that share a band of minimum hashes are checked against the
    smallest id of the band, which puts most copies into components in linear
    time. 2. Components are cut into groups of at most GROUP classes. A class
    asks for its own group and, of its component, those groups before its own
    whose sizes allow a link. 3. The matrix of tokens and groups holds the
    first tokens (rare first) of all members. A class asks for the groups of
    other components with which it shares enough first tokens for the
    similarity to be possible. 4. All groups asked for are opened and compared
    whole, so each pair of classes that links is found once; components come
    from these links. Work within a component grows with the square of its
    classes, what is written with its classes for each block.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seen = held(described(df, id_col, text_col), "described")
    rows = seen.where("slice is null").select("doc_id", "n", "low", "high", "bands")
    real = rows.where("n > 0 and doc_id is not null")
    counts = real.select("low", "high", "doc_id").distinct().groupBy("low", "high").agg(F.count("*").alias("docs"))
    classes = real.groupBy("low", "high").agg(F.min("doc_id").cast("long").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = held(classes.join(counts, ["low", "high"]), "classes")
    key = classes.select("rep", F.explode("bands").alias("band"))
    hubs = key.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "hub")
    near = key.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("doc_id"), F.col("hub").alias("grp")).distinct()
    near = held(near, "near")
    alone = [F.col("doc_id").alias("comp"), F.lit(0).cast("long").alias("own"), F.lit(1).cast("long").alias("docs")]
    hub = near.select(F.col("grp").alias("doc_id"), "grp").distinct()
    first = verify(docs, hub.select("*", *alone), near.select("*", *alone))
    together = components(first, "node", "root")
    sized = together.groupBy("component").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    placed = together.join(sized, "component").select(F.col("node").alias("rep"), F.col("component").alias("comp"), F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("groups"))).alias("grp"), F.lit(True).alias("many"))
    nodes = classes.select("rep", "n", "docs").join(placed, "rep", "left").select("rep", "n", "docs", F.coalesce("comp", "rep").alias("comp"), F.coalesce("grp", F.xxhash64("rep")).alias("grp"), F.coalesce("many", F.lit(False)).alias("many"))
    bounds = nodes.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    nodes = held(nodes.join(bounds, "grp"), "nodes")
    n, low, high = F.col("n"), F.greatest(F.col("least"), F.floor((4 * F.col("n") + 4) / 5)), F.least(F.col("most"), F.floor(5 * F.col("n") / 4))

    within = nodes.where("many")
    groups = within.select("comp", F.col("grp").alias("g"), "least", "most").distinct()
    inner = within.select("rep", "comp", "grp", "n").join(groups, "comp").where((F.col("g") <= F.col("grp")) & (low <= high)).select(F.col("rep").alias("doc_id"), F.col("g").alias("grp"))

    tokens = prefixes(df, levels(seen), id_col, text_col).select(F.col("doc_id").cast("long").alias("rep"), "tokens")
    cells = tokens.join(nodes.select("rep", "comp"), "rep").select("comp", "rep", F.explode("tokens").alias("token"))
    common = cells.groupBy("token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last").select("token")
    rough = held(cells.join(common, "token"), "cells")
    cells = rough.join(nodes, ["rep", "comp"])
    matrix = cells.select("token", F.col("grp").alias("g"), F.col("comp").alias("c"), "least", "most").distinct()
    shares = cells.select("token", "rep", "comp", "n").join(matrix, "token").where((F.col("comp") > F.col("c")) & (low <= high)).groupBy("rep", "g", "n", "least", "most").agg(F.count("*").alias("c"))
    able = ((low <= n) & (45 * F.col("c") + 16 * n - 20 * low >= 0)) | ((high >= n) & (45 * F.col("c") + 16 * high - 20 * n >= 0))
    asked = held(inner.unionByName(shares.where(able).select(F.col("rep").alias("doc_id"), F.col("g").alias("grp"))).distinct(), "asked")
    about = nodes.select(F.col("rep").alias("doc_id"), "comp", F.col("grp").alias("own"), "docs")
    opened = nodes.join(asked.select("grp").distinct(), "grp", "left_semi").select(F.col("rep").alias("doc_id"), "grp", "comp", F.col("grp").alias("own"), "docs")
    links = verify(docs, opened, asked.join(about, "doc_id"))
    discard(near, first, nodes, rough, asked)
    joined = components(links, "node", "root")
    others = links.groupBy(F.col("node").alias("linker")).agg(F.sum("links").alias("links"))
    final = (
        classes.select("low", "high", "rep", "docs")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .join(others, F.col("rep") == F.col("linker"), "left")
        .select("low", "high", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    kind = df.schema[id_col].dataType.simpleString()
    known = F.col("doc_id").isNotNull()
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"), "low", "high")
        .join(final, ["low", "high"], "left")
        .select(F.col("doc_id").alias(id_col), "n_shingles", F.when(known, F.coalesce("links", F.lit(0))).alias("n_links"), F.when(known, F.coalesce(F.col("component").cast(kind), F.col("doc_id"))).alias("component_id"))
    )
