"""Operator 7: approximate nearest neighbours over one small-world graph per shard."""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import cut

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 4096, 4096
#: Links of a node above the ground and on it; candidates kept while building and while searching.
LINKS, GROUND, BUILD, SEARCH = 12, 24, 64, 96


@dataclass
class Graph:
    """Flat neighbour arrays: links[level, node, :] with -1 for none, distinct vectors, and the sorted ids of each from first on."""

    vectors: np.ndarray
    links: np.ndarray
    entry: int
    first: np.ndarray
    ids: np.ndarray

    def pack(self) -> bytes:
        levels, n, _ = self.links.shape
        head = struct.pack("<5q", n, self.vectors.shape[1], levels, self.entry, len(self.ids))
        return b"".join([head, self.vectors.tobytes(), self.links.tobytes(), self.first.tobytes(), self.ids.tobytes()])

    @classmethod
    def unpack(cls, blob: bytes) -> Graph:
        n, d, levels, entry, m = struct.unpack_from("<5q", blob)
        at = 40
        out = []
        for kind, size in ((np.float64, n * d), (np.int32, levels * n * GROUND), (np.int64, n + 1), (np.int64, m)):
            out.append(np.frombuffer(blob, kind, size, at))
            at += out[-1].nbytes
        return cls(out[0].reshape(n, d), out[1].reshape(levels, n, GROUND), entry, out[2], out[3])

    def descend(self, q: np.ndarray, level: int, at: int) -> int:
        """The node nearest to q that greedy steps on one level reach."""
        best = float(((self.vectors[at] - q) ** 2).sum())
        while True:
            near = self.links[level, at]
            near = near[near >= 0]
            if not len(near):
                return at
            d = ((self.vectors[near] - q) ** 2).sum(1)
            k = int(d.argmin())
            if d[k] >= best:
                return at
            at, best = int(near[k]), float(d[k])

    def explore(self, q: np.ndarray, level: int, at: int, width: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        """(squared distance, node) of the nearest nodes found by best-first search, nearest first."""
        d = float(((self.vectors[at] - q) ** 2).sum())
        seen[at] = mark
        open_, kept = [(d, at)], [(-d, at)]
        while open_:
            d, at = heapq.heappop(open_)
            if len(kept) >= width and d > -kept[0][0]:
                break
            near = self.links[level, at]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            far = ((self.vectors[near] - q) ** 2).sum(1)
            if len(kept) >= width:
                good = far < -kept[0][0]
                near, far = near[good], far[good]
            for d, n in zip(far.tolist(), near.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (-d, n))
                elif d < -kept[0][0]:
                    heapq.heapreplace(kept, (-d, n))
                else:
                    continue
                heapq.heappush(open_, (d, n))
        return sorted((-d, n) for d, n in kept)

    def search(self, q: np.ndarray, k: int, without: int | None, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest ids found, ties to smaller ids."""
        at = self.entry
        for level in range(len(self.links) - 1, 0, -1):
            at = self.descend(q, level, at)
        found = self.explore(q, 0, at, max(SEARCH, 2 * k), seen, mark)
        out: list[tuple[float, int]] = []
        for _, n in found:
            d = float(np.sqrt(((self.vectors[n] - q) ** 2).sum()))
            if len(out) >= k and d > out[-1][0]:
                break
            own = self.ids[self.first[n] : self.first[n] + k + 1] if self.first[n + 1] - self.first[n] > k else self.ids[self.first[n] : self.first[n + 1]]
            out += [(d, int(i)) for i in own if i != without]
            out = sorted(out)[:k]
        return out


def diverse(vectors: np.ndarray, near: list[tuple[float, int]], most: int) -> list[int]:
    """Of candidates, nearest first, those that are nearer to the new node than to each one taken before; filled up with the rest."""
    if len(near) <= most:
        return [n for _, n in near]
    own = vectors[[n for _, n in near]]
    sq = (own**2).sum(1)
    between = sq[:, None] + sq[None, :] - 2 * own @ own.T
    least = np.full(len(near), np.inf)
    taken, rest = [], []
    for k, (d, n) in enumerate(near):
        if d < least[k]:
            taken.append(n)
            least = np.minimum(least, between[k])
            if len(taken) == most:
                return taken
        else:
            rest.append(n)
    return taken + rest[: most - len(taken)]


def build(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    """Graph over the distinct vectors of a shard. Equal vectors are one node that lists all their ids, so copies can't crowd a graph."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    node = node.reshape(-1)
    order = np.lexsort((ids, node))
    first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(distinct)))]).astype(np.int64)
    n = len(distinct)
    level = np.minimum((-np.log(np.random.default_rng(n).random(n)) / np.log(LINKS)).astype(int), 6)
    g = Graph(distinct, np.full((int(level.max()) + 1, n, GROUND), -1, np.int32), 0, first, ids[order])
    seen, mark, top = np.zeros(n, np.int64), 0, int(level[0]) if n else 0
    count = np.zeros(g.links.shape[:2], np.int32)
    for i in np.random.default_rng(7).permutation(n).tolist():
        if mark == 0:
            g.entry, top, mark = i, int(level[i]), 1
            continue
        q, at = distinct[i], g.entry
        for lv in range(top, level[i], -1):
            at = g.descend(q, lv, at)
        for lv in range(min(top, int(level[i])), -1, -1):
            mark += 1
            near = g.explore(q, lv, at, BUILD, seen, mark)
            at = near[0][1]
            own = diverse(distinct, near, LINKS)
            g.links[lv, i, : len(own)] = own
            count[lv, i] = len(own)
            most = GROUND if lv == 0 else LINKS
            for j in own:
                c = int(count[lv, j])
                if c < most:
                    g.links[lv, j, c] = i
                    count[lv, j] = c + 1
                    continue
                old = np.append(g.links[lv, j, :c], i)
                d = ((distinct[old] - distinct[j]) ** 2).sum(1)
                kept = diverse(distinct, sorted(zip(d.tolist(), old.tolist(), strict=True)), most)
                g.links[lv, j, : len(kept)] = kept
                g.links[lv, j, len(kept) :] = -1
                count[lv, j] = len(kept)
        if level[i] > top:
            g.entry, top = i, int(level[i])
    return g


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def settled(part: pd.DataFrame) -> pd.DataFrame:
    """One row for each id, in ascending order: of several the one with the smallest vector."""
    if not part["id"].is_unique:
        part = part.assign(own=part["v"].map(tuple)).sort_values(["id", "own"]).drop_duplicates("id")
    return part.sort_values("id")


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> tuple[DataFrame, int]:
    """(shard, dims, graph) with the packed graph of each shard, and the number of shards. Every usable row is indexed, in shards of about `shard` rows dealt by a hash of the id."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n = max(1, -(-rows.count() // shard))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard"), F.size("v").alias("dims"), "id", F.col("v").cast("array<double>").alias("v"))

    def make(key, part: pd.DataFrame) -> pd.DataFrame:
        part = settled(part)
        g = build(part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"shard": [key[0]], "dims": [key[1]], "graph": [g.pack()]})

    return dealt.groupBy("shard", "dims").applyInPandas(make, "shard int, dims int, graph binary"), n


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k nearest rows of df found, its own id left out.

    score is the Euclidean distance of the original vectors in double
    precision; rank counts from 1, ties go to the smaller id. Rows whose
    vector is null, zero or holds a null or non-finite component, or whose id
    is null, take no part on either side; vectors of different length are not
    compared. Of rows that repeat an id and have vectors
    of one length the one with the smallest vector, component by component,
    counts. Fewer than k
    candidates give all of them; an empty table gives no rows.
    """
    graphs, n = index(df, id_col, vector_col, shard)
    graphs = cut(graphs)
    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dims"), "id", F.col("v").cast("array<double>").alias("v"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["shard", "dims", "block"]

    def look(_, graph: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(graph) and len(part):
            g = Graph.unpack(graph["graph"].iloc[0])
            seen = np.zeros(len(g.vectors), np.int64)
            part = settled(part)
            for mark, (i, v) in enumerate(zip(part["id"].tolist(), part["v"], strict=True), 1):
                out += [(i, j, d) for d, j in g.search(np.asarray(v, np.float64), k, i, seen, mark)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = graphs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(look, "query_id bigint, vec_id bigint, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
