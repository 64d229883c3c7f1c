"""Pair merging over many short symbol sequences at once."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    """(left, right) -> (rank, merged symbol), by binary search over sorted keys."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, base: int):
        key = left.astype(np.int64) * base + right
        order = np.argsort(key, kind="stable")
        self.base, self.key = base, key[order]
        self.rank, self.merged = rank[order].astype(np.int32), merged[order].astype(np.int32)
        # A merge is settled if no pair with its symbol ranks as low: then it makes nothing that goes before other places of its rank.
        least = np.full(base, NONE, np.int32)
        np.minimum.at(least, left, rank.astype(np.int32))
        np.minimum.at(least, right, rank.astype(np.int32))
        self.settled = least[self.merged] > self.rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if there is none) and its place in the table."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], NONE), at


def merge(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges ragged sequences until no pair of the table is left.

    symbols holds all sequences one behind the other, lengths their sizes. In
    each round every sequence merges its lowest-rank pair, all of them at
    once: each place of that pair from the left, or only the leftmost where
    the new symbol could take part in a pair of as low a rank. Only pairs
    beside a merge are looked up again. Sequences without a pair leave.
    Returns the surviving symbols and their number in each sequence.
    """
    n = len(lengths)
    size = np.asarray(lengths, np.int64).copy()
    pieces: list[np.ndarray] = [np.empty(0, np.int32)] * n
    seq = np.flatnonzero(size > 0)
    size = size[seq]
    sym = np.array(symbols, np.int32)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(size) - 1] = True
    rank, at = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
    pair = np.flatnonzero(~last)
    rank[pair], at[pair] = table.ranks(sym[pair], sym[pair + 1])
    ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(seq):
        start = np.cumsum(size) - size
        least = np.minimum.reduceat(rank, start)
        done = least == NONE
        if done.any():
            gone = np.repeat(done, size)
            ended.append((seq[done], size[done], sym[gone]))
            sym, rank, at, last = (x[~gone] for x in (sym, rank, at, last))
            seq, size, least = seq[~done], size[~done], least[~done]
            if not len(seq):
                break
            start = np.cumsum(size) - size
        hits = np.flatnonzero(rank == np.repeat(least, size))
        owner = np.searchsorted(start, hits, side="right") - 1
        first = np.ones(len(hits), bool)
        first[1:] = owner[1:] != owner[:-1]
        # of places that overlap every other one, from the left
        run = np.ones(len(hits), bool)
        run[1:] = (hits[1:] != hits[:-1] + 1) | first[1:]
        step = np.arange(len(hits))
        even = (step - np.maximum.accumulate(np.where(run, step, 0))) % 2 == 0
        settled = np.logical_and.reduceat(table.settled[at[hits]], np.flatnonzero(first))
        take = first | even & np.repeat(settled, np.diff(np.append(np.flatnonzero(first), len(hits))))
        hits, owner = hits[take], owner[take]
        sym[hits] = table.merged[at[hits]]
        last[hits] = last[hits + 1]
        keep = np.ones(len(sym), bool)
        keep[hits + 1] = False
        sym, rank, at, last = (x[keep] for x in (sym, rank, at, last))
        size -= np.bincount(owner, minlength=len(seq))
        hits -= np.arange(len(hits))
        rank[hits] = NONE
        left = hits[hits > 0] - 1
        pair = np.concatenate([hits, left])
        pair = pair[~last[pair]]
        rank[pair], at[pair] = table.ranks(sym[pair], sym[pair + 1])
    for ids, sizes, held in ended:
        for k, part in zip(ids.tolist(), np.split(held, np.cumsum(sizes)[:-1]), strict=True):
            pieces[k] = part
    out_len = np.array([len(p) for p in pieces], np.int64)
    return (np.concatenate(pieces) if n else np.empty(0, np.int32)), out_len
