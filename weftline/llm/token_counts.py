"""Operator 1: token counts by rank-synchronous array merging."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.llm.ragged import PairTable, merge

#: The split pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a task remembers; the table starts anew when it is full.
REMEMBER = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class ByteBpe:
    """Counts tokens of a byte-level vocabulary as the tokenizers library gives them by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        side = [np.array([vocab[p[k]] for p in pairs]) for k in (0, 1)]
        self.table = PairTable(*side, np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs]), max(vocab.values()) + 1)
        self.start = np.array([vocab[c] for c in byte_symbols()], np.int32)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # a character that all special strings hold, if there is one: a text without it holds none
        self.mark = next((c for c in sorted(set.intersection(*map(set, special)))), "") if special else ""
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings stand in it (each is one token)."""
        if self.special is None or self.mark not in text:
            return self.split.findall(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self.split.findall(p)], len(parts) - 1

    def learn(self, words: list[str]) -> None:
        """Counts of pre-tokens that are not known yet, all merged together."""
        raw = [w.encode() for w in words]
        flat = self.start[np.frombuffer(b"".join(raw), np.uint8)]
        _, left = merge(flat, np.array([len(r) for r in raw]), self.table)
        self.known.update(zip(words, left.tolist(), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.pre_tokens(t) if t else ([], 0) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        fresh = set().union(*(t for t, _ in split)) - self.known.keys()
        if fresh:
            self.learn(list(fresh))
        get = self.known.__getitem__
        return [sum(map(get, t)) + n for t, n in split]


def load(path: str) -> ByteBpe:
    return batches.only(("token_counts", path), lambda: ByteBpe(path))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a
    row; a null id stays null; other columns are not read. Texts are processed
    in slices of bounded size, whole; each distinct pre-token of a slice is
    merged once.
    """
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def make():
        model = load(path)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            text = part.column("text")
            size = pa.compute.fill_null(pa.compute.binary_length(text).cast(pa.int64()), 0)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(model.counts(text.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return step

    return batches.map_steps(src, make, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("doc_id", id_col)
