"""Operator 4: language identification by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.session import discard, held

#: Documents that a model is fitted on, about, and the bytes of their texts: labelled rows are taken by a hash of id and text.
FIT_DOCS, FIT_BYTES = 20_000, 1 << 28
#: Documents of each language that are taken at least, where there are as many.
FIT_LEAST = 100
#: Longest character n-gram.
LONGEST = 4
#: Weight of an unseen word against a known one.
UNSEEN = 0.5
#: Words after which more of them add no confidence.
SURE = 24
#: Words that a task remembers.
REMEMBER = 250_000
#: Seed of the 64-bit hash that stands for a word or n-gram, as xxhash64() has it.
SEED = 42
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text, for fitting and for predicting: letters in a row."""
    if not text:
        return []
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # some numbers, such as fractions, count as letters there
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def hashes(words: list[str]) -> np.ndarray:
    """What xxhash64() gives for each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w.encode(), SEED) for w in words), np.uint64, len(words)).view(np.int64)


class Table:
    """Rows by 64-bit hash, which are kept sorted."""

    def __init__(self, key: np.ndarray, rows: np.ndarray):
        order = np.argsort(key)
        self.key, self.rows = key[order], rows[order]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of the row of each key, -1 without one."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, at, -1)


@dataclass
class Model:
    """Log frequencies by language: a row of a table for each known word, and for each n-gram of one size."""

    langs: list[str]
    words: Table
    grams: list[Table]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Rows of unseen words: the mean over their letters (and the space before them) of the longest known n-gram that starts there, times UNSEEN; zero without any."""
        marked = [f" {w} " for w in words]
        count = np.array([len(m) - 1 for m in marked])
        owner = np.repeat(np.arange(len(words)), count)
        row, open_ = np.zeros((len(owner), len(self.langs))), np.ones(len(owner), bool)
        spots = [(m, i) for m in marked for i in range(len(m) - 1)]
        for size in range(LONGEST, 0, -1):  # shorter ones only where no longer one is known
            left = np.flatnonzero(open_)
            wanted = [spots[k] for k in left.tolist()]
            fits = np.array([i + size <= len(m) for m, i in wanted], bool)
            at = np.full(len(left), -1, np.int64)
            at[fits] = self.grams[size - 1].find(hashes([m[i : i + size] for (m, i), f in zip(wanted, fits.tolist(), strict=True) if f]))
            hit = at >= 0
            row[left[hit]] = self.grams[size - 1].rows[at[hit]]
            open_[left[hit]] = False
        total, n = np.zeros((len(words), len(self.langs))), np.bincount(owner[~open_], minlength=len(words))
        np.add.at(total, owner, row)
        return total / np.maximum(n, 1)[:, None] * UNSEEN

    def learn(self, words: list[str]) -> None:
        """Rows of words: their own where they are known, else those of backed_off()."""
        new = np.zeros((len(words), len(self.langs)), np.float32)
        at = self.words.find(hashes(words))
        known = at >= 0
        new[known] = self.words.rows[at[known]]
        rest = np.flatnonzero(~known).tolist()
        if rest:
            new[rest] = self.backed_off([words[k] for k in rest])
        self.known.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.rows = np.concatenate([self.rows, new])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and confidence of each text; ties go to the first language in order."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        split = [words_of(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.forget()
        flat = list(chain.from_iterable(split))
        numbers = list(map(self.known.get, flat))
        if None in numbers:
            self.learn(sorted({w for w, n in zip(flat, numbers, strict=True) if n is None}))
            numbers = [self.known[w] if n is None else n for w, n in zip(flat, numbers, strict=True)]
        which = np.array(numbers, np.int64)
        lang, score, at = [], [], 0
        for w in split:
            if not w:
                lang.append("und")
                score.append(0.0)
                continue
            mean = self.rows[which[at : at + len(w)]].astype(np.float64).mean(0)
            at += len(w)
            best = int(mean.argmax())
            p = np.exp((mean - mean[best]) * min(len(w), SURE))
            lang.append(self.langs[best])
            score.append(float(1 / p.sum()))
        return lang, score


def logs(counts: pa.Table, langs: list[str]) -> Table:
    """Smoothed log frequencies by language from (h, l, n), one row for each h."""
    key, at = np.unique(counts["h"].to_numpy(), return_inverse=True)
    number = {x: k for k, x in enumerate(langs)}
    column = np.array([number[x] for x in counts["l"].to_pylist()], np.int64)
    own = np.zeros((len(key), len(langs)))
    np.add.at(own, (at, column), counts["n"].to_numpy())
    return Table(key, np.log((own + 0.5) / (own.sum(0) + 0.5 * len(own))).astype(np.float32))


def word_counts(batches_):
    """(l, w, n) of batches of (l, t)."""
    for b in batches_:
        seen: Counter = Counter()
        for lang, text in zip(b.column("l").to_pylist(), b.column("t").to_pylist(), strict=True):
            seen.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["l", "w", "n"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = FIT_DOCS, size: int = FIT_BYTES) -> Model:
    """Fits on rows with a text and a language: of more than `docs` different ones, or more than `size` bytes of text, on a share of about that size, taken by a hash of id and text.

    The share is never empty, and never without one of the languages (see
    batches.sampled()). Words and their n-grams are counted in Spark; every one
    of the fitted rows is kept, as a 64-bit hash and a number for each
    language, so the model grows with the distinct words of the share and not
    with the table. Rows that repeat count each; other columns are not read.
    Without any labelled row the model knows no language.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).where("t is not null and l is not null")
    rows = batches.sampled(rows, "l", ["i", "t"], docs, F.octet_length("t"), size, FIT_LEAST).select("l", "t")
    langs = sorted(r.l for r in rows.select("l").distinct().collect())
    counts = held(rows.mapInArrow(word_counts, "l string, w string, n long").groupBy("w", "l").agg(F.sum("n").alias("n")), "words")
    marked = F.concat(F.lit(" "), F.col("w"), F.lit(" "))

    def gathered(of: DataFrame) -> pa.Table:
        return of.select(F.xxhash64("w").alias("h"), "l", "n").toArrow()

    grams = []
    for width in range(1, LONGEST + 1):
        starts = F.when(F.length(marked) >= width, F.sequence(F.lit(1), F.length(marked) - width + 1))
        parts = counts.select("l", "n", marked.alias("m"), F.explode(starts).alias("k")).select("l", "n", F.substring(F.col("m"), F.col("k"), F.lit(width)).alias("w"))
        grams.append(logs(gathered(parts.groupBy("w", "l").agg(F.sum("n").alias("n"))), langs))
    model = Model(langs, logs(gathered(counts), langs), grams)
    discard(counts)
    model.forget()
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the most likely of the model's languages and its share of the likelihood.

    `und` with score 0 if the text is null or holds no letter, or the model
    knows no language. Repeated rows each give a row, a null id stays null,
    other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        batches.only("language")
        own = shared.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = own.predict(part.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    return batches.map_steps(src, make, f"doc_id {kind}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def annotate(df: DataFrame, model: Model, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """df with two more columns, for use in a pipeline; see identify(). Null texts, empty tables and repeated rows are treated as there, and all columns of df are carried along; the two names must be new (batches.fresh())."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def add(texts):
        lang, score = shared.value.predict(texts)
        return {lang_as: pa.array(lang, pa.string()), score_as: pa.array(score, pa.float64())}

    return batches.arrow_rows(df, text_col, add, f"`{lang_as}` string, `{score_as}` double", "language")


def held_out(id_col: Column) -> Column:
    """Rows that a model must not learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
