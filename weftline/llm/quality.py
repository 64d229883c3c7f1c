"""Operator 12: document quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.session import held

#: Share of the pooled covariance in each class's own, and of the identity (statistics are standardised) in the result.
POOLED, ROUND = 0.30, 0.05
#: Log-density differences are divided by this before they become a score, so that far documents keep their order.
SPREAD = 8.0
#: Kinds of bytes.
GAP, LINE, LOWER, UPPER, DIGIT, STOP, SIGN, LEAD, REST = range(9)
STATISTICS = [
    "log_bytes", "log_words", "log_word_length", "log_longest_word", "upper", "digits", "signs", "stops", "loud", "bars", "beyond_ascii", "lines",
    "distinct_words", "repeats_beside", "most_common", "pairs_again", "lines_again", "entropy", "short_words", "words_a_stop",
]


def kinds() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = REST if b < 0xC0 else LEAD
        elif c in "\n\r\v\f":
            out[b] = LINE
        elif c in " \t":
            out[b] = GAP
        elif c.islower():
            out[b] = LOWER
        elif c.isupper():
            out[b] = UPPER
        elif c.isdigit():
            out[b] = DIGIT
        elif c in ".,;:!?'\"()-":
            out[b] = STOP
    return out


KINDS = kinds()
#: Bytes that are hashed or counted at a time.
PIECE = 1 << 20
CODES = np.random.default_rng(12).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def prints(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, for about PIECE bytes (and one span at least) at a time."""
    out = np.zeros(len(begin), np.uint64)
    last, k = np.cumsum(size), 0
    while k < len(begin):
        to = max(k + 1, int(np.searchsorted(last, (last[k - 1] if k else 0) + PIECE)))
        n, start = size[k:to], begin[k:to]
        before = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(before, n)
        power = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
        out[k:to] = mixed(np.add.reduceat(CODES[flat[at + np.repeat(start, n)]] * power[at], before))
        k = to
    return out


def distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each document has, and how often its commonest one stands there."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])]))
    most = np.zeros(docs)
    np.maximum.at(most, d[new], np.diff(np.append(new, len(d))))
    return np.bincount(d[new], minlength=docs).astype(float), most


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of transformed statistics for each whole text; null counts as empty.

    Sizes are logarithms, shares are square roots, which keeps rare signs apart
    from none at all; what can't be measured in a text (no word, no pair) is 0.
    """
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    size = np.array([len(r) for r in raw], np.int64)
    # a line break between texts keeps words and lines within them
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    first = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    histogram = np.zeros(256 * n)
    for a in range(0, len(flat), PIECE):
        own = owner[a : a + PIECE]
        seen = np.bincount((own - own[0]) * np.int64(256) + flat[a : a + PIECE])
        histogram[256 * own[0] : 256 * own[0] + len(seen)] += seen
    histogram = histogram.reshape(n, 256)
    histogram[:, 10] -= 1
    count = np.stack([histogram[:, KINDS == k].sum(1) for k in range(9)], 1)
    letters = np.maximum(size - count[:, REST], 1)  # code points

    begin, length = spans(KINDS[flat] > LINE)
    doc = owner[begin]
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    h = prints(flat, begin, length)
    different, most = distinct(doc, h, n)
    beside = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    pairs = np.bincount(doc[1:][beside], minlength=n) if len(doc) else np.zeros(n)
    equal = np.bincount(doc[1:][beside & (h[1:] == h[:-1])], minlength=n) if len(doc) else np.zeros(n)
    pair_kinds = distinct(doc[1:][beside], mixed(h[1:] + np.uint64(3) * h[:-1])[beside], n)[0] if len(doc) else np.zeros(n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    line_begin, line_size = spans(flat != 10)
    line_doc = owner[line_begin]
    lines = np.bincount(line_doc, minlength=n)
    line_kinds = distinct(line_doc, prints(flat, line_begin, line_size), n)[0]

    share = histogram / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    ends = histogram[:, list(b".!?")].sum(1)
    root = np.sqrt
    out = np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p((size - count[:, GAP] - count[:, LINE]) / some), np.log1p(longest),
            root(count[:, UPPER] / letters), root(count[:, DIGIT] / letters), root(count[:, SIGN] / letters), root(count[:, STOP] / letters), root(histogram[:, ord("!")] / letters), root(histogram[:, ord("|")] / letters),
            root(count[:, LEAD] / letters), root(count[:, LINE] / letters),
            np.log((different + 0.5) / (words + 0.5)), root(equal / np.maximum(pairs, 1)), root(most / some), root(1 - pair_kinds / np.maximum(pairs, 1)) * (pairs > 0), root(1 - line_kinds / np.maximum(lines, 1)) * (lines > 0),
            entropy, root(np.bincount(doc[length <= 2], minlength=n) / some), np.log1p(words / (ends + 1)),
        ],
        1,
    )
    return out


@dataclass
class Density:
    """A normal distribution: its centre, the inverse of its covariance's Cholesky factor, the logarithm of its determinant and of its class's share."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: float
    log_share: float

    def at(self, x: np.ndarray) -> np.ndarray:
        far = (x - self.mean) @ self.inverse.T
        return self.log_share - 0.5 * (self.log_det + (far * far).sum(1))


@dataclass
class Model:
    """Two densities over standardised statistics; without rows of both classes, the share of class 1 alone."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[Density]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Score of class 1 for rows of statistics."""
        if not self.classes:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        return 1 / (1 + np.exp(np.clip((self.classes[0].at(z) - self.classes[1].at(z)) / SPREAD, -700, 700)))


def solve(count: np.ndarray, total: np.ndarray, square: np.ndarray, pooled: float = POOLED, round_: float = ROUND) -> Model:
    """The model from each class's number of rows, sums and sums of products."""
    n, d = count.sum(), total.shape[1]
    share = float((count[1] + 0.5) / (n + 1))
    if not count.all():
        return Model(np.zeros(d), np.ones(d), [], share)
    centre = total.sum(0) / n
    scale = np.sqrt(np.maximum(np.diag(square.sum(0)) / n - centre**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    means = (total / count[:, None] - centre) / scale
    # second moments about each class's own mean, of standardised statistics
    own = np.stack([(square[k] / count[k] - np.outer(total[k], total[k]) / count[k] ** 2) / np.outer(scale, scale) for k in (0, 1)])
    common = (own * count[:, None, None]).sum(0) / n
    classes = []
    for k in (0, 1):
        cov = (1 - round_) * ((1 - pooled) * own[k] + pooled * common) + round_ * np.eye(d)
        low = np.linalg.cholesky((cov + cov.T) / 2)
        classes.append(Density(means[k], np.linalg.inv(low), float(2 * np.log(np.diag(low)).sum()), float(np.log(count[k] / n))))
    return Model(centre, scale, classes, share)


def held_out(id_col: Column) -> Column:
    """Rows whose labels a model must not learn from: crc32 of the id as text leaves 1 when divided by 3. A row without an id has no such remainder."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row: the statistics of its whole text. Null texts count as empty, repeated rows each give a row, other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def make():
        batches.only("quality")

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            x = statistics(part.column("text").to_pylist())
            edge = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(edge, pa.array(x.ravel()))], ["doc_id", "x"])

        return step

    return batches.map_steps(src, make, f"doc_id {kind}, x array<double>").withColumnRenamed("doc_id", id_col)


def moments(rows: DataFrame) -> DataFrame:
    """(y, i, j, total, n) of rows (y, x): sums of products of statistics by class; j = -1 stands for the sum alone, i = j = -1 for the number of rows. Each task sends one row for each, whatever it has read."""
    d = len(STATISTICS)
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def run(source):
        sums: dict[int, list] = {}
        for b in source:
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            y = b.column("y").to_numpy()
            for k in np.unique(y).tolist():
                own = x[y == k]
                have = sums.setdefault(k, [0, np.zeros(d), np.zeros((d, d))])
                have[0] += len(own)
                have[1] += own.sum(0)
                have[2] += own.T @ own
        for k, (n, total, square) in sums.items():
            i = [-1, *range(d), *(i for i, _ in upper)]
            j = [-1, *[-1] * d, *(j for _, j in upper)]
            v = [float(n), *total.tolist(), *(float(square[p]) for p in upper)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], ["y", "i", "j", "total"])

    return rows.mapInArrow(run, "y int, i int, j int, total double").groupBy("y", "i", "j").agg(F.sum("total").alias("total"))


def fit(statistics_: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", pooled: float = POOLED, round_: float = ROUND) -> Model:
    """Fits on the statistics of all rows whose id has a label 0 or 1; only sums reach the driver.

    A document with several labels counts once for each of them; labels that
    are null or neither 0 nor 1, and rows without an id, teach nothing.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("labelled"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1)")
    rows = statistics_.select(F.col(f"`{id_col}`").alias("i"), "x").join(known, F.col("i") == F.col("labelled")).select("y", "x")
    d = len(STATISTICS)
    count, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in moments(rows).collect():  # a row for each product of two statistics and each class
        if r.i < 0:
            count[r.y] = r.total
        elif r.j < 0:
            total[r.y, r.i] = r.total
        else:
            square[r.y, r.i, r.j] = square[r.y, r.j, r.i] = r.total
    return solve(count, total, square, pooled, round_)


def scored(statistics_: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of rows of statistics."""
    shared = statistics_.sparkSession.sparkContext.broadcast(model)
    d = len(STATISTICS)
    kind = statistics_.schema[id_col].dataType.simpleString()

    def run(source):
        for b in source:
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return statistics_.select(F.col(f"`{id_col}`").alias("doc_id"), "x").mapInArrow(run, f"doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs; the labels of held-out rows are not learnt from.

    Each text is read once: its statistics become a table of their own, from
    which the model is fitted and every row is scored. An empty text is scored
    by its statistics like any other. Without labels of both classes, every
    score is the share of class 1 (0.5 without any label).
    """
    rows = held(measured(docs, id_col, text_col), "statistics")
    model = fit(rows.where(~held_out(F.col(f"`{id_col}`"))), labels, id_col)
    out = scored(rows, model, id_col)
    return out.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
