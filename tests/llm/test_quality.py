"""The quality classifier: statistics by plain means, the discriminant by its formula, held-out accuracy."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import quality

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in rows], "doc_id bigint, text string, x string, score double, y int")


def plain(text):
    """Statistics of one text by plain means."""
    t = text or ""
    raw = t.encode()
    n = max(len(t), 1)
    lines = [x for x in t.split("\n") if x]
    words = re.findall(r"[^\n\r\v\f \t]+", t)
    size = [len(w.encode()) for w in words]
    pairs = list(zip(words, words[1:], strict=False))
    share = [c / len(raw) for c in Counter(raw).values()]
    known = set(".,;:!?'\"()-\n\r\v\f \t")
    sign = [c for c in t if ord(c) < 128 and not (c.isalnum() or c in known)]
    root = math.sqrt
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(sum(size) / max(len(words), 1)), math.log1p(max(size, default=0)),
        root(len(re.findall("[A-Z]", t)) / n), root(len(re.findall("[0-9]", t)) / n), root(len(sign) / n), root(sum(c in ".,;:!?'\"()-" for c in t) / n), root(t.count("!") / n), root(t.count("|") / n),
        root(sum(ord(c) > 127 for c in t) / n), root(sum(c in "\n\r\v\f" for c in t) / n),
        math.log((len(set(words)) + 0.5) / (len(words) + 0.5)), root(sum(a == b for a, b in pairs) / max(len(pairs), 1)), root(max(Counter(words).values(), default=0) / max(len(words), 1)),
        root(1 - len(set(pairs)) / len(pairs)) if pairs else 0, root(1 - len(set(lines)) / len(lines)) if lines else 0,
        -sum(s * math.log2(s) for s in share), root(sum(s <= 2 for s in size) / max(len(words), 1)), math.log1p(len(words) / (sum(c in ".!?" for c in t) + 1)),
    ]


def texts_of(seed, n):
    r = random.Random(seed)
    pool = ["word", "Word", "é", "x1", "a", "a", "!!", "|", "$$", "日本", "\n", "\n\n", "\t", "end.", "\r", "\x00"]
    return [None, "", " ", "\n", "a", "a a", "é" * 40_000] + [" ".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_statistics(monkeypatch):
    texts = texts_of(1, 200)
    assert len(quality.STATISTICS) == quality.statistics(texts).shape[1]
    want = np.array([plain(t) for t in texts])
    assert np.allclose(quality.statistics(texts), want, atol=1e-9)
    monkeypatch.setattr(quality, "PIECE", 7)
    assert np.allclose(quality.statistics(texts), want, atol=1e-9)


def test_discriminant_by_its_formula(spark):
    r = random.Random(2)
    texts = [(k, " ".join(r.choice(["aa", "bb", "c", "dd.", "É"]) for _ in range(r.randint(3, 60))) if k % 3 else " ".join(["SPAM!!"] * r.randint(1, 9) + ["x$"] * r.randint(0, 3))) for k in range(240)]
    labels = [(k, int(k % 3 > 0)) for k in range(200)] + [(5, 0), (None, 1), (9999, 1), (6, None), (7, 2)]
    df = frame(spark, [*texts, (None, "no id"), (5, texts[5][1])])
    out = quality.classify(df, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    rows = [*texts, (None, "no id"), (5, texts[5][1])]
    x = {t: np.array(plain(t)) for _, t in rows}
    fit = [(x[t], y) for i, t in rows for j, y in labels if i is not None and i == j and y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    xs, ys = np.stack([a for a, _ in fit]), np.array([y for _, y in fit])
    mean, scale = xs.mean(0), xs.std(0)
    scale[scale < 1e-9] = 1
    z = (xs - mean) / scale
    cov = [np.cov(z[ys == k].T, bias=True) for k in (0, 1)]
    share = [np.mean(ys == k) for k in (0, 1)]
    common = share[0] * cov[0] + share[1] * cov[1]
    used = [(1 - quality.ROUND) * ((1 - quality.POOLED) * c + quality.POOLED * common) + quality.ROUND * np.eye(len(mean)) for c in cov]

    def score(t):
        v = (x[t] - mean) / scale
        far = [np.log(share[k]) - 0.5 * (np.linalg.slogdet(used[k])[1] + (v - z[ys == k].mean(0)) @ np.linalg.solve(used[k], v - z[ys == k].mean(0))) for k in (0, 1)]
        return 1 / (1 + np.exp((far[0] - far[1]) / quality.SPREAD))

    got = out.collect()
    assert len(got) == len(rows)
    text_of = {}
    for i, t in rows:
        text_of[i] = t
    for a in got:
        assert abs(a.score - score(text_of[a.doc_id])) < 1e-6 and a.predicted == int(a.score >= 0.5)
        assert a.held_out == (a.doc_id is not None and zlib.crc32(str(a.doc_id).encode()) % 3 == 1)


def test_without_labels(spark):
    docs, none = frame(spark, [(1, "a"), (2, None), (None, "b")]), spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id bigint, quality int")
    assert all(r.score > 0.5 and r.predicted == 1 for r in quality.classify(docs, one).collect())
    assert quality.classify(frame(spark, []), one).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_held_out(spark):
    from weftline.llm.registry import QUERIES

    out = QUERIES["op12_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r.predicted == r.quality for r in out]) > 0.97
    bad, good = ([r.score for r in out if r.quality == k] for k in (0, 1))
    assert np.mean([a < b for a in bad for b in good]) > 0.99
