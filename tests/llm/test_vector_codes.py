"""Vector codes against plain rounds with all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from weftline.llm import vector_codes


def plain(rows, parts=4, entries=256, rounds=4):
    """Codes, errors, label errors and the codebooks' digest, in Python integers."""
    fine = [(i, v, lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not fine:
        return []
    sizes = [len(v) for _, v, _ in fine]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    width = -(-size // parts)
    whole = [(i, [math.floor(1024 * c) for c in v] + [0] * (parts * width - size), lab) for i, v, lab in fine if len(v) == size]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for _, v, _ in whole:
                own.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for k, xs in own.items():
                new[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        books = new
    out = []
    for i, v, lab in whole:
        near = [nearest(cut(v)[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), lab))
    by = {}
    for _, _, e, lab in out:
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, c, e, by[lab], sha) for i, c, e, lab in out]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 0) for i, v, lab in rows], "vec_id bigint, embedding array<float>, label int, code string, error bigint, v int")


def check(spark, rows, **how):
    got = vector_codes.codes(frame(spark, rows), **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows, **how), key=str)


def test_against_plain_rounds(spark):
    r = random.Random(3)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(k, [float(np.float32(c + r.gauss(0, 0.2))) for c in r.choice(centres)], r.choice([0, 1, None])) for k in range(-20, 500)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [1.0, None] * 4, 1), (1003, [float("nan")] * 8, 1), (1004, [float("inf")] + [0.0] * 7, 1), (1005, [0.5] * 9, 1), (None, [0.25] * 8, 0), (3, [0.125] * 8, 7), (3, [0.125] * 8, 7)]
    check(spark, rows)
    check(spark, rows, entries=5)
    check(spark, rows, entries=1, rounds=2)
    check(spark, rows, parts=3, entries=16)


@pytest.mark.parametrize("n", [1, 7, 300])
def test_ties_and_equal_vectors(spark, n):
    """Few values on a coarse grid: most distances tie, entries repeat and stay unused."""
    r = random.Random(n)
    check(spark, [(k, [r.choice([0.0, 0.5, -0.5]) for _ in range(4)], None) for k in range(n)])


def test_no_rows(spark):
    assert vector_codes.codes(frame(spark, [])).collect() == [] and vector_codes.codes(frame(spark, [(1, None, 1)])).collect() == []


def test_large_components(spark):
    """Beyond what floats hold exactly, distances are those of integers; beyond LIMIT components are clamped."""
    r = random.Random(8)
    rows = [(k, [float(np.float32(r.choice([1e4, -9e4, 3e3]) + r.uniform(0, 50))) for _ in range(8)], 0) for k in range(60)]
    check(spark, rows, entries=9)
    out = vector_codes.codes(frame(spark, [(1, [3e38] * 4, 0), (2, [-3e38] * 4, 0)]), entries=1, rounds=0).orderBy("vec_id").collect()
    assert [x.error for x in out] == [0, 4 * (2 * vector_codes.LIMIT) ** 2]


def test_bounds_spare_scans(spark):
    """Clustered vectors: later passes scan few parts in full, and codes are still those of full scans."""
    r = np.random.default_rng(5)
    centres = r.uniform(-1, 1, (20, 8))
    rows = [(int(k), [float(np.float32(c)) for c in centres[k % 20] + r.normal(0, 0.01, 8)], 0) for k in range(1500)]
    _, _, scans = vector_codes.compress(frame(spark, rows), entries=20)
    assert scans[0] > 5000 and sum(scans[2:]) < 0.1 * scans[0]
    check(spark, rows, entries=20)
