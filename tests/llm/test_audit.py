"""The filter audit against a plain one."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from weftline.llm import audit

SCHEMA = "doc_id bigint, text string, lang string, part string, mask int, slot int, run int, row string, low bigint, words string, edge boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 1, 1, "x", 1, "x", True) for i, t, lang in rows], SCHEMA)


def plain(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        orders = list(permutations("ABCDE"))
        removed = {(o, k): [d for d in docs if o[k] in d[0] and not d[0] & set(o[:k])] for o in orders for k in range(5)}
        shapley = {f: sum(len(removed[o, o.index(f)]) for o in orders) for f in "ABCDE"}
        for o in orders:
            for k, f in enumerate(o):
                gone = removed[o, k]
                out.append((part, "".join(o), k + 1, sum(not d[0] & set(o[: k + 1]) for d in docs), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley[f]))
    return sorted(out)


def rows_of(seed, n):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["Upper", "É"]
    texts = [None, "", " \x0b\x1c\n", "a | b", "A", "x" * 50_000]
    for _ in range(n):
        words = [r.choice(vocab[: r.choice([3, 402])]) for _ in range(r.choice([5, 199, 200, 230]))]
        texts.append(r.choice([" ", "\t", " \n"]).join(words) + r.choice(["", " 100%", "\x85", "  "]))
    rows = [(k, r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(3 * n)]
    rows += [rows[5], rows[5], (5, "other text of an id", "en"), (None, texts[-1], "en"), (None, texts[-1], "en"), (None, None, None), (-7, texts[8], "xx")]
    return rows


def test_audit(spark):
    rows = rows_of(1, 60)
    labels = [(k, k % 2, k % 3 and 1) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1), (7, None, None)]
    got = audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names and dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["kept"] == "bigint"
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_no_rows(spark):
    assert audit.audit(frame(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []
    assert audit.audit(frame(spark, [(1, None, None)])).where("filter_order = 'EDCBA'").orderBy("step").select("kept", "removed").collect() == [(1, 0), (1, 0), (1, 0), (1, 0), (0, 1)]


def test_copies_across_partitions(spark):
    """Groups of copies that fill many partitions, and batches of one row, with an id that repeats."""
    rows = [(k % 700, "copy" if k % 3 else f"text {k % 40}", "en") for k in range(2100)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size in ("1", "7", "10000"):
            for k, v in zip(before, ("false", "29", size), strict=True):
                spark.conf.set(k, v)
            marks = audit.masks(frame(spark, rows))
            got = sorted((r.doc_id, bool(r.mask & 16)) for r in marks.collect())
            least = {}
            for i, t, _ in rows:
                least[t] = min(i, least.get(t, i))
            assert got == sorted((i, least[t] < i) for i, t, _ in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_text_of_another_fingerprint_order(spark, monkeypatch):
    """Texts that share a fingerprint are told apart, at the borders of partitions too."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[-1]).cast("long") % 2)
    rows = [(k % 150, f"{k % 6}" * (1 + k % 2), "en") for k in range(600)]
    marks = audit.masks(frame(spark, rows))
    least = {}
    for i, t, _ in rows:
        least[t] = min(i, least.get(t, i))
    assert sorted((r.doc_id, bool(r.mask & 16)) for r in marks.collect()) == sorted((i, least[t] < i) for i, t, _ in rows)
