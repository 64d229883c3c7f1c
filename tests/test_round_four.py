"""Queries on tables in which keys repeat, names share beginnings or documents are many, against plain versions."""

import json
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from tests.test_whole_joins import tables
from weftline.llm import batches, pieces
from weftline.operators import matching, provenance
from weftline.queries import QUERIES


def test_coverage_diff_tells_pages_of_one_url_apart(spark, tmp_path):
    link = lambda x: f'<a href="/{x}">'
    rows = [(1, "http://a.example/", link("one")), (3, "http://a.example/", link("three")), (5, "http://a.example/", link("both"))]
    sf = tables(spark, tmp_path, pages=(rows, "page_id bigint, url string, html string"))
    want = {("https://site.example/one", "sitemap_only"), ("https://site.example/three", "crawl_only")}
    assert {tuple(r) for r in QUERIES["coverage_diff"](spark, sf).select("url", "side").collect()} == want


def test_names_of_all_lengths_resolve_without_a_broadcast_of_them(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab. B") for _ in range(r.randint(0, 7)))
    names, asked = [(word(), r.choice("xyz")) for _ in range(60)] + [(None, "x"), ("abc", None)], [(word(),) for _ in range(300)] + [(None,)]
    flat = lambda t: t.replace(" ", "").replace(".", "").lower()
    want = {}
    for (q,) in asked:
        pairs = [(n, o) for n, o in names if q is not None and n is not None and o is not None]
        found = {o for n, o in pairs if n.strip(" ").lower() == q.strip(" ").lower()}
        found = found or {o for n, o in pairs if len(flat(n)) >= 3 and len(flat(q)) >= 3 and (flat(n).startswith(flat(q)) or flat(q).startswith(flat(n)))}
        want[q] = sorted(found)
    df = matching.resolve(spark.createDataFrame(asked, "q string"), spark.createDataFrame(names, "n string, o string"), "q", "n", "o")
    assert {x.q: x.owners for x in df.collect()} == want
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString()


def test_documents_are_opened_without_tables_in_between(spark, monkeypatch):
    monkeypatch.setattr(provenance, "cut", lambda df: (_ for _ in ()).throw(AssertionError("written")))
    docs = [("a", '{"delay": [[1, 2], "[{\\"", {"x": []}], "n": null}'), ("b", "7"), ("c", "{[[["), ("d", None), ("e", '"\\\\"')]
    got = {tuple(r) for r in provenance.measured_values(spark.createDataFrame(docs, "capture_id string, doc string")).collect()}
    assert got == {
        ("a", "blob", None, "delay"), ("a", "count", None, "3.0"), ("a", "count", None, "2.0"), ("a", "num", "time", "1.0"), ("a", "num", None, "2.0"), ("a", "blob", None, '[{"'), ("a", "blob", None, "x"),
        ("a", "count", None, "0.0"), ("a", "blob", None, "n"), ("b", "num", None, "7.0"), ("e", "blob", None, "\\"),
    }


def test_deep_documents_are_opened_to_the_end(spark):
    deep = "[" * 19 + '{"end": 5}' + "]" * 19
    got = {tuple(r)[1:] for r in provenance.measured_values(spark.createDataFrame([("a", deep)], "capture_id string, doc string")).collect()}
    assert got == {("count", None, "1.0"), ("blob", None, "end"), ("num", None, "5.0")}


def test_documents_are_opened_without_a_job_before(spark):
    """Documents of many depths, two of them of one id, are read as a plain walk reads them, and no job looks at all of them first."""
    docs = [
        ("a", {"duration": 5, "container": {"lines": [[1, 2], [3, 4], []], "x": {}}, "none": None, "yes": True}), ("a", {"duration": 6, "lines": [[1, 2]]}), ("b", []), ("c", {"px": [7, 8, 9], "gap": [[["word", 2]]]}),
        ("d", {"width": [[[[[[1, 2], [[3, 4]]]]]], 5]}), ("e", [[[[1]]]]), ("f", [[[[[1]]]]]), ("g", {"a": {"b": {"c": {"delay": {}}}}}), ("h", {"a": {"b": {"c": {"delay": {"e": [1.5, []]}}}}}),
    ]
    want = set()

    def walk(k, x, role):
        if isinstance(x, dict):
            for key, v in x.items():
                own = "time" if key in ("duration", "delay") else "len" if key in ("container", "px", "width") else role
                want.add((k, "blob", None, key))
                walk(k, v, own)
        elif isinstance(x, list):
            want.add((k, "count", None, f"{len(x)}.0"))
            for i, v in enumerate(x):
                walk(k, v, None if role and len(x) == 2 and i and isinstance(x[1], (int, float)) else role)
        elif isinstance(x, str):
            want.add((k, "blob", None, x))
        elif x is not None and x is not True:
            want.add((k, "num", role, f"{float(x)}"))

    for k, doc in docs:
        walk(k, doc, None)
    frame = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "capture_id string, doc string")
    spark.sparkContext.setJobGroup("opened", "while the frame is made")
    try:
        got = provenance.measured_values(frame)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("opened")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in got.collect()} == want


def test_texts_without_digits_state_themselves(spark):
    texts = {"t": "plain words cubic-bezier(a, b)", "u": "#abc", "v": "5px 6 remx .5s -7. 8.s 9 ms", "w": "rgb(1, 2, 3) ٣px"}
    rows = provenance.measured_values(spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "capture_id string, doc string")).where("class <> 'blob' or capture_id = 't'").collect()
    assert {tuple(r) for r in rows} == {
        ("t", "blob", None, texts["t"]), ("u", "hex", None, "#aabbcc"), ("v", "num", "len", "5.0"), ("v", "num", None, "6.0"), ("v", "num", "time", "0.5"), ("v", "num", None, "-7.0"), ("v", "num", "time", "8.0"), ("v", "num", "time", "9.0"),
        ("w", "hex", None, "#010203"), ("w", "num", None, "1.0"), ("w", "num", None, "2.0"), ("w", "num", None, "3.0"),
    }


def test_untraced_values_broadcast_nothing(spark):
    seen = provenance.measured_values(spark.createDataFrame([("a", '{"width": [12, "#00ff00"], "note": "2026-05"}')], "capture_id string, doc string"))
    said = provenance.asserted_values(spark.createDataFrame([("a", "12px 13px #0f0 #0f1 May 2026 June 2026")], "capture_id string, text string"))
    df = provenance.untraced(said, seen)
    assert {r.raw for r in df.collect()} == {"13px", "#00ff11", "June 2026"}
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString()


def test_steps_of_pieces_take_little_memory():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(200)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    want = [model.encode([t])[0].tolist() for t in texts[:20]]
    model.forget()
    tracemalloc.start()
    got = []
    for part in batches.steps(batch, limit=pieces.STEP_BYTES):
        ids, _, _, count, _ = model.encode(part.column("text").to_pylist())
        got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(texts) and got[:20] == want
    assert peak < 90_000_000
