"""The pipeline against brute force on a small corpus, and its stages on awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, prose
from weftline.session import held

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r = random.Random(21)
    passage, item = prose(1, 31, 70)[0], prose(1, 32, 40)[0]
    rows = [(i, prose(1, 400 + i, 90)[0]) for i in range(40)]
    rows += [(100 + i, " ".join(w if r.random() > 0.01 else "changed" for w in rows[i][1].split())) for i in range(5)]
    rows += [(200 + i, prose(1, 500 + i, 50)[0] + " " + passage + " " + prose(1, 600 + i, 50)[0]) for i in range(4)]
    rows += [(300 + i, prose(1, 700 + i, 50)[0] + " " + item + " " + prose(1, 800 + i, 50)[0]) for i in range(3)]
    rows += [(400, None), (401, ""), (402, "12 34"), (403, rows[7][1])]
    return rows, passage, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, _, item = corpus()
    to = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], SCHEMA).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to)


def test_run(spark, folder):
    rows, passage, item = corpus()
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    comp = brute_components(rows)
    gone = {400, 401, 402} | {i for i, (_, c) in comp.items() if c != i and i < 400} | {403} | {300}  # what repeats of the item in 301 and 302 goes with the passages
    assert set(out) == {i for i, _ in rows} - gone
    texts = dict(rows)
    for i, r in out.items():
        if i in (201, 202, 203, 301, 302):
            assert len(r.decoded) < len(texts[i]) - 100
        else:
            assert r.decoded == texts[i]
        assert r.n_tokens == len(r.ids) == len(r.begins)


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = held(stage(spark, docs, folder))
        assert new.columns == docs.columns and new.count() <= docs.count() and new.dtypes == docs.dtypes
        docs = new
    assert docs.where("length(text) <> n_chars").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_tables(spark, folder, k):
    schema = SCHEMA + ", digest string, `row` string, grp string, component string, text_hash bigint"
    awkward = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "text here"), (6, "  \n"), (7, "é" * 5000)]
    df = spark.createDataFrame([(i, t, None, None, None, "x", "x", "x", "x", 1) for i, t in awkward], schema)
    stage = corpus_pipeline.STAGES[k][1]
    rows = stage(spark, df, folder).collect()
    ids = sorted((r.doc_id for r in rows), key=str)
    want = {0: [1, 2, 3, 3, 6, 7, None], 1: [1, 2, 3, 6, 7, None], 2: [1, 2, 3, 3, 6, 7, None], 3: [1, 2, 3, 3, 6, 7, None], 4: [1, 2, 3, 3, 6, 7, None]}[k]
    assert ids == sorted(want, key=str)
    assert stage(spark, df.limit(0), folder).collect() == []


def test_near_copies_of_repeated_ids(spark, folder):
    """Rows that repeat an id with other texts are documents of their own; repeated rows are one."""
    text = [prose(1, 60 + i, 60)[0] for i in range(4)]
    near = text[0].rsplit(" ", 1)[0] + " changed"
    rows = [(1, text[0]), (2, text[1]), (2, text[2]), (2, text[2]), (3, near), (3, text[3]), (None, text[0]), (4, text[3]), (5, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], SCHEMA).withColumn("lost", F.lit(1)).withColumn("place", F.lit(2))
    out = corpus_pipeline.join_similar(spark, df, folder)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, text[0]), (2, text[1]), (2, text[2]), (3, text[3]), (None, text[0]), (5, ""), (5, None)], key=str)


def test_released_tables_are_gone(spark, folder, tmp_path):
    from weftline import session

    session.release(spark)
    where = tmp_path / "t"
    spark.range(3).write.parquet(str(where))
    session.kept(spark, str(where))
    one = held(spark.range(5), "one")
    assert one.count() == 5 and where.exists()
    session.discard(one)
    session.release(spark)
    assert not where.exists()
