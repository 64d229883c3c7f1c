"""Tables that must grow and samples that must not come out empty."""

import random

import numpy as np
import pytest

import public_tokenizers
from weftline.llm import batches, language, pieces, token_store, url_filter


def words(n, seed):
    r = np.random.default_rng(seed)
    letters = np.concatenate([r.integers(97, 123, (n, 6), np.uint8), np.full((n, 1), 32, np.uint8)], 1)
    return letters.tobytes().decode().rstrip()


def test_numbers_against_a_dictionary():
    r = np.random.default_rng(1)
    table, known = batches.Numbers(4), {}
    for size in (1, 3, 0, 50, 1000, 20_000):
        new = np.setdiff1d(np.unique(r.integers(1, 1 << 63, size, np.int64).astype(np.uint64)), np.array(list(known), np.uint64))
        table.add(new, np.arange(len(known), len(known) + len(new), dtype=np.int32))
        known.update(zip(new.tolist(), range(len(known), len(known) + len(new)), strict=True))
        asked = np.concatenate([np.array(list(known), np.uint64), r.integers(1, 1 << 63, 99, np.int64).astype(np.uint64)])
        assert table.find(asked).tolist() == [known.get(h, -1) for h in asked.tolist()]
        assert 10 * table.taken <= 6 * len(table.keys)


@pytest.mark.parametrize("n", [10_000, 20_000, 120_000])
def test_pieces_of_more_units_than_slots(monkeypatch, n):
    import sentencepiece

    monkeypatch.setattr(pieces, "SLOTS", 1 << 10)
    monkeypatch.setattr(pieces, "TOGETHER", 9000)
    monkeypatch.setattr(pieces, "REMEMBER", 30_000)
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    for seed in (1, 2):
        texts = [words(n, seed), "a b", words(n // 2, seed + 5)]
        ids, _, _, count, decoded = own.encode(texts)
        assert np.split(ids, np.cumsum(count)[:-1])[0].tolist() == lib.encode(texts[0]) and ids.tolist() == [i for t in texts for i in lib.encode(t)]
        assert decoded == texts


@pytest.mark.parametrize("n", [10_000, 20_000, 120_000])
def test_word_ids_of_more_units_than_slots(monkeypatch, n):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SLOTS", 1 << 10)
    monkeypatch.setattr(token_store, "AT_ONCE", 9000)
    monkeypatch.setattr(token_store, "REMEMBER", 30_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), token_store.WordEncoder(path)
    for seed in (1, 2):
        texts = [words(n, seed), "a b", words(n // 2, seed + 5)]
        assert [x.tolist() for x in own.encode(texts, 2)] == [lib.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_samples(spark):
    """Repeated rows are taken together, no value is lost, a small share isn't none, and large samples are about as large as asked for."""
    same = spark.createDataFrame([(7, "t", "a")] * 39 + [(8, "t", "b")] * 2, "i bigint, t string, l string")
    for most in (1, 2, 10):
        got = batches.sampled(same, "l", ["i", "t"], most).collect()
        assert {r.l for r in got} == {"a", "b"} and len(got) == 41
    many = spark.range(20_000).selectExpr("id as i", "cast(id as string) as t", "if(id % 1000 = 0, 'rare', 'much') as l", "id as __value2")
    got = batches.sampled(many, "l", ["i", "t"], 500, least=10)
    n = {r.l: r["count"] for r in got.groupBy("l").count().collect()}
    assert 400 < n["much"] < 600 and 3 <= n["rare"] <= 20 and got.columns == many.columns
    assert batches.sampled(many, "l", ["i", "t"], 10**6).count() == 20_000
    by_size = batches.sampled(many.where("l = 'much'"), "l", ["i"], 10**6, batches.F.lit(1000), 10**6).count()
    assert 900 < by_size < 1100
    assert batches.sampled(many.limit(0), "l", ["i"], 5).count() == 0


def test_a_share_below_a_millionth(spark, monkeypatch):
    monkeypatch.setattr(batches, "TOP", 1 << 63)
    rows = spark.createDataFrame([(k, f"text {k}", "en" if k % 2 else "de") for k in range(100)], "doc_id bigint, text string, lang string")
    got = batches.sampled(rows, "lang", ["doc_id"], 1, batches.F.lit(1e9), 1).collect()
    assert {r.lang for r in got} == {"en", "de"} and len(got) <= 4


def test_language_of_repeated_rows(spark):
    rows = [(1, "the red house", "en")] * 39 + [(2, "das rote haus", "de")] * 3 + [(3, "12 34", "xx")]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), docs=1)
    assert model.langs == ["de", "en", "xx"]
    asked = spark.createDataFrame([(1, "the house"), (2, "das haus"), (3, "½ 12 ²"), (4, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()} == {1: "en", 2: "de", 3: "und", 4: "und"}


def test_labels_without_any_letter(spark):
    model = language.fit(spark.createDataFrame([(1, "12", "en"), (2, "", "de")], "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(1, "abc"), (2, "1")], "doc_id bigint, text string")
    assert model.langs == ["de", "en"] and {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()} == {1: "de", 2: "und"}


def test_one_rule_for_words(spark):
    """Numbers that count as word characters are no letters, for fitting as for predicting."""
    assert language.words_of("Tapis½ x² Ⅷ É_b3c") == ["tapis", "x", "é", "b", "c"] and language.words_of(None) == []
    model = language.fit(spark.createDataFrame([(1, "tapis½ rouge", "fr"), (2, "carpet red", "en")], "doc_id bigint, text string, lang string"))
    assert (model.words.find(language.hashes(["tapis", "rouge", "carpet"])) >= 0).all()


def test_url_fit_on_repeated_urls(spark):
    r = random.Random(4)
    urls = [("http://a.example.com/en/1", "block"), ("http://b.com/", "allow"), ("http://c.net/es/", "block"), ("http://d.com/x", "allow")]
    model = url_filter.fit(spark.createDataFrame([r.choice(urls) for _ in range(4000)], "u string, v string"), "u", "v", most=400)
    assert model.prior == 2.5 / 6
    many = [(f"http://s{k}.{'biz' if k % 5 == 0 else 'org'}/{k}", "block" if k % 5 == 0 else "allow") for k in range(3000)]
    model = url_filter.fit(spark.createDataFrame(many, "u string, v string"), "u", "v", most=300)
    assert model.trees and 0.1 < model.prior < 0.3
    assert url_filter.fit(spark.createDataFrame(many, "u string, v string"), "u", "v", most=1).prior == 1.5 / 4


def test_rows_of_one_id_fill_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_DOCS", 20)
    docs = spark.createDataFrame([(7 if k % 3 else None if k % 2 else k, f"word {k % 11}") for k in range(200)], "doc_id bigint, text string")
    store = token_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store"))
    sizes = [r["count"] for r in spark.read.parquet(f"{store}/recipes").groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 60
    rows = token_store.summary(spark, store).collect()
    assert len(rows) == 200 and sorted(r.start for r in rows) == [sum(sorted_n[:k]) for sorted_n in [[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]] for k in range(200)]
