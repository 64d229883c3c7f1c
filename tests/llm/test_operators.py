"""The training-data operators against brute force and the libraries, on small and awkward tables."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from weftline.llm import bench_leaks, components, language, licenses, neighbours, passages, pieces, similar, token_counts, token_store, url_filter

EDGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, row string, token string, grp string, n string"
ALPHABET = " \n\tab'éÀ日1-!<|>▁.,"


def noise(n, seed, size=60):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, size))) for _ in range(n)]


def prose(n, seed, words=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["ka", "to", "mi", "ren", "sol", "é"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    return [" ".join(r.choice(vocab) for _ in range(words)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0, "x", "x", "x", "x", "x") for i, t in rows], EDGE)


@pytest.fixture(scope="module")
def edge(spark):
    long_text = " ".join(prose(1, 5, 60_000))
    return [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "text here"), (5, long_text), (6, "   \n "), (7, "x" * 9000), (8, "Grüße aus Köln! <|endoftext|> 1,234")]


def test_token_counts(spark, edge):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = edge + [(100 + i, t) for i, t in enumerate(noise(300, 1))]
    got = sorted(map(tuple, token_counts.token_counts(frame(spark, rows), path).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    assert got == want
    assert token_counts.token_counts(frame(spark, []), path).collect() == []


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces(spark, edge, model):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = edge + [(100 + i, t) for i, t in enumerate(noise(400, 2) + prose(20, 3))]
    df = pieces.encode(frame(spark, rows), path)
    got = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in df.collect()), key=str)
    want = sorted(((i, tuple(lib.encode(t or "")), lib.decode(lib.encode(t or ""))) for i, t in rows), key=str)
    assert got == want
    texts = dict(rows)
    for r in df.where("doc_id >= 100").collect():
        raw = texts[r.doc_id].encode()
        if raw:  # spans cover the text in order and cut no character
            assert r.begins[0] == 0 and r.ends[-1] == len(raw) and all(b <= e for b, e in zip(r.begins[1:], r.ends))
            for b, e in zip(r.begins, r.ends):
                raw[b:e].decode()
        assert model.decode(list(r.ids)) == r.decoded
    assert pieces.encode(frame(spark, []), path).collect() == []


def test_decode_of_any_ids(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(4)
    for _ in range(200):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 29871, 0, 1]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == lib.decode(ids)


def test_character_map(model):
    """The compiled map of a normaliser with rules: the same text as the library, and sources in order."""
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = next(dict(pieces.fields(v))[2] for n, v in pieces.fields(lib.serialized_model_proto()) if n == 3)
    own = pieces.PieceModel.__new__(pieces.PieceModel)
    own.map, own.prefix, own.squeeze = pieces.CharMap(blob), False, False
    for t in ["ｱｲｳ ①②", "ﬁne Ａ", "x\u00a0y\u200bz", "é e\u0301 한국어", "㌔㍍", "plain"] + noise(100, 6):
        text, place = own.normalise(t)
        level = lambda x: re.sub("[ ▁]+", " ", x).strip()
        assert level(text) == level(lib.normalize(t))
        assert len(place) == len(text) + 1 and (np.diff(place) >= 0).all() and (not text or place[-1] == len(t.encode()))


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for line, label in licenses.PHRASES for k in [line.split()] for i in range(len(w)) if w[i : i + len(k)] == k]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, edge):
    r = random.Random(7)
    words = ["MIT", "license", "License.", "apache", "GENERAL", "public", "x", "é", "mit license", "Kelvin", "\u212a"]
    rows = edge + [(100 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(200)]
    rows += [(900, "Redistribution and use in source and binary forms, with or without\n modification, are permitted"), (901, "Redistribution and also use in source and binary forms with or without modification are permitted"), (902, "Licensed under CC BY-NC 4.0.")]
    out = licenses.scan(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in out), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    by = {x.doc_id: x for x in out}
    assert by[900].labels == "bsd" and by[900].score == 1.0 and by[901].labels == "bsd" and by[901].score < 1 and by[902].labels == "cc-by-nc" and by[1].labels == "" and by[1].score == 0.0
    assert all(set(x.base_labels.split(",")) <= set(x.labels.split(",")) for x in out if x.base_labels)
    assert licenses.scan(frame(spark, [])).collect() == []


def test_a_repeated_gram_counts_once(spark):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(1, "of this " * 20), (2, "the license " * 10), (3, licenses.NOTICES[0][0]), (4, long), (5, " ".join(long.split()[:70])), (6, "w1 w2 " * 90)]
    got = {x.doc_id: (x.labels, x.score) for x in licenses.scan(frame(spark, rows), notices=[*licenses.NOTICES, (long, "long")]).collect()}
    assert got == {1: ("", 0.0), 2: ("", 0.0), 3: ("mit", 1.0), 4: ("long", 1.0), 5: ("", 0.0), 6: ("", 0.0)}


def test_license_plan_is_native(spark):
    plan = licenses.scan(frame(spark, [(1, "mit license")]).limit(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark, edge):
    en, de = ["the house is red and the tree is green", "where is the road to the town"], ["das haus ist rot und der baum ist grün", "wo ist der weg in die stadt"]
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in en * 5] + [(t, "de") for t in de * 5])], "doc_id bigint, text string, lang string")
    m = language.fit(train)
    assert m.langs == ["de", "en"]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, [*edge, (20, "the green road"), (21, "der rote weg"), (22, "grünlich"), (23, "12 34 — !")]), m).collect()}
    assert out[20][0] == "en" and out[21][0] == "de" and out[22][0] == "de"
    assert out[1] == out[2] == out[6] == out[23] == ("und", 0.0) and all(0 <= s <= 1 for _, s in out.values())
    assert language.identify(frame(spark, []), m).collect() == []
    nothing = language.fit(train.where("lang = 'none'"))
    assert {r.lang_pred for r in language.identify(frame(spark, [(1, "abc")]), nothing).collect()} == {"und"}


def test_language_against_a_plain_scorer(spark):
    """Words first, then ever shorter n-grams of unseen words, with dictionaries."""
    r = random.Random(29)
    parts = {"aa": ["ka", "to", "mi", "é"], "bb": ["ren", "sol", "ka", "ß"], "cc": ["zu", "wi", "to", "ren"]}
    say = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = [(i, say(lang, 30) + r.choice([".", "!", " 12"]), lang) for i, lang in enumerate(list(parts) * 12)]
    langs = sorted(parts)
    counts: list = [defaultdict(lambda: [0] * 3) for _ in range(language.LONGEST + 1)]
    for _, t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for size in range(language.LONGEST + 1):
                marked = f" {w} "
                for g in [w] if size == 0 else [marked[k : k + size] for k in range(len(marked) - size + 1)]:
                    counts[size][g][langs.index(lang)] += 1

    def row(size, g):
        total = [sum(c[k] for c in counts[size].values()) for k in range(3)]
        return np.array([np.log((counts[size][g][k] + 0.5) / (total[k] + 0.5 * len(counts[size]))) for k in range(3)])

    def word_row(w):
        if w in counts[0]:
            return row(0, w)
        marked, found = f" {w} ", []
        for i in range(len(marked) - 1):
            size = next((n for n in range(language.LONGEST, 0, -1) if i + n <= len(marked) and marked[i : i + n] in counts[n]), None)
            if size:
                found.append(row(size, marked[i : i + size]))
        return language.UNSEEN * np.mean(found, 0) if found else np.zeros(3)

    texts = [(100 + i, say(r.choice(langs), r.randint(1, 6)) + r.choice(["", " kax zuy", " qqq", " Éé ÏÏ"])) for i in range(60)] + [(300, "Ж"), (301, "qq"), (302, "12")]
    model = language.fit(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    assert model.langs == langs
    for x in language.identify(frame(spark, texts), model).collect():
        words = re.findall(r"[^\W\d_]+", dict(texts)[x.doc_id].lower())
        if not words:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        mean = np.mean([word_row(w) for w in words], 0)
        p = np.exp((mean - mean.max()) * min(len(words), language.SURE))
        assert abs(x.score - 1 / p.sum()) < 1e-4
        assert mean[langs.index(x.lang_pred)] > mean.max() - 1e-5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_language_held_out(spark):
    from weftline.llm.registry import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_cuts_resist_shifts():
    text = prose(1, 8, 400)[0].encode()
    a = set(passages.cuts([text])[0].tolist())
    b = {c - 17 for c in passages.cuts([b"something put in " + text])[0].tolist()}
    assert len(a & b) >= len(a) - 2 and len(a) > 20
    assert passages.cuts([b""])[0].tolist() == [] and passages.cuts([]) == []


def test_passages_against_a_plain_chunker(spark):
    """Shared stretches, against chunks cut place by place and counted in dictionaries."""
    M, R = passages.MEMORY, passages.REACH
    r = random.Random(23)
    shared = [prose(1, 90 + k, n)[0] for k, n in enumerate([12, 30, 70])] + ["ab" * 240, "as " * 80, "x" * 400, "é" * 120]
    rows = [(i, prose(1, 4000 + i, 30)[0] + r.choice([" ", "\n", ""]) + shared[i % len(shared)] + r.choice([" ", ""]) + prose(1, 5000 + i, 20)[0]) for i in range(28)]
    rows += [(3, rows[3][1]), (3, "another text " + shared[2]), (None, shared[2]), (40, ""), (41, None)]

    def chunked(raw):
        h = []
        for i in range(len(raw)):
            if i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80:
                h.append(2**32 - 1)
            else:
                h.append((sum(int(passages.GEAR[raw[i - k]]) << k for k in range(M) if i >= k) & 0xFFFFFFFF) >> 1)
        at, last, before = [], None, None
        for i in range(len(raw)):
            if h[i] < 2**32 - 1 and h[i] == min(h[max(0, i - R) : i + R + 1]):
                if before is None or i - before > R or i - last > R:
                    at.append(i + 1)
                    last = i
                before = i
        return at

    for _, t in rows:
        if t:
            raw = t.encode()
            assert passages.cuts([raw])[0].tolist() == [c for c in chunked(raw) if c < len(raw)]
    docs, where = {(i, t) for i, t in rows if i is not None and t}, defaultdict(set)
    for d in docs:
        raw = d[1].encode()
        edge = [0, *[c for c in chunked(raw) if c < len(raw)], len(raw)]
        for a, b in zip(edge, edge[1:]):
            where[raw[a:b]].add(d)
    rank = {(x.doc_id, x.text): (x.doc_id, x.l, x.h) for x in frame(spark, list(docs)).select("doc_id", "text", F.xxhash64("text").alias("l"), F.xxhash64(F.lit(5), "text").alias("h")).collect()}
    want = {}
    for d in docs:
        raw = d[1].encode()
        edge, runs = [0, *[c for c in chunked(raw) if c < len(raw)], len(raw)], [[]]
        for a, b in zip(edge, edge[1:]):
            if len(where[raw[a:b]]) > 1:
                runs[-1].append((a, b, min(where[raw[a:b]], key=rank.get)))
            elif runs[-1]:
                runs.append([])
        runs = [x for x in runs if x and x[-1][1] - x[0][0] >= passages.LEAST]
        if runs:
            gone = sum(b - a for x in runs for a, b, first in x if first != d)
            want[rank[d]] = (min(f[0] for x in runs for _, _, f in x), len(runs), sum(x[-1][1] - x[0][0] for x in runs), gone)
    out = passages.shared(frame(spark, rows)).collect()
    assert {(x.doc_id, x.text_low, x.text_high): (x.first_doc, x.n_passages, x.shared_bytes, x.removed_bytes) for x in out} == want
    assert {x.doc_id for x in out if x.removed_bytes > 100} >= {i for i in range(7, 28) if i % 7 in (2, 3, 4, 5)}


def test_texts_of_repeated_ids_are_cut_apart(spark):
    shared = prose(1, 9, 70)[0]
    rows = [(1, "the first has " + shared), (2, shared + " the second too"), (2, prose(1, 10, 120)[0]), (2, shared + " the second too"), (None, shared), (3, "ab" * 480 + " one"), (4, "ab" * 480 + " two")]
    clash = frame(spark, rows)
    for name in ("doc", "low", "high", "gone", "__gone", "first", "held", "text_low", "place"):
        clash = clash.withColumn(name, F.lit(1))
    out = sorted((x.doc_id or 0, x.text) for x in passages.dedup(clash).collect())
    texts = dict.fromkeys(t for _, t in rows)
    assert [d for d, _ in out] == [0, 1, 2, 2, 2, 3, 4] and [t for d, t in out if d in (0, 1, 3)] == [rows[4][1], rows[0][1], rows[5][1]]
    assert [t in texts for d, t in out if d == 2].count(True) == 1 and all(len(t) < 200 for d, t in out if d == 2 and t not in texts) and len(out[-1][1]) < 200
    assert passages.dedup(clash).columns == clash.columns


def test_passages(spark, edge):
    shared = prose(1, 9, 70)[0]
    rows = [(10 + i, prose(1, 50 + i, 80)[0]) for i in range(30)]
    rows += [(100 + i, prose(1, 150 + i, 40)[0] + " " + shared + " " + prose(1, 250 + i, 40)[0]) for i in range(6)]
    df = frame(spark, rows + edge)
    out = {r.doc_id: r for r in passages.shared(df).collect()}
    assert set(out) == set(range(100, 106))
    assert out[100].removed_bytes == 0 and {out[k].first_doc for k in out} == {100}
    left = {r.doc_id: r for r in passages.dedup(df).where("doc_id is not null").collect()}
    texts = dict(rows)
    assert left[100].text == texts[100] and all(left[i].text == t for i, t in rows if i < 100)
    for i in range(101, 106):
        assert len(left[i].text) < len(texts[i]) - 150
        mine, first = left[i].text.split(), shared.split()
        assert not any(mine[k : k + 51] == first[j : j + 51] for k in range(len(mine) - 50) for j in range(len(first) - 50))
    whole = frame(spark, [(1, shared), (2, shared), (2, shared), (3, None)])
    assert sorted((r.doc_id for r in passages.dedup(whole).collect())) == [1, 3]
    assert passages.shared(frame(spark, [])).collect() == [] and passages.dedup(frame(spark, [])).collect() == []
    assert passages.dedup(df).columns == df.columns


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(rows):
    sets = shingle_sets(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_similar(spark, edge):
    r = random.Random(11)
    rows = []
    for k in range(12):  # chains of edited copies around the threshold
        text = prose(1, 300 + k, r.choice([5, 7, 30, 120]))[0].split()
        for c in range(12):
            own = list(text)
            for _ in range(r.randint(0, 2 + len(own) // 25)):
                own[r.randrange(len(own))] = f"new{r.randrange(9)}"
            rows.append((1000 + 100 * k + c, " ".join(own)))
            text = own if r.random() < 0.4 else text
    common = prose(1, 77, 40)[0]
    rows += [(5000 + i, common + " " + prose(1, 700 + i, 60)[0]) for i in range(20)]
    rows += [(3, "a"), (4, "A"), (8, "a b c"), (9, "a B  c"), (20, ""), (21, None), (22, " ")]
    want = brute_components(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similar.group(frame(spark, rows + [(3, "a"), (None, "a b c")])).collect()}
    assert got.pop(None) == (1, None)
    assert got == want
    assert similar.group(frame(spark, [])).collect() == []


def test_links_are_counted(spark):
    """Every link counts, also between copies of one component that spans groups, and equal sets count document by document."""
    r = random.Random(19)
    rows = []
    for k, copies in enumerate([300, 9, 4]):
        text = prose(1, 800 + k, 60)[0].split()
        for c in range(copies):
            own = list(text)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = f"new{r.randrange(99)}"
            rows.append((1000 * (k + 1) + c, " ".join(own)))
    rows += [(5000, rows[0][1]), (5001, rows[0][1].upper()), (6000, "all alone here"), (6001, None), (6002, "")]
    sets = shingle_sets(rows)
    want = {i: sum(1 for j in sets if j != i and (c := len(sets[i] & sets[j])) and 5 * c >= 4 * len(sets[i] | sets[j])) for i in sets}
    got = {x.doc_id: (x.n_links, x.component_id) for x in similar.linked(frame(spark, rows + [rows[0], (None, rows[0][1])])).collect()}
    assert got.pop(None) == (None, None)
    assert {i: n for i, (n, _) in got.items()} == want and max(want.values()) > 128
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in parent}


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, d))
    return centre[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, d))


def test_neighbours(spark):
    v = vectors(3000, 16, 1).astype(np.float32)
    v[500:900] = v[500]  # one very common vector
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(100_000, None, "x"), (100_100, [0.0] * 16, "x"), (100_200, [float("nan")] * 16, "x"), (100_300, [None] * 16, "x"), (100_400, [1.0, 2.0], "x"), (0, v[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, shard string")
    out = defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), shard=1000).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(out) == set(range(0, 3000, 100))
    hits = 0
    w = v.astype(np.float64)
    for q, found in out.items():
        d = np.sqrt(((w - w[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found) and found == sorted(found, key=lambda x: (x[2], x[1]))
        hits += len(set(want.tolist()) & {i for _, i, _ in found})
        if 500 <= q < 900:
            assert [i for _, i, _ in found] == want.tolist()
    assert hits / (10 * len(out)) >= 0.9
    few = df.where("vec_id in (0, 7, 100)")
    assert neighbours.search(few, few.where("vec_id = 0")).count() == 2
    assert neighbours.search(df.limit(0), df.limit(0)).collect() == []


def test_graph_round_trip():
    g = neighbours.build(np.arange(200), vectors(200, 8, 2))
    h = neighbours.Graph.unpack(g.pack())
    assert (h.links == g.links).all() and (h.vectors == g.vectors).all() and (h.ids == g.ids).all() and h.entry == g.entry


def edited(text, r, edits):
    b = list(text)
    for _ in range(edits):
        k = r.randrange(len(b))
        b[k : k + 1] = r.choice([[], ["q"], [b[k], "z"]])
    return "".join(b)


def test_bench_leaks(spark, edge):
    r = random.Random(12)
    items = [(i, prose(1, 900 + i, 30)[0]) for i in range(12)]
    items += [(90, None), (91, ""), (92, "short one"), (93, items[0][1])]
    rows = [(i, prose(1, 1000 + i, 80)[0]) for i in range(40)]
    rows += [(100 + i, f"{prose(1, 1100 + i, 20)[0]}\n{edited(items[i][1].upper().replace(' ', '  '), r, i // 4)}, {prose(1, 1200 + i, 20)[0]}") for i in range(12)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    out = bench_leaks.regions(frame(spark, rows + edge), bench)
    found = {(x.doc_id, x.item_id): x for x in out.collect()}
    assert {d for d, _ in found} == {100 + i for i in range(12)}
    assert all((100 + i, i) in found for i in range(12)) and (100, 93) in found
    texts = dict(rows)
    for (d, i), x in found.items():
        assert bench_leaks.normal(np.frombuffer(texts[d].encode()[x.begin : x.end], np.uint8), np.zeros(1, np.int64))[0].tobytes().strip()[20:40] in texts[d].lower().encode().replace(b"  ", b" ")
    kept = bench_leaks.clean(frame(spark, rows + edge), bench)
    assert kept.count() == 40 + len(edge)
    assert bench_leaks.regions(frame(spark, []), bench).count() == 0 and bench_leaks.regions(frame(spark, rows), bench.limit(0)).count() == 0


def least_edits(p, t):
    """Fewest edits between p and any stretch of t."""
    p, t = np.frombuffer(p, np.uint8), np.frombuffer(t, np.uint8)
    row, k = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for c in p:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != c))
        row = np.minimum.accumulate(new - k) + k
    return int(row.min())


def test_alignment_is_edit_distance():
    r = random.Random(13)
    items = [(0, prose(1, 40, 12)[0][:60])]
    index = bench_leaks.build(items)

    pattern = index.text[0, : index.size[0]].astype(np.uint8)
    for _ in range(30):
        body = edited(pattern.tobytes().decode(errors="replace"), r, r.randint(0, 3)).encode()[:70]
        text = np.frombuffer(b"xyzxyz" + body + b"xyzxyz", np.uint8)
        best, _ = bench_leaks.align(index, np.array([0]), np.array([0]), 24, text, np.array([0]), np.array([len(text)]))
        assert best[0] == least_edits(pattern.tobytes(), text.tobytes())


def test_regions_against_all_windows(spark):
    """Which documents hold which items, against the edit distance of every window of every item to every stretch of every text."""
    r = random.Random(22)
    items = [(i, prose(1, 60 + i, n)[0]) for i, n in enumerate([9, 12, 14, 20, 8, 1])] + [(7, "What is the capital of France?"), (8, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab"), (9, "Zürich"), (7, "another text of the seventh"), (10, "...")]
    rows = []
    for i, (_, t) in enumerate(items):
        for e in range(6):
            cut = r.randrange(3) * len(t) // 8 if e else 0
            rows.append((100 * i + e, f"{prose(1, 2000 + 10 * i + e, 12)[0]} {edited(t[cut:], r, e)} {prose(1, 3000 + 10 * i + e, 9)[0]}"))
    rows += [(5000, "so: what is the CAPITAL, of france"), (5001, "zürichsee"), (5002, "ZÜRICH!"), (5003, "ab " * 60), (5004, None), (5005, ""), (5006, items[0][1][:40]), (5007, items[0][1][40:])]
    want = set()
    for i, t in items:
        b = bench_leaks.levelled(t).tobytes()
        for d, text in rows:
            own = bench_leaks.levelled(text).tobytes()
            if 0 < len(b) < 40:
                if f" {b.decode()} " in f" {own.decode()} ":
                    want.add((d, i))
            elif b:
                starts = {*range(0, max(len(b) - 64, 0) + 1, bench_leaks.STRIDE), max(len(b) - 64, 0)}
                if any(least_edits(b[a : a + 64], own) <= int(len(b[a : a + 64]) * 0.05) for a in starts):
                    want.add((d, i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in bench_leaks.regions(frame(spark, rows), bench).collect()}
    assert got == want and {(5000, 7), (5002, 9), (5003, 8)} <= got and (5001, 9) not in got
    assert {d for d, _ in got} >= {100 * i for i in range(4)} and len({d for d, i in rows} - {d for d, _ in got}) > 10


def test_leaks_of_repeated_ids(spark):
    item = prose(1, 71, 20)[0]
    rows = [(1, "clean text of its own"), (1, f"here is {item}"), (1, f"here is {item}"), (None, item), (None, "clean too"), (2, None)]
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    df = frame(spark, rows).withColumn("doc", F.lit(1)).withColumn("low", F.lit(1)).withColumn("__leaked", F.lit(1))
    assert sorted(((x.doc_id, x.text) for x in bench_leaks.clean(df, bench).collect()), key=str) == sorted([rows[0], rows[4], rows[5]], key=str)
    out = bench_leaks.regions(df, bench).collect()
    assert sorted(((x.doc_id, x.begin, x.edits) for x in out), key=str) == sorted([(1, 8, 0), (None, 0, 0)], key=str)


def test_hits_of_one_letter_are_bounded():
    """A text of one letter against an item of it: every place hits every q-gram."""
    import tracemalloc

    index = bench_leaks.build([(1, "a" * 200)])
    tracemalloc.start()
    out = bench_leaks.search(index, ["a" * 1_000_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:5] for x in out] == [(0, 1, 0, 1_000_000, 0)] and peak < 500e6


def test_token_store(spark, edge, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = edge + [(100 + i, t) for i, t in enumerate(noise(200, 14) + prose(20, 15) + ["İstanbul ΟΔΟΣ e\u0301", "it's they'LL don't", "<|startoftext|>x", "a\x1cb\u3000c"])] + [(900, edge[5][1])]
    store = token_store.write(frame(spark, rows), path, str(tmp_path / "store"))
    got = sorted(map(tuple, token_store.summary(spark, store).collect()), key=str)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want, key=str)
    back = {r.doc_id: r.ids for r in token_store.read(spark, store).where("doc_id >= 5").collect()}
    assert all(back[i] == [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in rows if i and i >= 5)
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert spark.read.parquet(f"{store}/manifest").agg(F.sum("docs")).first()[0] == len(rows)


def test_damaged_store_fails(spark, tmp_path):
    store = token_store.write(frame(spark, [(1, "some words here")]), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store"))
    bad = spark.read.parquet(f"{store}/chunks").withColumn("ids", F.encode(F.lit("xx"), "UTF-8"))
    bad.write.parquet(f"{store}/bad")
    token_store.remove(spark, f"{store}/chunks")
    spark.read.parquet(f"{store}/bad").write.parquet(f"{store}/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.summary(spark, store).collect()


def test_damaged_recipes_fail(spark, tmp_path):
    """Swapped chunks of the same total length, a lost recipe and a lost chunk fail, in both ways of reading back."""
    rows = [(i, prose(1, 30 + i, 900)[0]) for i in range(6)]
    store = token_store.write(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store"))
    recipes, chunks = spark.read.parquet(f"{store}/recipes"), spark.read.parquet(f"{store}/chunks")
    assert recipes.where("doc_id = 2 and size(chunks) > 1").count() == 1
    named = recipes.where("doc_id = 2").first().chunks[0]
    bad = {
        "recipe of document 2 is damaged": ("recipes", recipes.withColumn("chunks", F.when(F.col("doc_id") == 2, F.reverse("chunks")).otherwise(F.col("chunks")))),
        "shard 0 is damaged": ("recipes", recipes.where("doc_id <> 3")),
        "doesn't have": ("chunks", chunks.where(F.col("digest") != F.lit(named))),
    }
    for k, (said, (part, rows)) in enumerate(bad.items()):
        to = tmp_path / f"bad{k}"
        for name in ("recipes", "chunks", "manifest"):
            (rows if name == part else spark.read.parquet(f"{store}/{name}")).write.parquet(f"{to}/{name}")
        for way in (token_store.summary, token_store.read):
            with pytest.raises(Exception, match=said):
                way(spark, str(to)).collect()


def test_empty_store(spark, tmp_path):
    store = token_store.write(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store"))
    assert token_store.summary(spark, store).collect() == []


def test_id_chunks_resist_shifts():
    ids = np.random.default_rng(1).integers(0, 49000, 20_000).astype("<u2")
    a = token_store.cut_ids(ids)
    b = [e - 5 for e in token_store.cut_ids(np.concatenate([ids[:5], ids]))]
    assert len(set(a) & set(b)) >= len(a) - 3 and max(np.diff([0, *a])) <= token_store.MOST and a[-1] == len(ids)
    assert token_store.cut_ids(ids[:0]) == [] and token_store.merkle([b"a", b"b", b"c"]) != token_store.merkle([b"a", b"c", b"b"])


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best and best[0]


def test_url_filter(spark):
    r = random.Random(16)
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en", "http://a.example.com/en/x?y#z", "http://www.example.com/en/", "http://xwww.example.com/en/1", "ftp://net/es/", "http://x.net#/es/", "http://x://y.com/", "http://é.net/fr/\n1"]
    urls += [f"http://{r.choice(['a.', 'www.', ''])}{r.choice(['example', 'other'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randrange(999)}{r.choice(['', '?a=1&b=2'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)] + [(None, urls[-1], "x", "x"), (12, urls[12], "x", "x")], "page_id bigint, url string, host string, i string")
    out = url_filter.judge(df).collect()
    assert len(out) == len(urls) + 2
    for x in out:
        if x.page_id is not None:
            host, path, rule, verdict = brute_rule(urls[x.page_id])
            assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict in ("allow", "block") and (verdict is None or x.verdict == verdict) and 0 <= x.score <= 1
    assert url_filter.judge(df.limit(0)).collect() == []


def test_trees_learn():
    r = random.Random(17)
    urls = [f"http://{'spam' if k % 2 else 'good'}{r.randrange(99)}.{'biz' if k % 2 else 'org'}/{'1' * r.randrange(9) if k % 2 else 'about'}" for k in range(400)]
    model = url_filter.fit_rows(urls[:300], np.array([k % 2 for k in range(300)], float))
    p = model.probability(urls[300:])
    assert np.mean((p > 0.5) == np.array([k % 2 == 1 for k in range(300, 400)])) > 0.95
    assert url_filter.fit_rows([], np.zeros(0)).probability(["http://x.org/"])[0] < 0.5


def test_merge_is_sequential_bpe():
    from weftline.llm.ragged import PairTable, merge

    r = random.Random(18)
    pairs = [(0, 1), (1, 0), (0, 0), (3, 2), (4, 4)]
    table = PairTable(*(np.array([p[k] for p in pairs]) for k in (0, 1)), np.arange(5), np.array([2, 3, 4, 5, 6]), 10)
    ranks = {p: (k, m) for k, (p, m) in enumerate(zip(pairs, [2, 3, 4, 5, 6]))}

    def slow(s):
        s = list(s)
        while True:
            best = min(((ranks[p][0], k) for k, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if best is None:
                return s
            k = best[1]
            s[k : k + 2] = [ranks[s[k], s[k + 1]][1]]

    seqs = [[r.randrange(2) for _ in range(r.randint(0, 12))] for _ in range(300)] + [[], [0] * 4146] + [[r.randrange(2) for _ in range(4146)]]
    flat, left = merge(np.array([x for s in seqs for x in s], np.int32), np.array([len(s) for s in seqs]), table)
    at = 0
    for s, n in zip(seqs, left.tolist()):
        assert flat[at : at + n].tolist() == slow(s)
        at += n
    # pairs of any ranks and ties, so that a merge may make a pair that goes first
    for trial in range(40):
        made = {}
        while len(made) < 12:
            made[r.randrange(8), r.randrange(8)] = (r.randrange(6), r.randrange(8))
        pairs = list(made)
        table = PairTable(*(np.array([p[k] for p in pairs]) for k in (0, 1)), np.array([made[p][0] for p in pairs]), np.array([made[p][1] for p in pairs]), 8)
        ranks = made
        seqs = [[r.randrange(8) for _ in range(r.randint(0, 30))] for _ in range(30)]
        flat, left = merge(np.array([x for s in seqs for x in s], np.int32), np.array([len(s) for s in seqs]), table)
        assert [x.tolist() for x in np.split(flat, np.cumsum(left)[:-1])] == [slow(s) for s in seqs]
