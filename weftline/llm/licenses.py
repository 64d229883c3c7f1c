"""Operator 3: license scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases that count place by place, and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Openings of well-known license texts and notices, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
#: Fixed value: what stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a rolling gram.
K = 2
#: Diagonals of one template up to so far apart are one span: as many words at most may be put in, or dropped, in all of it.
DRIFT = 6
#: Share of a notice's grams that a span must hold in their order.
COVER = 0.8
#: Places of a template that one number holds as bits.
BITS = 63


def words(text: Column) -> Column:
    """Words of a text as an array; none for null. Only ASCII letters matter to a match, and the one other letter that lower() turns into ASCII goes first."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit(" ")))
    return F.array_remove(F.split(low, BETWEEN), "")


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """One row per gram of a template: its number, label, place, number of grams, words and hash. A parameter, so of known size."""
    rows = []
    for t, (line, label) in enumerate([*phrases, *notices]):
        w = line.split(" ")
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {line}")
        rows += [(t, label, t < len(phrases), p, len(w) - K + 1, w[p], w[p + 1]) for p in range(len(w) - K + 1)]
    names = ["template", "label", "phrase", "place", "grams", "one", "two"]
    grams = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))
    return grams.withColumn("hash", F.xxhash64("one", "two"))


def set_bits(number: Column, first: int) -> Column:
    """The bits of a number that are set, counted from `first`."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda p: F.getbit(number, p) == 1), lambda p: p + first)


def in_order(hits: Column, grams: Column) -> Column:
    """The most of a template's grams that stand in a text in their order, each after the one before: hits are (at, back) in order, back the place counted backwards so that one word of the text counts once."""
    zeros = F.array_repeat(F.lit(0), grams)

    def step(best: Column, hit: Column) -> Column:
        # best[p]: most grams of a row that ends with the gram of place p
        p = -hit["back"]
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), p)), F.lit(0))
        return F.transform(best, lambda x, k: F.when(k == p, F.greatest(x, before + 1)).otherwise(x))

    return F.array_max(F.aggregate(hits, zeros, step))


def spans(df: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, label, phrase, first, last, cover): each span that a template matches, in words of the text.

    Every rolling gram of K words is joined by hash to the grams of the
    templates and its words are compared; hits vote for the diagonal (place in
    the text less place in the template). A phrase takes only diagonals with
    all its grams. A notice merges each diagonal with those up to DRIFT behind
    it; where these together hold COVER of its grams, each counted once, the
    span is verified: as many must stand in the text in the template's order.
    So a span is DRIFT words longer than its template at most. cover is the
    share of grams in order. Spans of one label that begin at the same word
    are one. A null text has no words and no spans; rows that repeat with the
    same id and text give the same spans once; a null id is a value.
    """
    grams = F.broadcast(template_grams(df.sparkSession, phrases, notices))
    w = F.col("w")
    rolled = (
        df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), words(F.col(f"`{text_col}`")).alias("w"))
        .where(F.size("w") >= K)
        .select("doc_id", "text_hash", F.posexplode(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))).alias("b"))).alias("at", "g"))
        .select("doc_id", "text_hash", "at", F.col("g.a").alias("a"), F.col("g.b").alias("b"))
        .where("b is not null")
        .withColumn("h", F.xxhash64("a", "b"))
    )
    key = ["doc_id", "text_hash", "template", "label", "phrase", "grams"]
    hits = rolled.join(grams, (F.col("h") == F.col("hash")) & (F.col("a") == F.col("one")) & (F.col("b") == F.col("two")))
    hits = hits.select(*key, "at", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    # the places that a diagonal hits as bits, so that a place counts once however many diagonals hit it
    place = F.col("at") - F.col("diagonal")
    parts = range(max(len(line.split(" ")) for line, _ in [*phrases, *notices]) // BITS + 1)
    masks = [F.bit_or(F.when(F.floor(place / BITS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (place % BITS).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"places{k}") for k in parts]
    diagonals = hits.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), *masks)
    whole = diagonals.where("phrase and votes = grams").select("doc_id", "text_hash", "label", "phrase", "first", (F.col("last") + K - 1).alias("last"), F.lit(1.0).alias("cover"))
    behind = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, DRIFT)
    held = sum((F.bit_count(F.bit_or(f"places{k}").over(behind)) for k in parts), F.lit(0))
    merged = diagonals.where("not phrase").withColumn("near", F.collect_list(F.struct("diagonal", *[f"places{k}" for k in parts])).over(behind)).withColumn("held", held).where(F.col("held") >= COVER * F.col("grams"))
    # the hits of the merged diagonals, taken from their bits: DRIFT + 1 for each gram of the template at most
    places = merged.select(*key, F.col("diagonal").alias("start"), F.explode("near").alias("one_of")).select(*key, "start", F.col("one_of.diagonal").alias("diagonal"), F.explode(F.concat(*[set_bits(F.col(f"one_of.places{k}"), k * BITS) for k in parts])).alias("place"))
    verified = (
        places.groupBy(*key, "start")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("diagonal") + F.col("place")).alias("at"), (-F.col("place")).alias("back")))).alias("hits"))
        .withColumn("cover", in_order(F.col("hits"), F.col("grams")) / F.col("grams"))
        .where(F.col("cover") >= COVER)
        .groupBy("doc_id", "text_hash", "label", "phrase", F.element_at("hits", 1)["at"].alias("first"))
        .agg((F.max(F.element_at("hits", -1)["at"]) + K - 1).alias("last"), F.max("cover").alias("cover"))
    )
    return whole.unionByName(verified)


def scan(df: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts the places of phrases; first_word and last_word are the
    smallest and largest start of one, null without any; base_labels are their
    labels and labels those of notices too, distinct, sorted and joined by
    commas, empty without any; score is the largest share of a template's
    grams that a span holds, 0 without any. A null text has no words. Repeated
    rows each give the same row; a null id is kept and matched as a value.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("n_words"))
    labels = sorted({label for _, label in [*phrases, *notices]})

    def names(only: Column) -> Column:
        return F.concat_ws(",", *[F.max(F.when((F.col("label") == x) & only, F.lit(x))) for x in labels])

    found = (
        spans(df, phrases, notices, id_col, text_col)
        .groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("th"))
        .agg(
            F.count_if("phrase").alias("n"),
            F.min(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("last_word"),
            names(F.col("phrase")).alias("bl"),
            names(F.lit(True)).alias("l"),
            F.max("cover").alias("s"),
        )
    )
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("th")), "left").select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("bl", F.lit("")).alias("base_labels"),
        F.coalesce("l", F.lit("")).alias("labels"),
        F.coalesce("s", F.lit(0.0)).alias("score"),
    )
