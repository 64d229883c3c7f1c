"""Prose, search and citation checks of pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import markup, text
from weftline.functions.lexicon import FUNCTION_WORDS, GLUE_WORDS, TELLS
from weftline.plans import gates

#: Shortest text whose phrases count, rate per thousand words, floor, sizes of phrases, phrases kept.
LEAST_WORDS, RATE, FLOOR, SIZES, KEPT = 150, 3.0, 5, (4, 3, 2), 3
#: Texts that are counted at once.
TOGETHER = 256


def frequent_phrases(df: DataFrame, id_col: str, text_col: str, sizes=SIZES, habits: bool = True) -> DataFrame:
    """(id, n, phrase, hits, first, words): phrases over the budget of their text, with the place of the first hit. habits leaves out glue and subject matter.

    Each text is counted by itself, batch by batch: no row leaves its task.
    A null or short text has none; rows that repeat each give theirs.
    """
    tokens = text.tokens(F.col(text_col))
    base = df.select(F.col(id_col).alias("id"), tokens.alias("w")).where(F.size("w") >= LEAST_WORDS).withColumn("budget", text.budget(RATE, FLOOR, F.size("w")).cast("double"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, TOGETHER):
                yield counted(part.slice(at, TOGETHER), sizes, habits)

    return base.mapInArrow(run, f"id {kind}, n int, phrase string, hits bigint, first int, words int").withColumnRenamed("id", id_col)


def counted(part: pa.RecordBatch, sizes, habits: bool) -> pa.RecordBatch:
    """The frequent phrases of some texts (id, w, budget). Phrases are numbered size by size: one of n words is one of n - 1 and a word."""
    w = part.column("w")
    size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = w.flatten().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    glue = np.array([x in GLUE_WORDS for x in words], bool)[code]
    content = np.array([x not in FUNCTION_WORDS for x in words], np.int64)[code]
    budget = part.column("budget").to_numpy(zero_copy_only=False)
    found: list[tuple[np.ndarray, ...]] = []
    number, all_glue, n_content = code, glue, content
    for n in range(2, max(sizes) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        number = np.unique(number[:m] * len(words) + code[n - 1 :], return_inverse=True)[1]
        all_glue, n_content = all_glue[:m] & glue[n - 1 :], n_content[:m] + content[n - 1 :]
        if n not in sizes:
            continue
        keep = owner[:m] == owner[n - 1 :]
        if habits:
            keep &= ~all_glue & (n_content <= n // 3)
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        _, first, hits = np.unique(owner[at] * (int(number.max()) + 1) + number[at], return_index=True, return_counts=True)
        often = hits > budget[owner[at[first]]]
        found.append((at[first[often]], np.full(int(often.sum()), n), hits[often]))
    place, n, hits = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    own = owner[place] if len(place) else place
    phrase = [" ".join(words[c] for c in code[p : p + k].tolist()) for p, k in zip(place.tolist(), n.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [part.column("id").take(pa.array(own)), pa.array(n, pa.int32()), pa.array(phrase, pa.string()), pa.array(hits, pa.int64()), pa.array(place - start[own], pa.int32()), pa.array(size[own], pa.int32())],
        ["id", "n", "phrase", "hits", "first", "words"],
    )


def repeated_phrases(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rank, phrase, hits): phrases a text leans on, at most KEPT, most frequent first.

    Longer phrases come first, and one inside a phrase already kept is passed
    over; that depends on the order, so it folds over each text's few
    candidates.
    """
    ordered = frequent_phrases(df, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("size"), (-F.col("hits")).alias("less"), "first", "phrase"))).alias("found"))
    none = F.array().cast("array<struct<less: bigint, place: int, phrase: string>>")
    kept = F.aggregate(
        "found", none, lambda acc, x: F.when(F.exists(acc, lambda k: F.contains(k["phrase"], x["phrase"])), acc).otherwise(F.array_append(acc, F.struct(x["less"].alias("less"), F.size(acc).alias("place"), x["phrase"].alias("phrase"))))
    )
    return ordered.select(id_col, F.posexplode(F.slice(F.array_sort(kept), 1, KEPT)).alias("rank", "k")).select(id_col, (F.col("rank") + 1).alias("rank"), "k.phrase", (-F.col("k.less")).alias("hits"))


def tell_hits(df: DataFrame, id_col: str, text_col: str, tells=TELLS) -> DataFrame:
    """(id, category, found, allowed): how often each pattern occurs against what a text of its length may hold."""
    words = F.greatest(F.size(text.space_words(F.col(text_col))), F.lit(1))
    base = df.select(id_col, F.col(text_col).alias("__t"), words.alias("__n"))
    rows = F.array(*[F.struct(F.lit(name).alias("category"), F.regexp_count("__t", F.lit(pattern)).alias("found"), text.budget(rate, floor, F.col("__n")).alias("allowed")) for name, pattern, rate, floor in tells])
    return base.select(id_col, F.explode(rows).alias("r")).select(id_col, "r.*")


def dash_density(body: Column, n_words: Column, mark: str = "—") -> tuple[Column, Column]:
    """How often a mark stands in a text, and whether that is too dense for its words."""
    n = F.length(body) - F.length(F.replace(body, F.lit(mark), F.lit("")))
    return n, n > F.greatest(F.lit(2.0), n_words / 150)


def figure_density(body: Column, n_words: Column, figure: str = markup.FIGURE) -> tuple[Column, Column]:
    """How many figures stand in a text, and whether that is less than one in a hundred words."""
    n = F.regexp_count(body, F.lit(figure))
    return n, n / n_words < 0.01


def copy_gate(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", match: str | None = None) -> DataFrame:
    """Gate results of pages. Prose rules are left out where the match column is true: that copy isn't ours to rewrite."""
    flag = F.coalesce(F.col(match), F.lit(False)) if match else F.lit(False)
    base = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), flag.alias("match")).withColumn("text", text.visible_text(F.col("html")))
    base = base.withColumn("n", F.greatest(F.size(text.space_words(F.col("text"))), F.lit(1)))
    prose = base.where("not match")
    em, dense = dash_density(F.col("text"), F.col("n"))
    tells = tell_hits(prose, "id", "text").select(
        F.col("id").cast("string").alias("scope_id"), F.col("category").alias("gate"), F.when(F.col("found") > F.col("allowed"), "FAIL").otherwise("pass").alias("status"), F.when(F.col("found") > F.col("allowed"), F.concat("found", F.lit(" occurrences"))).otherwise("").alias("detail")
    )
    shapes = gates.judged(
        prose.withColumns({"em": em, "dense": dense, "run": text.staccato(F.col("text"))}),
        "id",
        [gates.rule("em-dash density", ~F.col("dense"), F.col("em")), gates.rule("staccato drama", F.col("run") < 4, F.col("run"))],
    )
    habits = repeated_phrases(prose, "id", "text").select(F.col("id").cast("string").alias("scope_id"), F.lit("repetition").alias("gate"), F.lit("WARN").alias("status"), F.concat("phrase", F.lit(" x"), "hits").alias("detail"))
    title = text.html_unescape(F.coalesce(text.first_match(F.col("html"), markup.TITLE), F.lit("")))
    about = text.html_unescape(F.coalesce(text.first_match(F.col("html"), markup.DESCRIPTION), F.lit("")))
    figures, sparse = figure_density(F.col("text"), F.col("n"))
    page = base.withColumns({"title": F.length(F.trim(title)), "about": F.length(F.trim(about)), "h1": F.regexp_count("html", F.lit(markup.H1)), "ld": markup.linked_data(F.col("html")), "bare": markup.images_without_alt(F.col("html")), "figures": figures, "sparse": sparse})
    missing = F.array_compact(F.array(*[F.when(~markup.og_flag(F.col("html"), n), F.lit(n)) for n in ("title", "description", "image")]))
    search = gates.judged(
        page,
        "id",
        [
            gates.rule("title", F.col("title") > 0, "no title"),
            gates.rule("title length", (F.col("title") == 0) | F.col("title").between(15, 65), F.col("title"), "WARN"),
            gates.rule("description", F.col("about") > 0, "no meta description"),
            gates.rule("description length", (F.col("about") == 0) | F.col("about").between(70, 165), F.col("about"), "WARN"),
            gates.rule("one h1", F.col("h1") == 1, F.col("h1")),
            gates.rule("language", F.regexp_like("html", F.lit(markup.LANG)), "no lang attribute"),
            gates.rule("canonical", F.regexp_like("html", F.lit(markup.CANONICAL)), "no canonical link", "WARN"),
            gates.rule("sharing tags", F.size(missing) == 0, F.array_join(missing, ", "), "WARN"),
            gates.rule("image alternatives", F.col("bare") == 0, F.col("bare")),
            gates.rule("structured data", F.size("ld") > 0, "no JSON-LD"),
            gates.rule("structured data parses", F.forall("ld", lambda b: F.try_parse_json(b).isNotNull()), "a block does not parse", "WARN"),
            gates.rule("concrete figures", ~F.col("sparse"), F.concat("figures", F.lit(" in "), "n", F.lit(" words")), "WARN"),
        ],
    )
    return gates.together(tells, shapes, habits, search)


def linked_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, type): types of structured data; lists of items and of types are flattened."""
    blocks = pages.select(id_col, F.explode(markup.linked_data(F.col(html_col))).alias("b")).select(id_col, F.try_parse_json("b").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    own = blocks.where("v is not null").select(id_col, F.explode(items).alias("i"))
    types = F.coalesce(F.try_variant_get("i", '$["@type"]', "array<string>"), F.array(F.try_variant_get("i", '$["@type"]', "string")))
    return own.select(id_col, F.explode(types).alias("type")).where("type is not null and type <> ''")
