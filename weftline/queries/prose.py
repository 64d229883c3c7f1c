"""Queries over the prose of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.lexicon import FUNCTION_WORDS, GLUE_WORDS
from weftline.operators import copy_gate
from weftline.queries.registry import query
from weftline.session import table

TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9'']+', 0)"
SPACE_SQL = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


SAID = " it is not only "
GRAMS_SQL = f"""said as (select doc_id, regexp_replace(text, '[.,]', '{SAID}', 'g') as text from documents), w as (select doc_id, {TOKENS_SQL} as w from said), big as (select * from w where len(w) >= 150),
 g as (select doc_id, n, words, i, w[i:i + n - 1] as gram from (select doc_id, n, w, len(w) as words, unnest(range(1, len(w) - n + 2)) as i from big, (values (2), (3), (4)) as t(n))),
 f as (select doc_id, n, words, i, array_to_string(gram, ' ') as phrase from g
  where len(list_filter(gram, lambda x: not list_contains({_list(GLUE_WORDS)}, x))) > 0 and len(list_filter(gram, lambda x: not list_contains({_list(FUNCTION_WORDS)}, x))) <= n // 3),
 c as (select doc_id, n, phrase, count(*) as hits, min(i) as first from f group by doc_id, n, phrase, words having count(*) > greatest(5, round_even(3.0 * words / 1000, 0)))"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents whose dots and commas are spelled as habits, which invented prose has none of."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[.,]", SAID).alias("text"))


@query("document_tokens", f"select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct from (select doc_id, {TOKENS_SQL} as w from documents)")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query("document_words", f"select doc_id, len({SPACE_SQL}) as n_words from documents")
def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.space_words(F.col("text"))).alias("n_words"))


@query("repeated_phrases_counts", f"with {GRAMS_SQL} select doc_id, n, phrase, hits from c")
def repeated_phrases_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_gate.frequent_phrases(_said(spark, sf_dir), "doc_id", "text").select("doc_id", "n", "phrase", "hits")


@query("repeated_ngrams", f"""with w as (select doc_id, {TOKENS_SQL} as w from documents), big as (select * from w where len(w) >= 150),
 g as (select doc_id, n, len(w) as words, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) as gram from big, (values (2), (3), (4)) as t(n))
 select doc_id, n, array_to_string(gram, ' ') as phrase, count(*) as hits from g group by doc_id, n, words, array_to_string(gram, ' ') having count(*) > greatest(5, round_even(3.0 * words / 1000, 0))""")  # fmt: skip
def repeated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same count without word classes, which the driver's invented prose hardly meets."""
    return copy_gate.frequent_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", habits=False).select("doc_id", "n", "phrase", "hits")


@query(
    "repeated_phrases_top3",
    f"""with {GRAMS_SQL}, o as (select *, row_number() over (partition by doc_id order by n desc, hits desc, first, phrase) as place from c),
 k as (select * from o where not exists (select 1 from o as e where e.doc_id = o.doc_id and e.place < o.place and contains(e.phrase, o.phrase)))
 select doc_id, (row_number() over (partition by doc_id order by hits desc, place))::int as rank, phrase, hits from k qualify rank <= 3""",
)
def repeated_phrases_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_gate.repeated_phrases(_said(spark, sf_dir), "doc_id", "text")


#: Patterns that the driver's invented prose holds, without word boundaries, on which engines differ beside accents.
DRIVER_TELLS = [("the", " the", 40.0, 3), ("of", " of", 25.0, 2), ("que", " que", 20.0, 1), ("und", " und", 20.0, 1)]


@query(
    "tell_budget",
    " union all ".join(
        f"select doc_id, '{name}' as category, len(regexp_extract_all(text, '{pattern}')) as found, greatest({floor}, round_even({rate} * greatest(len({SPACE_SQL}), 1) / 1000, 0))::int as allowed from documents"
        for name, pattern, rate, floor in DRIVER_TELLS
    ),
)
def tell_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_gate.tell_hits(table(spark, sf_dir, "documents"), "doc_id", "text", DRIVER_TELLS)


@query("tell_findings")
def tell_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's own patterns over all documents; invented prose holds next to none, so a fixture pins them."""
    return copy_gate.tell_hits(table(spark, sf_dir, "documents"), "doc_id", "text").where("found > allowed")


@query(
    "staccato_runs",
    r"""with s as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as s from documents),
 r as (select doc_id, i, len(list_filter(string_split_regex(s[i], '\s+'), lambda w: w <> '')) <= 5 as short from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from s)),
 g as (select doc_id, short, i - row_number() over (partition by doc_id, short order by i) as island from r), m as (select doc_id, count(*) as n from g where short group by doc_id, island)
 select d.doc_id, coalesce(max(n), 0) as longest from documents d left join m on d.doc_id = m.doc_id group by d.doc_id""",
)
def staccato_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.staccato(F.col("text")).alias("longest"))


@query("sentence_counts", r"select doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) as n_sentences from documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query("numeric_density", f"select doc_id, numbers, n_words, numbers < 0.01 * n_words as sparse from (select doc_id, len(regexp_extract_all(text, '[0-9][0-9,.:]*')) as numbers, greatest(len({SPACE_SQL}), 1) as n_words from documents)")
def numeric_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_words", F.greatest(F.size(text.space_words(F.col("text"))), F.lit(1)))
    numbers, sparse = copy_gate.figure_density(F.col("text"), F.col("n_words"), "[0-9][0-9,.:]*")
    return docs.select("doc_id", numbers.alias("numbers"), "n_words", sparse.alias("sparse"))


@query("dash_density", f"select doc_id, length(text) - length(replace(text, '-', '')) as dashes, (length(text) - length(replace(text, '-', ''))) > greatest(2.0, greatest(len({SPACE_SQL}), 1) / 150.0) as dense from documents")
def dash_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density rule of em dashes, over hyphens, which the driver's documents hold."""
    n, dense = copy_gate.dash_density(F.col("text"), F.greatest(F.size(text.space_words(F.col("text"))), F.lit(1)), "-")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("dashes"), dense.alias("dense"))


@query("corpus_trace", f"""with p as (select distinct item_id, array_to_string({SPACE_SQL}, ' ') as phrase from (select item_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[\\n' || chr(1) || ']')) as text from benchmark)),
 d as (select doc_id, ' ' || array_to_string({SPACE_SQL}, ' ') || ' ' as body from documents)
 select distinct item_id, doc_id from p, d where phrase <> '' and contains(body, ' ' || phrase || ' ')""")  # fmt: skip
def corpus_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole sentence or line of a benchmark item."""
    from weftline.operators import matching

    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "[\n\x01]")).alias("phrase"))
    return matching.word_phrases_in(table(spark, sf_dir, "documents"), items, "doc_id", "text", "phrase").select("item_id", "doc_id").distinct()


@query("intent_dupes", "with i(intent, phrase) as (values ('a', 'the'), ('a', 'und'), ('a', 'que'), ('b', 'thin'), ('b', 'tion'), ('c', 'eau')), h as (select distinct conv_id, intent, phrase from conversations, i where contains(lower(text), phrase)) select conv_id, intent, count(*) as phrases from h group by conv_id, intent having count(*) > 1")
def intent_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators import design

    intents = spark.createDataFrame([("a", "the"), ("a", "und"), ("a", "que"), ("b", "thin"), ("b", "tion"), ("c", "eau")], "intent string, phrase string")
    return design.duplicate_intents(table(spark, sf_dir, "conversations"), intents, "conv_id", "text")


@query("gate_rollup", """with g as (select source as scope_id, case when toxic = 1 then 'FAIL' when quality = 0 then 'WARN' when quality is null then 'UNVERIFIED' else 'pass' end as status from documents left join labels using (doc_id)),
 s as (select scope_id, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'FAIL') as failed, count(*) filter (status = 'WARN') as warned, count(*) filter (status = 'UNVERIFIED') as unverified from g group by scope_id)
 select *, case when failed > 0 then 'NOT DONE' when unverified > 0 then 'PASS on ' || passed || ' gates' else 'PASS' end as verdict from s""")  # fmt: skip
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.plans import gates

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARN").when(F.col("quality").isNull(), "UNVERIFIED").otherwise("pass")
    return gates.roll_up(rows.select(F.col("source").alias("scope_id"), status.alias("status")))
