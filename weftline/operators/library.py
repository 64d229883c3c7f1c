"""A library of written entries: scans, integrity rules, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fence_free
from weftline.operators import matching
from weftline.plans import gates

#: The grades of an entry, columns of a specification table, characters of a divider line.
GRADES = ("spec", "partial", "signature-only", "none")
SPEC_COLUMNS = ("name", "trigger", "target", "property", "from", "to", "duration", "easing")
DECLARED = r"(?m)^\*\*Motion fidelity: ([^*\n]+)\*\*"
CALLABLE = r"(?m)^\*\*Callable as: ([^*\n]+)\*\*"
ALIASES = r"(?m)^\*\*Callable as:[^\n]*\(alias(?:es)?: ([^)\n]*)\)"
VIEWPORT = r"@ \d{3,4}x\d{3,4}"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_of(text: Column, at: Column) -> Column:
    """Line number of a place (from 1) in a text."""
    head = F.substring(text, F.lit(1), at.cast("int") - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def cells(line: Column) -> Column:
    """Cells of a markdown table line."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def marks_only(line: Column) -> Column:
    """Whether all characters of a line are those of a table's divider."""
    return F.regexp_like(line, F.lit(r"^[|:\- ]*$"))


def is_divider(line: Column) -> Column:
    return marks_only(line) & F.contains(line, F.lit("-"))


def table_rows(texts: DataFrame, text_col: str = "text", header: str = "Call it") -> DataFrame:
    """(lineno, cells, target, fidelity): table lines but for dividers and the header; the grade is read from the fourth cell alone, in bold."""
    rows = texts.select(F.posexplode(lines(F.col(text_col))).alias("at", "line")).where(F.startswith(F.trim("line"), F.lit("|")) & ~is_divider(F.trim("line")))
    own = rows.select((F.col("at") + 1).alias("lineno"), cells(F.col("line")).alias("cells")).where(F.get("cells", 0) != header)
    fourth = F.coalesce(F.get("cells", 3), F.lit(""))
    grade = F.regexp_extract(fourth, r"(?:\*\*|__)([^*_]+)(?:\*\*|__)", 1)
    return own.select("lineno", "cells", F.regexp_extract(F.array_join("cells", "|"), r"\]\(([^)]+)\)", 1).alias("target"), F.when(grade != "", F.trim(grade)).alias("fidelity"))


def entries(files: DataFrame) -> DataFrame:
    """(file, slug, text, names, aliases, fidelity, declared): entries by name, without INDEX and TEMPLATE. Quotes around aliases go."""
    name = F.regexp_extract("file", r"([^/]+)\.md$", 1)
    kept = files.withColumn("slug", name).where((F.col("slug") != "") & ~F.upper("slug").isin("INDEX", "TEMPLATE"))
    call = F.regexp_extract_all("text", F.lit(CALLABLE), F.lit(1))
    split = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"'`“”]+|[\"'`“”]+$", "")), lambda x: x != "")
    return kept.select(
        "file",
        "slug",
        "text",
        F.transform(call, lambda c: F.trim(F.regexp_replace(c, r"\(.*$", ""))).alias("names"),
        split(F.regexp_extract("text", ALIASES, 1)).alias("aliases"),
        F.regexp_extract_all("text", F.lit(DECLARED), F.lit(1)).alias("declared"),
        F.regexp_extract("text", r"Motion fidelity: ([a-zA-Z-]+)", 1).alias("first_hit"),
        F.when(F.regexp_like("text", F.lit("Motion fidelity: ")), line_of(F.col("text"), F.regexp_instr("text", F.lit("Motion fidelity: ")))).alias("first_line"),
        F.when(F.regexp_like("text", F.lit(DECLARED)), line_of(F.col("text"), F.regexp_instr("text", F.lit(DECLARED)))).alias("declared_line"),
    ).withColumn("fidelity", F.regexp_replace(F.trim(F.get("declared", 0)), r"\s+[—–-].*$", ""))


def names_of(rows: DataFrame) -> DataFrame:
    """(file, slug, name): all names that an entry answers to."""
    return rows.select("file", "slug", F.explode(F.array_distinct(F.concat(F.array("slug"), "names", "aliases"))).alias("name")).where("name <> ''")


def spec_table(text: Column) -> Column:
    """Cells of the header line under an entry's motion heading, outside fences; null without a table."""
    body = F.regexp_extract(fence_free(text), r"(?s)\n## Motion[^\n]*\n(.*?)(?=\n## |$)", 1)
    first = F.get(F.filter(lines(body), lambda x: F.startswith(F.trim(x), F.lit("|"))), 0)
    return F.when(first.isNotNull(), F.transform(cells(first), lambda c: F.lower(c)))


def spec_rows(text: Column) -> Column:
    """How many rows stand under the motion table's divider."""
    body = F.regexp_extract(fence_free(text), r"(?s)\n## Motion[^\n]*\n(.*?)(?=\n## |$)", 1)
    table = F.filter(lines(body), lambda x: F.startswith(F.trim(x), F.lit("|")))
    return F.greatest(F.size(F.filter(table, lambda x: ~is_divider(F.trim(x)))) - 1, F.lit(0))


def lint(files: DataFrame, index: DataFrame) -> DataFrame:
    """Gate results of a library: declarations, specification tables, names, index rows."""
    rows = entries(files)
    wanted = F.array(*[F.lit(c) for c in SPEC_COLUMNS])
    one = gates.judged(
        rows,
        "slug",
        [
            gates.rule("one declaration", F.size("declared") == 1, F.size("declared")),
            gates.rule("legal grade", F.coalesce(F.col("fidelity").isin(*GRADES), F.lit(False)), F.col("fidelity"), known=F.size("declared") >= 1),
            gates.rule("declared before mentioned", F.col("first_line") == F.col("declared_line"), F.concat(F.lit("line "), "first_line"), known=F.size("declared") >= 1),
            gates.rule("specification table", (F.coalesce(F.col("fidelity"), F.lit("")) != "spec") | (F.coalesce(spec_table(F.col("text")) == wanted, F.lit(False)) & (spec_rows(F.col("text")) >= 1)), "columns or rows are missing"),
            gates.rule("callable", F.size("names") >= 1, "no name"),
            gates.rule("viewport", F.regexp_like(F.substring_index("text", "\n## ", 1), F.lit(VIEWPORT)), "no viewport in the header", "WARN"),
        ],
    )
    named = names_of(rows)
    low = named.select("file", F.lower("name").alias("name"))
    clash = matching.collisions(low, "name", "file").select(F.explode("owners").alias("file"), F.col("name").alias("detail"))
    inside = matching.contained_pairs(low, "name", "file").join(low.withColumnRenamed("name", "inner"), "inner").select("file", F.concat("inner", F.lit(" in "), "outer").alias("detail"))
    trouble = lambda d, g: d.join(rows.select("file", "slug"), "file").select(F.col("slug").alias("scope_id"), F.lit(g).alias("gate"), F.lit("FAIL").alias("status"), "detail").distinct()
    grades = table_rows(index).where("target <> ''").select(F.regexp_extract("target", r"([^/]+)\.md", 1).alias("slug"), F.col("fidelity").alias("indexed"), "lineno")
    both = rows.select("slug", "fidelity").join(grades, "slug", "full_outer")
    why = F.when(F.col("indexed").isNull() & F.col("lineno").isNull(), "no index row").when(F.col("fidelity").isNull() & ~F.col("slug").isin([]), "no entry").when(F.col("indexed").isNull(), "no grade in its cell").when(F.col("indexed") != F.col("fidelity"), F.concat(F.lit("index says "), "indexed"))
    listed = both.withColumn("why", why).select(F.col("slug").alias("scope_id"), F.lit("index").alias("gate"), F.when(F.col("why").isNull(), "pass").otherwise("FAIL").alias("status"), F.coalesce("why", F.lit("")).alias("detail"))
    return gates.together(one, trouble(clash, "name clash"), trouble(inside, "name inside another"), listed, orphans(index))


def orphans(index: DataFrame) -> DataFrame:
    """Bullets stranded between the last table row and the next heading of an index."""
    rows = index.select(F.posexplode(lines(F.col("text"))).alias("at", "line"))
    last = rows.where(F.startswith(F.trim("line"), F.lit("|"))).agg(F.max("at").alias("last"))
    heading = rows.crossJoin(F.broadcast(last)).where(F.col("line").startswith("#") & (F.col("at") > F.col("last"))).agg(F.min("at").alias("next"))
    found = rows.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(heading)).where(F.regexp_like("line", F.lit(r"^\s*[-*] ")) & (F.col("at") > F.col("last")) & (F.col("next").isNull() | (F.col("at") < F.col("next"))))
    return found.select(F.lit("INDEX").alias("scope_id"), F.lit("stranded bullets").alias("gate"), F.lit("FAIL").alias("status"), F.concat(F.lit("line "), F.col("at") + 1).alias("detail"))


def lookup(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(query, outcome, slug, owners): names and prefixes resolved to entries."""
    return matching.resolve(asked, names_of(entries(files)), "query", "name", "slug")


def spec_or_refusal(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(query, outcome, slug, text): the motion part of a resolved entry with grade spec, or why it is refused."""
    rows = entries(files).select("slug", "fidelity", F.regexp_extract(fence_free(F.col("text")), r"(?s)\n(## Motion.*?)(?=\n## |$)", 1).alias("part"))
    found = lookup(asked, files).join(rows, "slug", "left")
    refused = F.when(F.col("outcome") != "hit", F.col("outcome")).when(F.col("fidelity") == "spec", "hit").otherwise(F.concat(F.lit("refused: "), F.coalesce("fidelity", F.lit("undeclared"))))
    return found.select("query", refused.alias("outcome"), "slug", F.when(refused == "hit", F.col("part")).alias("text"))


def listing(files: DataFrame) -> DataFrame:
    """(slug, fidelity): specifications first, then by name."""
    return entries(files).select("slug", "fidelity").orderBy(F.coalesce(F.col("fidelity") != "spec", F.lit(True)), "slug")


def counts(files: DataFrame) -> DataFrame:
    return entries(files).agg(F.count("*").alias("entries"), F.count_if(F.col("fidelity") == "spec").alias("spec"))


def pattern_support(rows: DataFrame, pattern: str, entry: str, least: int = 2) -> DataFrame:
    """(pattern, entries): patterns that so many entries or more show."""
    return rows.groupBy(pattern).agg(F.count_distinct(entry).alias("entries")).where(F.col("entries") >= least)


def upserted(index: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Index rows with new ones in place of those of the same key."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def index_row(captures: DataFrame) -> DataFrame:
    """(slug, row): the index line of a capture: grade, top curve and top duration, a dash where there is none."""
    top = lambda c: F.coalesce(F.get(F.get(c, 0), 0), F.lit("—"))
    return captures.select("slug", F.concat(F.lit("| "), "name", F.lit(" | ["), "slug", F.lit("]("), "slug", F.lit(".md) | "), "site", F.lit(" | **"), "fidelity", F.lit("** | "), top("easings"), F.lit(" | "), top("durations"), F.lit(" |")).alias("row"))
