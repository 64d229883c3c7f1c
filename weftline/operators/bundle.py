"""Packaging: what may go into a bundle, and what leaks into it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.library import GRADES
from weftline.plans import gates

#: Fixed values: (folder, glob) of files that belong into a bundle, files it needs, and leavings of tools.
ALLOWED = [("", "*.md"), ("", "LICENSE"), ("references", "*.md"), ("scripts", "*.py"), ("scripts", "*.js"), ("scripts/tests", "*.py"), ("library", "INDEX.md"), ("library", "TEMPLATE.md")]
REQUIRED = ("SKILL.md", "README.md", "library/INDEX.md", "library/TEMPLATE.md")
ARTIFACT_NAMES = ("REPORT.md", "report.json", "crawl-manifest.json", "build-manifest.json", ".DS_Store")
ARTIFACT_DIRS = ("__pycache__", "node_modules", "_raw", "site", "cdn", ".git", "captures")
ARTIFACT_EXT = (".pyc", ".zip", ".png", ".jpg", ".webp", ".mp4", ".log")


def glob_pattern(glob: str) -> str:
    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob) + "$"


def folder(rel: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(rel, r"^(.*/)?[^/]*$", 1), "/$", "")


def base(rel: Column) -> Column:
    return F.regexp_extract(rel, r"([^/]*)$", 1)


def allowed(files: DataFrame, rules=ALLOWED) -> DataFrame:
    """files with a column `allowed`: a rule has their folder and fits their name."""
    fits = F.lit(False)
    for where, glob in rules:
        fits = fits | ((folder(F.col("rel")) == where) & F.regexp_like(base(F.col("rel")), F.lit(glob_pattern(glob))))
    return files.withColumn("allowed", fits)


def artifact(rel: Column) -> Column:
    """A leaving by exact name, by any folder on its way, or by extension."""
    dirs = F.split(folder(rel), "/")
    out = base(rel).isin(*ARTIFACT_NAMES) | F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ARTIFACT_DIRS]))
    for e in ARTIFACT_EXT:
        out = out | F.lower(rel).endswith(e)
    return out


def entry_marker(text: Column) -> Column:
    """Text of a filled-in entry: a real grade, or a name without placeholders."""
    grade = F.regexp_like(text, F.lit(rf"(?m)^\*\*Motion fidelity: (?:{'|'.join(GRADES)})\b"))
    return grade | F.regexp_like(text, F.lit(r"(?m)^\*\*Callable as: [^<>{}\n*]+\*\*"))


def scaffold(text: Column) -> Column:
    """The part of an index above its table and first heading of second rank, without table-like lines and blank ends."""
    ls = F.split(text, "\n")
    at = F.array_position(F.transform(ls, lambda x: F.startswith(F.trim(x), F.lit("|")) | x.startswith("## ")), F.lit(True))
    head = F.when(at > 0, F.slice(ls, F.lit(1), (at - 1).cast("int"))).otherwise(ls)
    return F.regexp_replace(F.array_join(F.filter(head, lambda x: ~F.startswith(F.trim(x), F.lit("|"))), "\n"), r"\s+$", "\n")


def corpus_names(entries: DataFrame) -> DataFrame:
    """(name): names that would give away the corpus, longest first: slugs, their first label and callable parts if longer than three."""
    label = F.element_at(F.split("slug", r"\."), 1)
    parts = F.flatten(F.transform("names", lambda n: F.split(n, r"\s+")))
    names = F.concat(F.array("slug"), F.filter(F.array(label), lambda x: F.length(x) > 3), F.filter(parts, lambda x: F.length(x) > 3))
    return entries.select(F.explode(names).alias("name")).select(F.lower("name").alias("name")).distinct().orderBy(F.desc(F.length("name")), "name")


def corpus_traces(files: DataFrame, names: DataFrame) -> DataFrame:
    """(rel, line, name): the first corpus name of each line, bounded by other characters than letters and digits.

    Every run of letters and digits may begin a name and every run may end
    one, so stretches of a line of as many runs as names have join with the
    names for equality. A null text has no lines; a name counts once a line.
    """
    rows = files.select("rel", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "body"))
    run = "[a-z0-9]+"
    sizes = names.select(F.regexp_count(F.lower("name"), F.lit(run)).alias("size")).where("size > 0").distinct()
    # runs and what stands between them by turns: a stretch of n runs is 2 n - 1 parts
    parts = F.regexp_extract_all("body", F.lit(f"{run}|[^a-z0-9]+"), F.lit(0))
    lined = rows.select("rel", "at", parts.alias("parts")).withColumn("from", F.when(F.regexp_like(F.get("parts", 0), F.lit("[a-z0-9]")), 1).otherwise(2))
    starts = lined.join(F.broadcast(sizes), F.size("parts") - F.col("from") + 1 >= 2 * F.col("size") - 1)
    places = F.sequence(F.col("from"), F.size("parts") - 2 * F.col("size") + 2, F.lit(2))
    cut = starts.select("rel", "at", F.inline(F.transform(places, lambda i: F.struct(i.alias("place"), F.array_join(F.slice("parts", i, 2 * F.col("size") - 1), "").alias("name")))))
    hits = cut.join(names.select(F.lower("name").alias("name")).distinct(), "name")
    return hits.groupBy("rel", "at").agg(F.min_by("name", F.struct("place", -F.length("name"))).alias("name")).select("rel", (F.col("at") + 1).alias("line"), "name")


def not_shipped(tree: DataFrame, staged: DataFrame, plumbing=(".git", ".github", ".gitignore")) -> DataFrame:
    """(rel): files of a tree that weren't staged, but for library entries and plumbing."""
    first = F.element_at(F.split("rel", "/"), 1)
    return tree.where((first != "library") & ~first.isin(*plumbing)).select("rel").join(staged.select("rel"), "rel", "left_anti")


def audit(files: DataFrame, names: DataFrame) -> DataFrame:
    """Gate results of bundles (bundle, rel, is_link, size, text)."""
    f = allowed(files.withColumn("fixture", F.col("rel").startswith("scripts/tests/")))
    listed = lambda cond, n: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("rel")))), ", ").alias(n)
    is_entry = F.col("rel").startswith("library/") & ~base(F.col("rel")).isin("INDEX.md", "TEMPLATE.md")
    marked = entry_marker(F.coalesce("text", F.lit(""))) & ~F.col("fixture") & (F.col("rel") != "library/TEMPLATE.md")
    index_rows = (F.col("rel") == "library/INDEX.md") & F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"(?m)^\|.*\]\([^)]+\.md\)"))
    per = f.groupBy("bundle").agg(
        listed(F.col("is_link"), "links"),
        listed(artifact(F.col("rel")), "artifacts"),
        listed(~F.col("allowed") & ~artifact(F.col("rel")), "unexpected"),
        listed(is_entry | marked, "entries"),
        listed(index_rows, "index_rows"),
        F.collect_set("rel").alias("have"),
    )
    lacking = F.array_except(F.array(*[F.lit(r) for r in REQUIRED]), "have")
    traces = corpus_traces(files.where("text is not null").select(F.concat_ws("\x01", "bundle", "rel").alias("rel"), "text"), names)
    traces = traces.groupBy(F.element_at(F.split("rel", "\x01"), 1).alias("bundle")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("traces"))
    rule = gates.rule
    empty = lambda c: F.col(c) == ""
    return gates.judged(
        per.join(traces, "bundle", "left"),
        "bundle",
        [
            rule("symlinks", empty("links"), F.col("links")),
            rule("artifacts", empty("artifacts"), F.col("artifacts")),
            rule("unexpected", empty("unexpected"), F.col("unexpected")),
            rule("library entries", empty("entries"), F.col("entries")),
            rule("index rows", empty("index_rows"), F.col("index_rows")),
            rule("required files", F.size(lacking) == 0, F.array_join(lacking, ", ")),
            rule("corpus traces", F.col("traces").isNull(), F.col("traces"), "WARN"),
        ],
    )
