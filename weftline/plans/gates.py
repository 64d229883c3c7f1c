"""Gate results: (scope_id, gate, status, detail), and what they add up to.

A status is pass, FAIL, WARN or UNVERIFIED. A measure that is missing is
UNVERIFIED, never pass; WARN never blocks; detail is given when a rule is
violated.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["scope_id", "gate", "status", "detail"]


def rule(gate: str, ok: Column, detail: Column | str = "", bad: str = "FAIL", known: Column | None = None) -> Column:
    """One gate as a struct: pass where ok, `bad` where not, UNVERIFIED where ok or known is null or false."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    measured = ok.isNotNull() if known is None else F.coalesce(known, F.lit(False)) & ok.isNotNull()
    status = F.when(~measured, "UNVERIFIED").when(ok, "pass").otherwise(bad)
    return F.struct(F.lit(gate).alias("gate"), status.alias("status"), F.when(status == "pass", F.lit("")).otherwise(detail.cast("string")).alias("detail"))


def judged(df: DataFrame, scope: str, rules: Iterable[Column]) -> DataFrame:
    """One row per scope and rule."""
    return df.select(F.col(scope).cast("string").alias("scope_id"), F.explode(F.array(*rules)).alias("g")).select("scope_id", "g.*")


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def roll_up(results: DataFrame, strict: bool = False) -> DataFrame:
    """(scope_id, passed, failed, warned, unverified, verdict) of each scope."""
    s = F.col("status")
    out = results.groupBy("scope_id").agg(F.count_if(s == "pass").alias("passed"), F.count_if(s == "FAIL").alias("failed"), F.count_if(s == "WARN").alias("warned"), F.count_if(s == "UNVERIFIED").alias("unverified"))
    verdict = F.when(F.col("failed") > 0, "NOT DONE").when(F.lit(strict) & (F.col("unverified") > 0), "NOT DONE")
    verdict = verdict.when(F.col("unverified") > 0, F.concat(F.lit("PASS on "), F.col("passed"), F.lit(" gates"))).otherwise("PASS")
    return out.withColumn("verdict", verdict)


def summary(results: DataFrame) -> DataFrame:
    """(scope_id, pass, failures, warnings, unverified): a gate's answer, its messages in order."""
    said = F.concat_ws(": ", "gate", F.nullif("detail", F.lit("")))

    def of(status: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("status") == status, said)))

    return results.groupBy("scope_id").agg((F.count_if(F.col("status") == "FAIL") == 0).alias("pass"), of("FAIL").alias("failures"), of("WARN").alias("warnings"), of("UNVERIFIED").alias("unverified"))


def as_json(results: DataFrame) -> DataFrame:
    return summary(results).select("scope_id", F.to_json(F.struct("pass", "failures", "warnings", "unverified")).alias("json"))


def exit_status(results: DataFrame, readable: Column | None = None) -> DataFrame:
    """(scope_id, outcome, code): PASS 0, FAIL 1, UNREADABLE 2."""
    known = F.lit(True) if readable is None else readable
    out = results.groupBy("scope_id").agg(F.bool_or(F.col("status") == "FAIL").alias("bad"), F.bool_and(known).alias("known"))
    outcome = F.when(~F.col("known"), "UNREADABLE").when(F.col("bad"), "FAIL").otherwise("PASS")
    return out.select("scope_id", outcome.alias("outcome"), F.when(~F.col("known"), 2).when(F.col("bad"), 1).otherwise(0).alias("code"))


def markdown(results: DataFrame, title: str = "Report") -> DataFrame:
    """(scope_id, text): a report with the verdict first and a table of gates; bars in texts become slashes."""

    def cell(c: str) -> Column:
        return F.replace(F.col(c), F.lit("|"), F.lit("/"))

    lines = results.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("| "), cell("gate"), F.lit(" | "), F.col("status"), F.lit(" | "), cell("detail"), F.lit(" |")))).alias("lines"))
    head = roll_up(results).select("scope_id", F.concat(F.lit(f"# {title}\n\n**"), F.col("verdict"), F.lit("**\n\n| gate | status | detail |\n|---|---|---|\n")).alias("head"))
    return head.join(lines, "scope_id").select("scope_id", F.concat("head", F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
