"""Font probes of a reference and a copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import tallies
from weftline.plans import gates

#: Fixed value: pixels that widths may differ.
WIDTH = 1.0


def census(elements: DataFrame) -> DataFrame:
    """(page, family, weight, size, n): faces of visible text, most frequent first."""
    seen = elements.where("has_text and display <> 'none' and w > 0 and h > 0")
    return seen.groupBy("page", "family", "weight", "size").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first")


def largest(census_rows: DataFrame) -> DataFrame:
    """(page, family, weight, size, n): the largest size of each face."""
    return tallies.largest_of(census_rows, ["page", "family", "weight"], "size", "n")


def summary(probe: DataFrame) -> DataFrame:
    """(scope, side, unchecked, same_as_fallback, no_faces): families whose check is false, those as wide as their fallback, and sides without a face."""
    return probe.groupBy("scope", "side").agg(
        F.array_sort(F.collect_set(F.when(~F.col("check_ok"), F.col("family")))).alias("unchecked"),
        F.array_sort(F.collect_set(F.when(F.abs(F.col("real") - F.col("fallback")) <= 0.5, F.col("family")))).alias("same_as_fallback"),
        (F.max(F.coalesce("faces", F.lit(0))) == 0).alias("no_faces"),
    )


def differences(probe: DataFrame) -> DataFrame:
    """(scope, family, weight, problem) between sides reference and build: checks on one side or of different outcome, widths apart, a fallback that slipped in, unequal face counts."""
    key = ["scope", "family", "weight"]
    side = lambda s, p: probe.where(F.col("side") == s).groupBy(*key).agg(F.max("check_ok").alias(f"{p}_ok"), F.max("real").alias(f"{p}_real"), F.max("fallback").alias(f"{p}_back"), F.max("faces").alias(f"{p}_faces"))
    j = side("reference", "r").join(side("build", "b"), key, "full_outer")
    faces = probe.groupBy("scope").agg(F.max(F.when(F.col("side") == "reference", F.col("faces"))).alias("r"), F.max(F.when(F.col("side") == "build", F.col("faces"))).alias("b")).where("r <> b").select("scope", F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("weight"), F.lit("face counts").alias("problem"))
    ok = F.when(F.col("r_ok").isNull() | F.col("b_ok").isNull(), "one side only").when(F.col("r_ok") != F.col("b_ok"), "checks differ")
    apart = F.when(F.abs(F.col("r_real") - F.col("b_real")) > WIDTH, "widths differ")
    slipped = F.when((F.abs(F.col("r_real") - F.col("r_back")) > WIDTH) & (F.abs(F.col("b_real") - F.col("b_back")) <= WIDTH), "silent fallback")
    found = j.select(*key, F.explode(F.array_compact(F.array(ok, apart, slipped))).alias("problem"))
    return found.unionByName(faces)


def font_gate(probe: DataFrame) -> DataFrame:
    """One gate per scope: fonts agree; without evidence on both sides it is unverified."""
    sides = probe.groupBy("scope").agg(F.count_distinct("side").alias("sides"))
    bad = differences(probe).groupBy("scope").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "family", "weight", "problem"))), "; ").alias("bad"))
    return gates.judged(sides.join(bad, "scope", "left"), "scope", [gates.rule("fonts agree", F.col("bad").isNull(), F.col("bad"), known=F.col("sides") == 2)])
