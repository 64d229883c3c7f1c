"""Comparison of animations between a reference and a build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import matching, tallies
from weftline.plans import gates

#: Properties that carry motion.
CARRIERS = ("opacity", "transform", "filter", "clip-path", "clipPath", "width", "height", "top", "left", "right", "bottom", "translate", "scale", "rotate", "background-color", "backgroundColor", "color", "stroke-dashoffset", "strokeDashoffset")
STRUCTURAL, TOLERANCE, FLOOR, COVERAGE, LEAST_USES = 0.05, 0.15, 16, 0.6, 2


def carriers(animations: DataFrame) -> Column:
    """Properties that an animation moves: its keyframes' and its own, of those that carry motion; else its own alone."""
    keys = F.array_union(F.coalesce(F.map_keys("values.from"), F.array().cast("array<string>")), F.coalesce(F.map_keys("values.to"), F.array().cast("array<string>")))
    known = F.array_intersect(F.array_union(keys, F.array("property")), F.array(*[F.lit(c) for c in CARRIERS]))
    return F.when(F.size(known) == 0, F.array_compact(F.array("property"))).otherwise(known)


def kept(animations: DataFrame) -> DataFrame:
    """Animations without transitions that take no time."""
    return animations.where(~((F.col("kind") == "CSSTransition") & (F.coalesce("duration", F.lit(0)) == 0)))


def dropped(animations: DataFrame) -> DataFrame:
    return animations.groupBy("side").agg(F.count_if((F.col("kind") == "CSSTransition") & (F.coalesce("duration", F.lit(0)) == 0)).alias("dropped"))


def animation_ladders(animations: DataFrame) -> DataFrame:
    """Groups of alike animations that start one after another; see tallies.ladders()."""
    rows = kept(animations).withColumn("to_json", F.to_json("values.to"))
    return tallies.ladders(rows, ["side", "duration", "easing", "to_json"], "delay", "target", "ord").orderBy(F.desc("n"))


def profile(animations: DataFrame) -> DataFrame:
    """(side, kind, value, n): how often each easing, duration and carrier occurs."""
    rows = kept(animations)
    parts = F.array(
        F.struct(F.lit("easing").alias("kind"), F.array(F.col("easing")).alias("values")),
        F.struct(F.lit("duration").alias("kind"), F.array(F.col("duration").cast("int").cast("string")).alias("values")),
        F.struct(F.lit("carrier").alias("kind"), carriers(rows).alias("values")),
    )
    flat = rows.select("side", F.explode(parts).alias("p")).select("side", "p.kind", F.explode("p.values").alias("value")).where("value is not null and value <> ''")
    return flat.groupBy("side", "kind", "value").agg(F.count("*").alias("n"))


def summary(animations: DataFrame) -> DataFrame:
    """(side, total, by_kind, scroll_triggered): what was recorded."""
    counted = animations.groupBy("side", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("firedAtScrollY") > 0).alias("s"))
    return counted.groupBy("side").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"), F.sum("s").alias("scroll_triggered"))


def infinite(animations: DataFrame) -> DataFrame:
    return animations.groupBy("side").agg(F.count_if(F.lower(F.col("iterations").cast("string")) == "infinite").alias("infinite"))


def shortened(easing: Column) -> Column:
    """A long linear() curve as its number of stops."""
    return F.when(easing.startswith("linear(") & (F.length(easing) > 90), F.concat(F.lit("linear("), F.size(F.split(easing, ",")), F.lit(" stops)"))).otherwise(easing)


def trigger_offset(top: Column, viewport_height: Column) -> Column:
    """Where in the viewport an element was when it moved, in percent, halves up."""
    return F.floor(top / viewport_height * 100 + 0.5).cast("int")


def aligned(values: Column, properties: Column, prop: Column) -> Column:
    """The value of a property in lists that repeat: at its index, at that of `all`, or the first."""
    at = F.array_position(properties, prop)
    at = F.when(at > 0, at).when(F.array_position(properties, F.lit("all")) > 0, F.array_position(properties, F.lit("all"))).otherwise(F.lit(1))
    return F.element_at(values, ((at - 1) % F.size(values) + 1).cast("int"))


def fidelity(captures: DataFrame) -> Column:
    """spec if every animation has a target and a trigger, signature-only for easings without numbers, partial for either, else none. captures (animations, easings, numerics)."""
    a = F.coalesce(F.size(F.filter("animations", lambda x: x.isNotNull())), F.lit(0))
    full = F.forall("animations", lambda x: x["target"].isNotNull() & (x["target"] != "") & x["trigger"].isNotNull())
    e, n = F.greatest(F.coalesce(F.size("easings"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size("numerics"), F.lit(0)), F.lit(0))
    return F.when((a > 0) & full, "spec").when((e > 0) & (n == 0), "signature-only").when((e > 0) | (n > 0), "partial").otherwise("none")


def lost_curves(used: DataFrame) -> DataFrame:
    """(value): curves of the reference that the build never uses, from profile()."""
    curves = used.where("side = 'reference' and kind = 'easing'").where(F.contains("value", F.lit("cubic-bezier")) | F.contains("value", F.lit("linear(")))
    return curves.select("value").distinct().join(used.where("side = 'build' and kind = 'easing'"), "value", "left_anti")


def lost_properties(used: DataFrame) -> DataFrame:
    """(value): carriers that the reference moves LEAST_USES times or more and the build never, from profile()."""
    return used.where(f"side = 'reference' and kind = 'carrier' and n >= {LEAST_USES}").select("value").distinct().join(used.where("side = 'build' and kind = 'carrier'"), "value", "left_anti")


def motion_gate(animations: DataFrame, meta: DataFrame, adapt: bool = False, scope: str = "build") -> DataFrame:
    """Gate results of a build's motion against its reference. animations have side reference or build; meta (side, reduced_motion)."""
    rows = kept(animations)
    total = rows.agg(F.count_if(F.col("side") == "reference").alias("ref"), F.count_if(F.col("side") == "build").alias("own"))
    p = profile(animations)
    no_curves = lost_curves(p).agg(F.array_sort(F.collect_list("value")).alias("curves"))
    durations = rows.where("duration is not null").select("side", F.col("duration").cast("double").alias("ms"))
    tiers = tallies.share_tiers(durations.where("side = 'reference'"), "ms", STRUCTURAL).where("tier = 'structural'").select("ms")
    lost_ms = matching.tolerance_anti(tiers, durations.where("side = 'build'").select(F.col("ms").alias("other")), "ms", "other", tolerance=TOLERANCE, floor=FLOOR).agg(F.array_sort(F.collect_list("ms")).alias("durations"))
    lad = animation_ladders(animations).select("side", F.explode_outer("stagger").alias("gap"), "n").where("gap is not null")
    share = tallies.share_tiers(lad.where("side = 'reference'").select(F.col("gap").cast("double").alias("gap")), "gap", STRUCTURAL).where("tier = 'structural'").select("gap")
    built = lad.where("side = 'build'").select(F.col("gap").cast("double").alias("other"))
    lost_gap = matching.tolerance_anti(share, built, "gap", "other", tolerance=TOLERANCE, floor=FLOOR).agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    some = built.agg(F.count("*").alias("ladders"))
    props = lost_properties(p).agg(F.array_sort(F.collect_list("value")).alias("props"))
    reduced = meta.where("side = 'build'").agg(F.max("reduced_motion").alias("reduced"))
    one = total.crossJoin(no_curves).crossJoin(lost_ms).crossJoin(lost_gap).crossJoin(some).crossJoin(props).crossJoin(reduced).withColumn("scope", F.lit(scope))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ")
    stagger = F.struct(
        F.lit("stagger").alias("gate"),
        F.when(F.size("gaps") == 0, "pass").when(F.col("ladders") == 0, "FAIL").otherwise("WARN").alias("status"),
        F.when(F.size("gaps") > 0, listed("gaps")).otherwise("").alias("detail"),
    )
    return gates.judged(
        one,
        "scope",
        [
            gates.rule("moves at all", (F.col("ref") == 0) | (F.col("own") > 0), "nothing moves"),
            gates.rule("signature curves", F.size("curves") == 0, listed("curves")),
            gates.rule("structural durations", F.size("durations") == 0, listed("durations")),
            stagger,
            gates.rule("animated properties", F.size("props") == 0, listed("props"), "WARN"),
            gates.rule("coverage", F.lit(adapt) | (F.col("ref") == 0) | (F.col("own") / F.nullif(F.col("ref"), F.lit(0)) >= COVERAGE), F.concat("own", F.lit(" of "), "ref")),
            gates.rule("reduced motion", F.coalesce("reduced", F.lit(False)), "no rule for reduced motion"),
        ],
    )
