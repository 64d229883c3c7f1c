"""The report of a build: measurements, gates, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import gates

#: Measurements that a report can't do without, and the slack and floor of similarity.
REQUIRED = [
    "mode", "path", "scope.built", "residue.origin_refs", "residue.off_origin", "residue.failed_requests", "links.missing_targets", "links.bare_hash",
    "markup.unexplained", "fonts.evidence", "assets.content_type", "assets.decode_size", "text.pct",
]
SLACK, LOWEST = 0.5, 95.0


def measured(value: Column) -> Column:
    """A value or a note that it wasn't measured, as {status, num, txt, why}."""
    note = F.lower(F.trim(value)).startswith("not measured")
    return F.struct(
        F.when(value.isNull(), "missing").when(note, "not measured").otherwise("measured").alias("status"),
        F.when(~note, value.try_cast("double")).alias("num"),
        F.when(~note, value).alias("txt"),
        F.when(note, F.trim(F.regexp_replace(value, r"(?i)^\s*not measured\s*[—–:-]*\s*", ""))).alias("why"),
    )


def is_score(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def missing_required(measurements: DataFrame) -> DataFrame:
    """(scope, path): required measurements that a scope lacks; with any, its report is refused."""
    wanted = measurements.select("scope").distinct().withColumn("path", F.explode(F.array(*map(F.lit, REQUIRED))))
    return wanted.join(measurements.select("scope", "path"), ["scope", "path"], "left_anti")


def skeleton(spark: SparkSession, scope: str) -> DataFrame:
    """Every measurement as not measured."""
    return spark.createDataFrame([(scope, p, "not measured", None, None, "not yet") for p in REQUIRED], "scope string, path string, status string, num double, txt string, why string")


def wide(measurements: DataFrame) -> DataFrame:
    """One row per scope: a map of numbers and one of texts, of what was measured."""
    own = F.when(F.col("status") == "measured", F.struct("path", "num", "txt"))
    got = F.filter(F.collect_list(own), lambda x: x.isNotNull())
    return measurements.groupBy("scope").agg(got.alias("rows")).select("scope", F.map_from_entries(F.transform("rows", lambda r: F.struct(r["path"], r["num"]))).alias("num"), F.map_from_entries(F.transform("rows", lambda r: F.struct(r["path"], r["txt"]))).alias("txt"))


def report_gates(measurements: DataFrame, pixel_scores: DataFrame, gate_inputs: DataFrame, crawl: DataFrame, args: DataFrame, fonts: DataFrame) -> DataFrame:
    """The seventeen gates of each scope.

    measurements (scope, path, status, num, txt, why); pixel_scores (scope,
    table, slug, breakpoint, similarity_pct, self_ceiling_pct); gate_inputs
    (scope, gate, passed, failures); crawl (scope, sitemap_only, skipped);
    args (scope, mode, path); fonts: gate results of fonts.font_gate().
    """
    n = lambda p: F.try_element_at("num", F.lit(p))
    zero = lambda name, *paths: gates.rule(name, sum((n(p) for p in paths), F.lit(0.0)) == 0, F.concat_ws(", ", *[n(p).cast("string") for p in paths]))
    base = args.join(wide(measurements), "scope", "left")
    ceiling = F.col("self_ceiling_pct")
    sim = F.col("similarity_pct")
    scored = is_score(sim)
    px = pixel_scores.groupBy("scope").agg(
        F.count_if(scored).alias("scores"),
        F.count_if(scored & is_score(ceiling) & (sim < ceiling - SLACK)).alias("below"),
        F.count_if(scored & (sim < LOWEST)).alias("low"),
    )
    unlisted = crawl.select("scope", F.size(F.filter("sitemap_only", lambda u: ~F.map_contains_key(F.col("skipped"), u))).alias("unlisted"))
    subs = gate_inputs.groupBy("scope").pivot("gate", ["motion", "content", "design"]).agg(F.max("passed"))
    j = base.join(px, "scope", "left").join(unlisted, "scope", "left").join(subs, "scope", "left")
    placeholder = F.coalesce(F.lower(F.try_element_at("txt", F.lit("placeholder"))) == "true", F.lit(False))
    mirror = (F.col("mode") == "match") & F.col("path").startswith("mirror")
    unresolved = F.try_element_at("txt", F.lit("geometry.unresolved"))
    scores = F.coalesce("scores", F.lit(0))
    rows = gates.judged(
        j,
        "scope",
        [
            zero("origin references", "residue.origin_refs"),
            zero("off-origin requests", "residue.off_origin"),
            zero("failed requests", "residue.failed_requests"),
            zero("links", "links.missing_targets", "links.bare_hash"),
            zero("unexplained markup", "markup.unexplained"),
            zero("assets", "assets.content_type", "assets.decode_size"),
            gates.rule("sitemap explained", F.col("unlisted") == 0, F.col("unlisted")),
            gates.rule("no score over a placeholder", ~(placeholder & (scores > 0)), "scored a placeholder"),
            gates.rule("own ceiling", F.col("below") == 0, F.col("below"), known=scores > 0),
            gates.rule("similarity floor", F.col("low") == 0, F.col("low"), known=scores > 0),
            gates.rule("text layer", ~mirror | (n("text.pct") == 100), n("text.pct"), known=~mirror | n("text.pct").isNotNull()),
            gates.rule("geometry", (n("geometry.worst_px") == 0) | F.coalesce(F.length(F.trim(unresolved)) > 0, F.lit(False)), n("geometry.worst_px")),
            zero("asset problems", "assets.problems"),
            *[gates.rule(g, F.col(g), f"the {g} gate fails") for g in ("motion", "content", "design")],
        ],
    )
    return gates.together(rows, fonts)


def entries_and_files(crawl_pages: DataFrame) -> DataFrame:
    """(scope, entries, files): crawled pages and the distinct files they share."""
    return crawl_pages.groupBy("scope").agg(F.count("*").alias("entries"), F.count_distinct("slug").alias("files"))


def pixel_band_score(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key..., similarity_pct, within16_pct, max_delta) of two pixel tables (key..., x, y, r, g, b)."""
    a = left.select(*key, "x", "y", *[F.col(c).alias(f"a{c}") for c in "rgb"])
    b = right.select(*key, "x", "y", *[F.col(c).alias(f"b{c}") for c in "rgb"])
    d = [F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in "rgb"]
    j = a.join(b, [*key, "x", "y"]).withColumns({"m": sum(d, F.lit(0)) / 3, "top": F.greatest(*d)})
    return j.groupBy(*key).agg((100 - F.avg("m") / 255 * 100).alias("similarity_pct"), (F.avg(F.when(F.col("top") <= 16, 100.0).otherwise(0.0))).alias("within16_pct"), F.max("top").alias("max_delta"))


def band_scores(pairs: DataFrame, left: str, right: str, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """pairs with (band, similarity_pct, within16_pct, max_delta): two packed rasters compared band by band.

    left and right are arrays of samples from 0 to 255, row by row; a band is
    the samples from one place up to another (from 0). Samples that only one
    side has differ by 255; a band beyond both is empty and scores null. Each
    pair is compared where it is, as arrays, so no pixel is a row.
    """
    a, b = F.col(left), F.col(right)
    apart = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y), F.lit(255)).cast("int"))
    rows = pairs.withColumn("__apart", apart)
    cut_ = F.array(*[F.struct(F.lit(n).alias("band"), F.slice("__apart", F.lit(lo + 1), F.lit(hi - lo)).alias("d")) for n, (lo, hi) in bands.items()])
    d, n = F.col("__band.d"), F.size("__band.d")
    total = F.aggregate(d, F.lit(0).cast("long"), lambda acc, x: acc + x)
    scored = rows.withColumn("__band", F.explode(cut_)).withColumns({
        "band": F.col("__band.band"),
        "similarity_pct": F.when(n > 0, 100 - total / n / 255 * 100),
        "within16_pct": F.when(n > 0, F.size(F.filter(d, lambda x: x <= 16)) / n * 100),
        "max_delta": F.array_max(d),
    })
    return scored.drop("__apart", "__band")


def text_layer(left: DataFrame, right: DataFrame) -> DataFrame:
    """(page, chars, same, pct): characters that stand at the same place in two texts of a page, against the longer one."""
    j = left.select("page", F.col("text").alias("a")).join(right.select("page", F.col("text").alias("b")), "page", "full_outer")
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "")
    same = F.size(F.filter(F.arrays_zip(split("a").alias("x"), split("b").alias("y")), lambda p: F.coalesce((p["x"] == p["y"]) & (p["x"] != ""), F.lit(False))))
    size = F.greatest(F.length(F.coalesce("a", F.lit(""))), F.length(F.coalesce("b", F.lit(""))))
    return j.select("page", size.alias("chars"), same.alias("same")).withColumn("pct", F.when(F.col("chars") == 0, 100.0).otherwise(F.col("same") / F.col("chars") * 100))


def suite_totals(lines: DataFrame) -> DataFrame:
    """(suite, passed, failed, state) of the check lines (suite, line, ok) of test suites: crashed without a failed check, skipped without any."""
    s = lines.groupBy("suite").agg(F.count_if(F.col("line").startswith("pass")).alias("passed"), F.count_if(F.col("line").startswith("FAIL")).alias("failed"), F.bool_and("ok").alias("ok"))
    return s.select("suite", "passed", "failed", F.when(~F.col("ok") & (F.col("failed") == 0), "crashed").when(F.col("ok") & (F.col("passed") + F.col("failed") == 0), "skipped").when(F.col("failed") > 0, "failed").otherwise("passed").alias("state"))


def phase_residual(scores: DataFrame, slack: float = SLACK) -> DataFrame:
    """(band, phase): whether what differs between two sides also differs between two waits of one side (band, cross_pct, self_pct)."""
    return scores.select("band", (F.abs(F.col("cross_pct") - F.col("self_pct")) <= slack).alias("phase"))


def variants(loads: DataFrame) -> DataFrame:
    """(page, states): pages whose state differs between loads."""
    return loads.groupBy("page").agg(F.count_distinct("state").alias("states")).where("states > 1")
