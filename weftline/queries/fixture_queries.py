"""Rule tables and captures that the driver's tables hold no signal for, over fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import fixtures
from weftline.functions import binary, colour, markup, text, urls
from weftline.operators import assets, bundle, copy_gate, crawl, design, fonts, library, motion, provenance, report
from weftline.plans import gates
from weftline.queries.registry import query
from weftline.sources import web

O = "https://studio.example"


def values(*rows) -> str:
    """Rows of plain values as SQL."""
    one = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def gate_table(scopes, names, *violated) -> str:
    """SQL of gate results: every gate passes in every scope but the violated ones (scope, gate, status, detail)."""
    return f"""select s.scope_id, g.gate, coalesce(v.status, 'pass') as status, coalesce(v.detail, '') as detail from ({values(*[(x,) for x in scopes])}) as s(scope_id) cross join ({values(*[(x,) for x in names])}) as g(gate)
 left join ({values(*violated)}) as v(scope_id, gate, status, detail) on v.scope_id = s.scope_id and v.gate = g.gate"""


def listed(columns: str, *rows) -> str:
    return f"select * from ({values(*rows)}) as t({columns})"


DESIGN_GATES = (
    "em dash", "banned strings", "eyebrows", "flat sections", "opening shape", "split runs", "theme", "navigation height", "navigation rows", "hero padding", "first action in view", "headline lines", "hero visual", "below the actions",
    "action contrast", "action contrast over images", "action labels", "form contrast", "form labels", "placeholder contrast", "one accent", "radii", "banned serif", "fonts load", "warm palette", "reduced motion", "marquees", "duplicate intents", "source", "source advice",
)


@query("fixture_copy_gate")
def fixture_copy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_gate.copy_gate(fixtures.copy_pages(spark), match="match_mode")


@query("fixture_linked_types")
def fixture_linked_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_gate.linked_types(fixtures.copy_pages(spark))


@query("fixture_motion_gate", gate_table(
    ("build",), ("moves at all", "signature curves", "structural durations", "stagger", "animated properties", "coverage", "reduced motion"),
    ("build", "signature curves", "FAIL", "cubic-bezier(0.16, 1, 0.3, 1)"),
))
def fixture_motion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.motion_gate(*fixtures.animations(spark))


@query("fixture_ladders")
def fixture_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.animation_ladders(fixtures.animations(spark)[0])


@query("fixture_motion_profile", listed(
    "side, kind, value, n",
    *[(side, kind, value, n) for side, ease in (("reference", "cubic-bezier(0.16, 1, 0.3, 1)"), ("build", "ease")) for kind, value, n in (
        ("easing", ease, 5), ("easing", "linear", 1), ("easing", "ease-out", 1), ("duration", "700", 5), ("duration", "1200", 1), ("duration", "900", 1), ("carrier", "opacity", 6), ("carrier", "transform", 6))],
))
def fixture_motion_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.profile(fixtures.animations(spark)[0])


@query("fixture_motion_summary")
def fixture_motion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.animations(spark)[0]
    return motion.summary(a).join(motion.dropped(a), "side").join(motion.infinite(a), "side")


@query("fixture_font_gate", gate_table(
    ("clean", "wide", "slipped", "one-sided", "empty"), ("fonts agree",),
    ("wide", "fonts agree", "FAIL", "A 400 widths differ"), ("slipped", "fonts agree", "FAIL", "A 400 silent fallback; A 400 widths differ"), ("one-sided", "fonts agree", "FAIL", "B 700 one side only"), ("empty", "fonts agree", "UNVERIFIED", "A 400 one side only"),
))
def fixture_font_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.font_gate(fixtures.font_probe(spark))


@query("fixture_font_summary")
def fixture_font_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.summary(fixtures.font_probe(spark))


@query("fixture_design_gate", gate_table(
    ("clean", "split", "dim", "tall", "blind"), DESIGN_GATES,
    ("blind", "reduced motion", "UNVERIFIED", "no rule for reduced motion"), ("dim", "action contrast", "FAIL", "1"), ("split", "split runs", "FAIL", "3"), ("tall", "navigation height", "FAIL", "96.0"),
))
def fixture_design_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.design_gate(**fixtures.design(spark))


@query("fixture_report_gates")
def fixture_report_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = ("clean", "residue", "low", "placeholder", "bare")
    sides = spark.createDataFrame([(s, side, 3, "A", "400", True, 10.0, 12.0) for s in scopes for side in ("reference", "build")], "scope string, side string, faces int, family string, weight string, check_ok boolean, real double, fallback double")
    return report.report_gates(**fixtures.report(spark), fonts=fonts.font_gate(sides))


@query("fixture_report_verdicts", listed("scope_id, passed, failed, warned, unverified, verdict", ("clean", 17, 0, 0, 0, "PASS"), ("residue", 16, 1, 0, 0, "NOT DONE"), ("low", 15, 2, 0, 0, "NOT DONE"), ("placeholder", 16, 1, 0, 0, "NOT DONE"), ("bare", 3, 0, 0, 14, "PASS on 3 gates")))
def fixture_report_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.roll_up(fixture_report_gates(spark, sf_dir))


@query("fixture_report_markdown")
def fixture_report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.markdown(fixture_report_gates(spark, sf_dir))


@query("fixture_report_missing")
def fixture_report_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.missing_required(fixtures.report(spark)["measurements"])


@query("fixture_library_lint")
def fixture_library_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.lint(*fixtures.library(spark))


@query("fixture_library_index")
def fixture_library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.table_rows(fixtures.library(spark)[1])


@query("fixture_library_lookup")
def fixture_library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("Alpha Works",), ("aw",), ("alpha",), ("bee",), ("Gam",), ("nothing",), ("a",)], "query string")
    return library.spec_or_refusal(asked, fixtures.library(spark)[0])


@query("fixture_library_listing", listed("slug, fidelity", ("alpha.example", "spec"), ("beta.example", "partial"), ("gamma.example", "spec"), ("delta.example", "partial"), ("omega.example", "Partial")))
def fixture_library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.listing(fixtures.library(spark)[0])


@query("fixture_provenance_gate", gate_table(
    ("clean", "made-px", "made-hex", "made-date", "time-is-weight", "rgb", "dropped-hex", "dropped-curve", "joined-thousands", "dwell", "role", "precision", "month", "thin"),
    ("fabricated", "dropped palette", "dropped curves", "thin"),
    ("made-px", "fabricated", "FAIL", "37px"), ("made-hex", "fabricated", "FAIL", "#123456"), ("made-date", "fabricated", "FAIL", "2025-01-02"), ("time-is-weight", "fabricated", "FAIL", "701ms"),
    ("dropped-hex", "dropped palette", "FAIL", "#cc2200"), ("dropped-curve", "dropped curves", "FAIL", "0.16 1 0.3 1"), ("joined-thousands", "fabricated", "FAIL", "440px"), ("dwell", "fabricated", "FAIL", "1.2s"),
    ("role", "fabricated", "FAIL", "700px"), ("precision", "fabricated", "FAIL", "8.33vw"), ("month", "fabricated", "FAIL", "April 2026"), ("thin", "thin", "WARN", "0.0"),
))
def fixture_provenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.provenance_gate(*fixtures.provenance(spark))


@query("fixture_measured_values")
def fixture_measured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.measured_values(fixtures.provenance(spark)[1])


@query("fixture_asserted_values")
def fixture_asserted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.asserted_values(fixtures.provenance(spark)[0])


@query("fixture_bundle_audit")
def fixture_bundle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.audit(*fixtures.bundles(spark))


def crawl_parts(spark: SparkSession, max_pages: int = 30, sitemap_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages and reasons of the small site's crawl."""
    f = fixtures.crawl(spark)
    links = crawl.links(f["pages"])
    mapped = web.sitemap_urls(f["sitemap"], f"{O}/sitemap.xml").select(urls.key(F.col("loc")).alias("key"))
    mapped = mapped.withColumn("ord", F.expr("row_number() over (order by key)"))
    targets = links.select(F.col("target_url").alias("url"), "key").unionByName(mapped.select(F.col("key").alias("url"), "key"))
    blocked = web.robots_blocked(targets, web.robots_rules(f["robots"]))
    reason = urls.follow_policy(F.col("url"), F.lit(O), robots=F.col("robots"))
    allowed = blocked.select("key", reason.alias("reason")).distinct()
    bad = f["pages"].select(urls.key(F.col("url")).alias("key"), crawl.fetch_outcome(F.col("status"), F.col("content_type"), F.col("final_url")).alias("bad")).where("bad is not null")
    gone = mapped.select("key").join(f["pages"].select(urls.key(F.col("url")).alias("key")), "key", "left_anti").withColumn("bad", F.lit("HTTP 404"))
    judged = allowed.join(bad.unionByName(gone), "key", "left").select("key", F.when(F.col("reason") == "follow", F.coalesce("bad", "reason")).otherwise(F.col("reason")).alias("reason"))
    edges = links.select(urls.key(F.col("src_url")).alias("src"), "ord", F.col("key").alias("dst"))
    return crawl.crawl(edges, O, mapped, judged.unionByName(spark.createDataFrame([(O, "follow")], "key string, reason string")).distinct(), max_pages, sitemap_first=sitemap_first)


@query("fixture_crawl_pages", listed("key, depth, seq", (O, 0, 1), (f"{O}/projects/case-one", 1, 2), (f"{O}/articles", 1, 3), (f"{O}/about", 1, 4), (f"{O}/articles/hidden", 1, 5), (f"{O}/articles/visible", 2, 6)))
def fixture_crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_parts(spark)[0]


@query("fixture_crawl_sitemap_first", listed("key, depth, seq", (O, 0, 1), (f"{O}/about", 1, 2), (f"{O}/articles/hidden", 1, 3), (f"{O}/projects/case-one", 1, 4), (f"{O}/articles", 1, 5), (f"{O}/articles/visible", 2, 6)))
def fixture_crawl_sitemap_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_parts(spark, sitemap_first=True)[0]


@query("fixture_crawl_skipped")
def fixture_crawl_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_parts(spark, 3)[1]


@query("fixture_robots", listed("origin, ord, rule", (O, 2, "/private")))
def fixture_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.robots_rules(fixtures.crawl(spark)["robots"])


@query("fixture_sitemap", listed("loc", (f"{O}/articles/hidden",), (f"{O}/never-reachable",), (f"{O}/about",)))
def fixture_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.sitemap_urls(fixtures.crawl(spark)["sitemap"], f"{O}/sitemap.xml")


@query("fixture_asset_fixpoint")
def fixture_asset_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.build(spark)
    return assets.claimed(assets.fixpoint(b["pages"], b["fetched"])[0])


@query("fixture_asset_verdicts", listed(
    "url, why, bucket",
    *[(f"https://cdn.example/{n}", "ok", None) for n in ("main.css", "fonts/a.woff2", "app.mjs", "chunk.mjs", "only-here.png", "hero.png?width=1024", "hero.png?width=512&q=2", "list-chunk-1.json")],
    ("https://cdn.example/fake.png", "HTML body", "integrity_problems"), ("https://cdn.example/list-indexes-1.json", "HTTP 404", "origin_404s"), ("https://site.example/a.webp", "ok", None), ("https://site.example/b.webp", "TimeoutError", "network_failures"),
))
def fixture_asset_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.build(spark)["fetched"]
    return f.select("url", assets.verdict(f).alias("why")).withColumn("bucket", F.when(F.col("why") != "ok", assets.bucket(F.col("why"))))


@query("fixture_rewritten_page")
def fixture_rewritten_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.build(spark)
    named = assets.claimed(assets.fixpoint(b["pages"], b["fetched"])[0]).select(F.col("url").alias("asset_url"), F.concat(F.lit("cdn/"), "name").alias("place"))
    own = assets.harvest(b["pages"], "url", "html", mapped=True).join(named, "asset_url")
    done = assets.relative_rewrite(assets.rewrite(b["pages"], own), own, "url", "html")
    return done.select("slug", markup.neutralised(F.col("html")).alias("html"), markup.neutralised_counts(F.col("html")).alias("changes"))


@query("fixture_build_manifest")
def fixture_build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.build(spark)
    changes = b["pages"].select(F.explode(markup.neutralised_counts(F.col("html"))).alias("name", "n"))
    placed = spark.createDataFrame([("index.html",), ("#inert",)], "place string")
    return assets.build_manifest(b["fetched"], changes, placed)


@query("fixture_media_types", listed("name, kind", ("a.png", "image/png"), ("b.jpg", "image/jpeg"), ("c.png", "image/avif"), ("d.bin", "font/woff2"), ("e.css", "text/css"), ("f.webp", "image/webp"), ("g.mp4", "video/mp4"), ("h.xyz", "application/octet-stream"), ("i.ico", "image/x-icon")))
def fixture_media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.heads(spark).select("name", binary.media_type(F.col("name"), F.col("head")).alias("kind"))


@query("fixture_byte_ranges", listed("raw, bytes", ("10-19", "0A0B0C0D0E0F10111213"), ("0-1,5-6", "00010506"), ("995-2000", "E3E4E5E6E7"), ("1500-1600", ""), ("9-1", None), ("x", None), ("1-2,", None)))
def fixture_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r, bytes(i % 256 for i in range(1000))) for r in ("10-19", "0-1,5-6", "995-2000", "1500-1600", "9-1", "x", "1-2,")], "raw string, payload binary")
    ranges = binary.byte_ranges(F.col("raw"))
    return rows.select("raw", F.hex(F.when(ranges.isNotNull(), binary.sliced(F.col("payload"), ranges))).alias("bytes"))


@query("fixture_import_map", listed("ref, target", ("lib", "https://s.example/v/lib.mjs"), ("pkg/a.mjs", "https://s.example/p/a.mjs"), ("pkg/deep/b.mjs", "https://s.example/d/b.mjs"), ("./c.mjs", "https://s.example/x/c.mjs"), ("./c.mjs", "https://s.example/x/c.mjs")))
def fixture_import_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = '<script type="importmap">{"imports": {"lib": "/v/lib.mjs", "pkg/": "/p/", "pkg/deep/": "/d/"}}</script>'
    rows = spark.createDataFrame([(page, r) for r in ("lib", "pkg/a.mjs", "pkg/deep/b.mjs", "./c.mjs")] + [("<p>", "./c.mjs")], "html string, ref string")
    return rows.select("ref", urls.import_target(F.lit("https://s.example/x/"), F.col("ref"), markup.import_map(F.col("html"))).alias("target"))


@query("fixture_srcset")
def fixture_srcset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("/a.webp 1x, /b.webp 2x",), ("/c.webp",)], "srcset string")
    places = F.create_map(F.lit("/a.webp"), F.lit("cdn/a.webp"))
    return rows.select("srcset", markup.srcset_rewrite(F.col("srcset"), places).alias("new"), markup.srcset_urls(F.col("srcset")).alias("urls"))


@query("fixture_compositing", listed("id, r, g, b", (1, 127.5, 0.0, 127.5), (2, 127.5, 127.5, 127.5), (3, 255.0, 255.0, 255.0)))
def fixture_compositing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, ["rgba(255, 0, 0, 0.5)", "rgb(0, 0, 255)"]), (2, ["rgba(0,0,0,0)", "rgba(0 0 0 / 0.5)"]), (3, [])], "id int, layers array<string>")
    base = F.struct(*[F.lit(255.0).alias(c) for c in "rgb"])
    return rows.select("id", colour.composited(F.transform("layers", colour.rgb), base).alias("c")).select("id", *[F.bround(F.col(f"c.{x}"), 2).alias(x) for x in "rgb"])


@query("fixture_unescape", "select 'a & b ©' as seen union all select null")
def fixture_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("<p>a &amp; b&nbsp;&copy;</p><!-- x --><script>no</script>",), (None,)], "html string")
    return rows.select(text.visible_text(F.col("html")).alias("seen"))
