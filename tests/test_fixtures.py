"""Rule tables and captures over fixtures: the clean case passes, and each broken one breaks what it is meant to."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import fixtures
from weftline.functions import binary, colour, markup, text, urls
from weftline.operators import assets, bundle, capture, copy_gate, crawl, design, fonts, library, matching, motion, ordering, provenance, report, tallies
from weftline.plans import gates, sinks
from weftline.queries import QUERIES
from weftline.sources import landing, web


def broken(df):
    return {(r.scope_id, r.gate, r.status) for r in df.where("status <> 'pass'").collect()}


def rows(spark, name):
    return QUERIES[name](spark, "").collect()


def test_copy_gate(spark):
    got = broken(QUERIES["fixture_copy_gate"](spark, ""))
    assert not {g for g in got if g[0] == "clean"}
    assert {g for s, g, _ in got if s == "tells"} == {"7  AI vocabulary", "9  negative parallelism", "4  promotional language", "5  vague attribution"}
    assert {x for x in got if x[0] == "habit"} == {("habit", "repetition", "WARN")}
    assert {g for s, g, k in got if s == "bare" and k == "FAIL"} == {"title", "description", "one h1", "language", "image alternatives", "structured data"}
    assert {k for s, _, k in got if s == "matched"} == {"WARN"}


def test_linked_types(spark):
    assert {r.type for r in rows(spark, "fixture_linked_types") if r.page_id == "clean"} == {"Organization", "Store", "WebSite"}


def test_motion(spark):
    assert broken(QUERIES["fixture_motion_gate"](spark, "")) == {("build", "signature curves", "FAIL")}
    ladder = [r for r in rows(spark, "fixture_ladders") if r.side == "reference"]
    assert len(ladder) == 1 and ladder[0].n == 5 and ladder[0].stagger == [60] and ladder[0].easing == "cubic-bezier(0.16, 1, 0.3, 1)"
    assert {(r.side, r.dropped, r.infinite) for r in rows(spark, "fixture_motion_summary")} == {("build", 1, 1), ("reference", 1, 1)}
    assert [r.n for r in rows(spark, "fixture_motion_profile") if (r.side, r.value) == ("reference", "900")] == [1]


@pytest.mark.parametrize("case, gate, status", [("still", "moves at all", "FAIL"), ("unreduced", "reduced motion", "FAIL"), ("stagger", "stagger", "WARN"), ("unstaggered", "stagger", "FAIL"), ("slow", "structural durations", "FAIL"), ("few", "coverage", "FAIL")])
def test_motion_breaks(spark, case, gate, status):
    a, meta = fixtures.animations(spark)
    a = a.withColumn("easing", F.when(F.col("easing") == "ease", "cubic-bezier(0.16, 1, 0.3, 1)").otherwise(F.col("easing")))
    build = F.col("side") == "build"
    card = build & F.col("name").startswith("card")
    if case == "still":
        a = a.where(~build)
    elif case == "unreduced":
        meta = meta.withColumn("reduced_motion", F.col("side") == "reference")
    elif case == "stagger":
        a = a.withColumn("delay", F.when(card, F.col("delay") * 3).otherwise(F.col("delay")))
    elif case == "unstaggered":
        a = a.withColumn("delay", F.when(card, 0).otherwise(F.col("delay")))
    elif case == "slow":
        a = a.withColumn("duration", F.when(card, 900).otherwise(F.col("duration")))
    else:
        a = a.where(~card | (F.col("ord") < 2))
    assert ("build", gate, status) in broken(motion.motion_gate(a, meta))


def test_fidelity(spark):
    df = spark.createDataFrame(
        [("a", [("x", "y")], ["e"], [1.0]), ("b", [("x", None)], ["e"], []), ("c", [], [], [1.0]), ("d", [], [], [])], "id string, animations array<struct<target: string, trigger: string>>, easings array<string>, numerics array<double>"
    )
    assert {r.id: r.f for r in df.select("id", motion.fidelity(df).alias("f")).collect()} == {"a": "spec", "b": "signature-only", "c": "partial", "d": "none"}


def test_motion_kernels(spark):
    df = spark.createDataFrame([(["opacity", "all", "top"], ["1s", "2s"], "linear(" + ", ".join(["0.5"] * 40) + ")")], "p array<string>, v array<string>, e string")
    r = df.select(motion.aligned(F.col("v"), F.col("p"), F.lit("top")).alias("top"), motion.aligned(F.col("v"), F.col("p"), F.lit("left")).alias("left"), motion.shortened(F.col("e")).alias("e"), motion.trigger_offset(F.lit(405.0), F.lit(900.0)).alias("o")).first()
    assert (r.top, r.left, r.e, r.o) == ("1s", "2s", "linear(40 stops)", 45)


def test_fonts(spark):
    assert broken(QUERIES["fixture_font_gate"](spark, "")) == {("empty", "fonts agree", "UNVERIFIED"), ("one-sided", "fonts agree", "FAIL"), ("slipped", "fonts agree", "FAIL"), ("wide", "fonts agree", "FAIL")}
    s = {(r.scope, r.side): r for r in rows(spark, "fixture_font_summary")}
    assert s["clean", "reference"].unchecked == ["B"] and s["clean", "reference"].same_as_fallback == ["B"] and s["empty", "reference"].no_faces
    c = spark.createDataFrame([("p", 0, "A", "400", 16, True, "block", 1.0, 1.0), ("p", 1, "A", "400", 48, True, "block", 1.0, 1.0), ("p", 2, "A", "400", 48, False, "block", 1.0, 1.0)], "page string, ord int, family string, weight string, size int, has_text boolean, display string, w double, h double")
    assert [(r.size, r.n) for r in fonts.largest(fonts.census(c)).collect()] == [(48, 1)]


def test_design(spark):
    assert broken(QUERIES["fixture_design_gate"](spark, "")) == {("blind", "reduced motion", "UNVERIFIED"), ("dim", "action contrast", "FAIL"), ("split", "split runs", "FAIL"), ("tall", "navigation height", "FAIL")}


@pytest.mark.parametrize("lum, status", [([1.0] * 6, None), ([1.0] * 3 + [0.1] * 3, "WARN"), ([1.0, 0.1, 1.0, 0.1, 1.0, 0.1], "FAIL")])
def test_theme_crossings(spark, lum, status):
    f = fixtures.design(spark)
    f["sections"] = f["sections"].withColumn("bg_lum", F.element_at(F.array(*map(F.lit, lum)), F.col("idx") + 1))
    got = {x for x in broken(design.design_gate(**f)) if x[:2] == ("clean", "theme")}
    assert got == ({("clean", "theme", status)} if status else set())


def test_source_hits(spark):
    files = spark.createDataFrame([("src/a.css", "x\ncolor: red; color: red"), ("node_modules/b.css", "color: red"), (".cache/c.css", "color: red"), ("src/d.md", "color: red")], "rel string, text string")
    rules = spark.createDataFrame([("color: red", "FAIL", "no red")], "pattern string, tier string, message string")
    assert [tuple(r) for r in design.source_hits(files, rules).collect()] == [("src/a.css", 2, "FAIL", "no red")]


def test_element_rules(spark):
    els = spark.createDataFrame(
        [("p", "h", "P", "NEW", 12.0, 1.2, "uppercase", (100.0, 0.0, 50.0, 10.0)), ("p", "h", "P", "FAR", 12.0, 1.2, "uppercase", (700.0, 0.0, 50.0, 10.0)), ("p", "h", "H2", "Title", 40.0, 0.0, "none", (140.0, 0.0, 500.0, 50.0))],
        "page string, host string, tag string, text string, font_size double, letter_spacing double, text_transform string, rect struct<top: double, left: double, width: double, height: double>",
    )
    assert [r.text for r in design.eyebrows(els).collect()] == ["NEW"]
    b = spark.createDataFrame([("BUTTON", None, 0.0, 0.0, 0.0, False), ("INPUT", "hidden", 0.0, 0.0, 0.0, False), ("A", None, 10.0, 10.0, 0.5, False), ("A", None, 2.0, 2.0, 0.5, True)], "tag string, input_type string, padding_left double, padding_right double, bg_alpha double, border boolean")
    assert sorted(r.tag for r in design.button_like(b).collect()) == ["A", "BUTTON"]
    r = spark.range(1).select(design.required_contrast(F.lit(18.66), F.lit(700)).alias("a"), design.required_contrast(F.lit(18.0), F.lit(900)).alias("b"), design.line_count(F.lit(50.0), F.lit(None).cast("double"), F.lit(20.0)).alias("c")).first()
    assert tuple(r) == (3.0, 4.5, 2)
    radii = spark.createDataFrame([("c", 40.0, 40.0, 20.0), ("c", 100.0, 50.0, 8.4), ("c", 100.0, 50.0, 0.0), ("c", 4.0, 4.0, 2.0)], "case string, w double, h double, radius double")
    assert {(r.value, r.uses) for r in design.radii(radii).collect()} == {("pill", 1), ("8", 1)}


def test_sections_and_visibility(spark):
    schema = "tag string, style map<string,string>, rect struct<top: double, left: double, width: double, height: double>, in_nav boolean, viewport_w int"
    els = spark.createDataFrame(
        [("SECTION", {}, (0.0, 0.0, 1200.0, 400.0), False, 1440), ("SECTION", {"opacity": "0.01"}, (0.0, 0.0, 1200.0, 400.0), False, 1440), ("FOOTER", {}, (0.0, 0.0, 1200.0, 400.0), False, 1440), ("DIV", {}, (0.0, 0.0, 300.0, 400.0), False, 1440), ("DIV", {"display": "none"}, (0.0, 0.0, 1200.0, 400.0), False, 1440)], schema
    )
    assert [r.tag for r in design.sections_of(els).collect()] == ["SECTION"]


def test_report(spark):
    got = broken(QUERIES["fixture_report_gates"](spark, ""))
    assert not {g for g in got if g[0] == "clean"}
    assert {g for g in got if g[0] == "residue"} == {("residue", "origin references", "FAIL")}
    assert {g for g in got if g[0] == "low"} == {("low", "own ceiling", "FAIL"), ("low", "similarity floor", "FAIL")}
    assert {g for g in got if g[0] == "placeholder"} == {("placeholder", "no score over a placeholder", "FAIL")}
    v = {r.scope_id: r for r in rows(spark, "fixture_report_verdicts")}
    assert v["clean"].passed == 17 and v["clean"].verdict == "PASS" and v["low"].verdict == "NOT DONE" and v["bare"].verdict == "PASS on 3 gates"
    strict = {r.scope_id: r.verdict for r in gates.roll_up(QUERIES["fixture_report_gates"](spark, ""), strict=True).collect()}
    assert strict["bare"] == "NOT DONE" and strict["clean"] == "PASS"
    assert {r.scope for r in rows(spark, "fixture_report_missing")} == {"bare"}
    text_ = {r.scope_id: r.text for r in rows(spark, "fixture_report_markdown")}
    assert text_["low"].startswith("# Report\n\n**NOT DONE**") and text_["clean"].count("\n| ") == 18


def test_report_kernels(spark):
    df = spark.createDataFrame([("not measured — no browser",), ("  Not Measured",), ("3.5",), (None,)], "v string")
    assert [(r.m.status, r.m.num, r.m.why) for r in df.select(report.measured(F.col("v")).alias("m")).collect()] == [("not measured", None, "no browser"), ("not measured", None, ""), ("measured", 3.5, None), ("missing", None, None)]
    assert report.skeleton(spark, "s").where("status = 'not measured'").count() == len(report.REQUIRED)
    px = lambda d: spark.createDataFrame([("b", x, 0, 100 + d * x, 100, 100) for x in range(4)], "band string, x int, y int, r int, g int, b int")
    r = report.pixel_band_score(px(0), px(17), ["band"]).first()
    assert r.max_delta == 51 and r.within16_pct == 25.0 and round(r.similarity_pct, 3) == round(100 - (17 + 34 + 51) / 12 / 255 * 100, 3)
    a, b = (spark.createDataFrame([("p", t)], "page string, text string") for t in ("abcd", "abXde"))
    assert tuple(report.text_layer(a, b).select("chars", "same").first()) == (5, 3)
    s = spark.createDataFrame([("a", "pass x", True), ("a", "FAIL y", False), ("b", "", False), ("c", "", True)], "suite string, line string, ok boolean")
    assert {r.suite: r.state for r in report.suite_totals(s).collect()} == {"a": "failed", "b": "crashed", "c": "skipped"}
    assert report.phase_residual(spark.createDataFrame([("m", 98.02, 98.07), ("n", 90.0, 99.0)], "band string, cross_pct double, self_pct double")).where("phase").count() == 1
    assert report.variants(spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "page string, state string")).count() == 1
    assert [tuple(r) for r in report.entries_and_files(spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b")], "scope string, slug string")).collect()] == [("s", 3, 2)]


def test_gate_summary(spark):
    g = QUERIES["fixture_font_gate"](spark, "")
    assert {r.scope_id: r["pass"] for r in gates.summary(g).collect()}["wide"] is False
    assert {r.scope_id: r.outcome for r in gates.exit_status(g).collect()}["clean"] == "PASS"
    assert json.loads(gates.as_json(g).where("scope_id = 'wide'").first().json)["failures"]


def test_library(spark):
    got = broken(QUERIES["fixture_library_lint"](spark, ""))
    assert {g for s, g, _ in got if s == "alpha.example"} == set()
    for want in [("beta.example", "name clash"), ("beta.example", "index"), ("gamma.example", "specification table"), ("delta.example", "declared before mentioned"), ("omega.example", "legal grade"), ("omega.example", "index"), ("zeta.example", "index"), ("INDEX", "stranded bullets")]:
        assert (*want, "FAIL") in got
    found = {r.query: (r.outcome, r.slug) for r in rows(spark, "fixture_library_lookup")}
    assert found["aw"] == ("hit", "alpha.example") and found["Gam"][1] == "gamma.example" and found["bee"][0] == "ambiguous" and found["a"][0] == "miss"
    assert [r.slug for r in rows(spark, "fixture_library_listing")][:2] == ["alpha.example", "gamma.example"]
    assert library.counts(fixtures.library(spark)[0]).first().spec == 2
    new = spark.createDataFrame([("a", 2)], "slug string, v int")
    assert sorted(map(tuple, library.upserted(spark.createDataFrame([("a", 1), ("b", 1)], "slug string, v int"), new).collect())) == [("a", 2), ("b", 1)]
    cap = spark.createDataFrame([("s", "S", "s.example", "spec", [["ease", "9"]], [])], "slug string, name string, site string, fidelity string, easings array<array<string>>, durations array<array<string>>")
    assert library.index_row(cap).first().row == "| S | [s](s.md) | s.example | **spec** | ease | — |"


def test_provenance(spark):
    got = broken(QUERIES["fixture_provenance_gate"](spark, ""))
    assert {g for g in got if g[0] in ("clean", "rgb")} == set()
    for case, gate, status in [("made-px", "fabricated", "FAIL"), ("made-hex", "fabricated", "FAIL"), ("made-date", "fabricated", "FAIL"), ("time-is-weight", "fabricated", "FAIL"), ("dropped-hex", "dropped palette", "FAIL"), ("dropped-curve", "dropped curves", "FAIL"), ("thin", "thin", "WARN"), ("joined-thousands", "fabricated", "FAIL"), ("dwell", "fabricated", "FAIL"), ("role", "fabricated", "FAIL"), ("precision", "fabricated", "FAIL"), ("month", "fabricated", "FAIL")]:
        assert {g for g in got if g[0] == case} == {(case, gate, status)}, case


def test_roles_of_keys_and_units(spark):
    """Roles come from whole words of key names as the rules have them, and from units."""
    doc = {"items": [7.5], "dwell": 11.5, "hold_s": 12.5, "gutter": 13.5, "container": 14.5, "rhythm": 15.5, "gap": 16.5, "size": 17.5, "note": "18.5ms 19.5px 20.5s 21.5 #abc 22x33 rgb(1, 2, 300)", "curve_ms": "cubic-bezier(0.1, .2, 1, 1) cubic-bezier(a, 7, 8)"}
    rows = [(r["class"], r.role, r.value) for r in provenance.measured_values(spark.createDataFrame([("c", json.dumps(doc)), ("bad", "{"), ("none", None)], "capture_id string, doc string")).collect()]
    roles = {v: r for c, r, v in rows if c == "num"}
    assert [roles[f"{k}.5"] for k in range(7, 22) if k != 8 and f"{k}.5" in roles] == [None, "time", "time", "len", "len", "len", None, None, "time", "len", "time", None]
    assert roles["22.0"] is None and roles["33.0"] is None and roles["0.2"] is None and roles["300.0"] is None
    assert sorted(v for c, _, v in rows if c in ("hex", "bezier", "count")) == ["#aabbcc", "0.1 0.2 1 1", "1.0"]
    text = "7) one 8. two\n9. three cubic-bezier(x, 41) 404s .5s 24 fps 3x 1,234,567 12,34 1440×900 May 2026 5.0 16em."
    said = spark.createDataFrame([(text,)], "t string").select(provenance.asserted(F.col("t")).alias("a")).first().a
    assert [(c, r) for c, r, *_ in said] == [("month", "May 2026"), ("num", "7"), ("num", "8."), ("num", "41"), ("num", ".5s"), ("num", "24"), ("num", "3"), ("num", "1234567"), ("num", "12"), ("num", "34"), ("num", "1440"), ("num", "900"), ("num", "5.0"), ("num", "16em")]


def test_documents_are_opened_level_by_level(spark):
    doc = {"a": {"width": [[16, 3], [20, True], [1, 2, 3]], "b": [{"c": [["x 5px", 7]]}, None, False, 2.5]}, "time": {"n": 9, "deep": {"deeper": {"deepest": [0.12345]}}}, "gap 16px": 1, "u": "1,234px in 2 remote ٣", "empty": [], "none": {}}
    got = {(r["class"], r.role, r.value) for r in provenance.measured_values(spark.createDataFrame([("c", json.dumps(doc))], "capture_id string, doc string")).where("class <> 'blob'").collect()}
    num = {("len", "16.0"), (None, "3.0"), ("len", "20.0"), ("len", "1.0"), ("len", "2.0"), ("len", "3.0"), ("len", "5.0"), (None, "7.0"), (None, "2.5"), ("time", "9.0"), ("time", "0.1234"), ("len", "234.0"), (None, "1.0"), (None, "2.0")}
    assert {(r, v) for c, r, v in got if c == "num"} - {(None, None)} == num and {v for c, _, v in got if c == "count"} == {"3.0", "2.0", "4.0", "1.0", "0.0"}
    assert provenance.measured_values(spark.createDataFrame([], "capture_id string, doc string")).collect() == []


def test_provenance_allows(spark):
    entries, captures = fixtures.provenance(spark)
    allow = spark.createDataFrame([("made-px", "37px")], "capture_id string, token string")
    assert not {g for g in broken(provenance.provenance_gate(entries.where("capture_id = 'made-px'"), captures, allow)) if g[1] == "fabricated"}


def test_bundle(spark):
    got = broken(QUERIES["fixture_bundle_audit"](spark, ""))
    assert {g for s, g, _ in got if s in ("clean", "fixture")} == set()
    want = {("artifact", "artifacts"), ("entry", "library entries"), ("indexed", "index rows"), ("lacking", "required files"), ("link", "symlinks"), ("pasted", "library entries"), ("unlisted", "unexpected")}
    assert want <= {(s, g) for s, g, k in got if k == "FAIL"} and ("trace", "corpus traces", "WARN") in got
    idx = spark.createDataFrame([("# I\n\nHow to.\n\n| a |\n|---|\n\n## P\n",)], "t string")
    assert idx.select(bundle.scaffold(F.col("t")).alias("t")).first().t == "# I\n\nHow to.\n"
    tree = spark.createDataFrame([("a.md",), ("library/x.md",), (".git/c",), ("b.md",)], "rel string")
    assert [r.rel for r in bundle.not_shipped(tree, tree.where("rel = 'a.md'")).collect()] == ["b.md"]
    names = [r.name for r in bundle.corpus_names(library.entries(fixtures.library(spark)[0])).collect()]
    assert names == sorted(names, key=lambda n: (-len(n), n)) and "alpha.example" in names


def test_crawl(spark):
    pages = {r.key.removeprefix("https://studio.example"): (r.depth, r.seq) for r in rows(spark, "fixture_crawl_pages")}
    assert set(pages) == {"", "/projects/case-one", "/articles", "/about", "/articles/hidden", "/articles/visible"} and pages[""] == (0, 1) and pages["/articles/visible"] == (2, 6)
    why = {r.key.removeprefix("https://studio.example"): r.reason for r in rows(spark, "fixture_crawl_skipped")}
    assert why["/dashboard"] == "auth-gated" and why["/portal/secret"] == "HTTP 403 (auth)" and why["/never-reachable"] == "HTTP 404" and why["/private/x"] == "robots" and why["/about"] == "max-pages cap"
    assert [r.rule for r in rows(spark, "fixture_robots")] == ["/private"]
    assert {r.loc.rsplit("/", 1)[1] for r in rows(spark, "fixture_sitemap")} == {"hidden", "never-reachable", "about"}
    p = spark.createDataFrame([("https://a.example/x", "x.html")], "url string, slug string")
    m = crawl.manifest(p, spark.createDataFrame([("u", "robots")], "url string, reason string"), spark.createDataFrame([("v", "crawl_only")], "url string, side string"), "https://a.example").first().json
    assert json.loads(m)["urlmap"] == {"https://a.example/x": "x.html"} and json.loads(m)["crawl_only"] == ["v"]


def test_follow_policy_order(spark):
    s = "https://s.example"
    df = spark.createDataFrame([(u,) for u in ("mailto:a@b", "https://o.example/", f"{s}/login/a.png", f"{s}/login", f"{s}/blog/x", f"{s}/help", f"{s}/work", f"{s}/blog/admin")], "u string")
    got = [r.r for r in df.select(urls.follow_policy(F.col("u"), F.lit(s), include="^/blog").alias("r")).collect()]
    assert got == ["scheme", "offsite", "binary", "auth-gated", "follow", "bulk-section", "follow", "auth-gated"]


def test_assets(spark):
    names = {r.url.split("example/", 1)[1]: r.name for r in rows(spark, "fixture_asset_fixpoint")}
    assert "only-here.png" in names and "fonts/a.woff2" in names and "list-indexes-1.json" in names
    heroes = {n for u, n in names.items() if u.startswith("hero.png")}
    assert len(heroes) == 2 and all(n.startswith("hero__") for n in heroes)
    page = rows(spark, "fixture_rewritten_page")[0].html
    assert "integrity" not in page and "cdn.example" not in page and "gtm" not in page and page.count("0123456789abcdef0123") == 1 and 'srcset="cdn/a.webp 1x, cdn/b.webp 2x"' in page and "--next-prop:red" in page
    why = {r.url.split("example/", 1)[1]: r.bucket for r in rows(spark, "fixture_asset_verdicts") if r.bucket}
    assert why == {"fake.png": "integrity_problems", "list-indexes-1.json": "origin_404s", "b.webp": "network_failures"}
    m = json.loads(rows(spark, "fixture_build_manifest")[0].json)
    assert m["mirrored"] == 9 and m["problems"] == 2 and m["changes"]["form-inert"] == 1
    files = spark.createDataFrame([("x/b.png",), ("a/b.png",)], "path string")
    assert assets.rerouted(spark.createDataFrame([("q/b.png?v=1",)], "path string"), files).first().place == "a/b.png"


def test_bytes(spark):
    assert {r.name: r.kind for r in rows(spark, "fixture_media_types")} == {r.name: r.want for r in fixtures.heads(spark).collect()}
    got = {r.raw: r.bytes for r in rows(spark, "fixture_byte_ranges")}
    assert got["10-19"] == bytes(range(10, 20)).hex().upper() and got["995-2000"] == bytes(i % 256 for i in range(995, 1000)).hex().upper() and got["1500-1600"] == "" and got["9-1"] is None and got["1-2,"] is None


def test_small_kernels(spark):
    assert [r.target.removeprefix("https://s.example") for r in rows(spark, "fixture_import_map")] == ["/v/lib.mjs", "/p/a.mjs", "/d/b.mjs", "/x/c.mjs", "/x/c.mjs"]
    assert [r.new for r in rows(spark, "fixture_srcset")] == ["cdn/a.webp 1x, /b.webp 2x", "/c.webp"]
    assert [tuple(r)[1:] for r in rows(spark, "fixture_compositing")] == [(127.5, 0.0, 127.5), (127.5, 127.5, 127.5), (255.0, 255.0, 255.0)]
    assert [r.seen for r in rows(spark, "fixture_unescape")] == ["a & b ©", None]
    r = spark.range(1).select(
        urls.url_quote(F.lit("https://s.example/a b?q=ü")).alias("q"), urls.resolved(F.lit("https://s.example/a/b"), F.lit("../c")).alias("j"), urls.chunk_sibling(F.lit("x-chunk-1-indexes-")).alias("s"),
        urls.next_root(F.lit("https://s.example/_next/static/a.js"), F.lit("static/chunks/b.js")).alias("n"), urls.robots_pattern(F.lit("/a*b$")).alias("p"), colour.hex_normal(F.lit("#AbC")).alias("h"), text.fence_free(F.lit("a\n```\nb\n```\nc")).alias("f"),
    ).first()
    assert tuple(r) == ("https://s.example/a%20b?q=%C3%BC", "https://s.example/c", "x-indexes-1-indexes-", "https://s.example/_next/static/chunks/b.js", "^/a.*b\\$", "#aabbcc", "a\n\nc")
    doc = spark.createDataFrame([('{"a": {"b": null, "c": 1}}',)], "t string").select(F.parse_json("t").alias("d"))
    got = doc.select(web.dig(F.col("d"), "a.b").alias("b"), web.dig(F.col("d"), "a.c").alias("c"), web.dig(F.col("d"), "a.x").alias("x")).first()
    assert got.b.found and not got.x.found and got.c.value == "1"
    css = spark.createDataFrame([(".a { color: red } :root { --x: 1; --y: 2 }",)], "css string")
    assert css.select(markup.selector_rules(F.col("css"), ".a").alias("r"), markup.custom_properties(F.col("css")).alias("p")).first() == ([" color: red "], ["--x", "--y"])
    page = spark.createDataFrame([('<script type="framer/appear">{"a":1}</script><script type="framer/appear">{bad</script>',)], "h string")
    assert page.select(markup.entrance_payloads(F.col("h")).alias("p")).first().p == ['{"a":1}']


def test_capture(spark):
    schema = "page string, ord int, style map<string,string>, rect struct<top: double, left: double, width: double, height: double>"
    els = spark.createDataFrame([("p", i, {"color": "red" if i < 3 else "blue", "gap": "0px"}, (0.0, 0.0, 10.0, 10.0)) for i in range(5)] + [("p", 4000, {"color": "green"}, (0.0, 0.0, 1.0, 1.0))], schema)
    assert [(r.kind, r.value, r.n) for r in capture.style_tallies(els).orderBy("rank").collect()] == [("colours", "red", 3), ("colours", "blue", 2)]
    rules = spark.createDataFrame(
        [("p", "s", 0, "style", ":root", "--a: 1; --b: 2", None, True), ("p", "s", 1, "media", None, None, "(min-width: 810px)", True), ("p", "s", 2, "font-face", None, "font-family: A; src: url(x)", None, True), ("p", "s", 3, "style", "a:hover", "color: red", None, True), ("p", "s", 4, "keyframes", "spin", "to {}", None, True), ("p", "s", 5, "style", ".x", "position: sticky", None, True), ("p", "t", 6, "style", None, None, None, False)],
        "page string, sheet string, ord int, type string, selector string, css_text string, condition string, readable boolean",
    )
    assert sorted(r.name for r in capture.root_properties(rules).collect()) == ["--a", "--b"]
    assert [r.condition for r in capture.conditions(rules).collect()] == ["(min-width: 810px)"]
    assert capture.font_faces(rules).first().family == "A" and capture.interaction_rules(rules).first().selector == "a:hover" and capture.keyframes(rules).first().name == "spin" and capture.scroll_driven(rules).first().selector == ".x"
    assert capture.unreadable_sheets(rules).first().unreadable == 1
    assert capture.live_animations(spark.createDataFrame([], "page string"), rules).first().note.startswith("keyframes")
    can = spark.createDataFrame([("p", "a", 100, 100), ("p", "b", 300, 250)], "page string, id string, css_w int, css_h int")
    assert tuple(capture.largest_canvas(can).first()) == ("p", "b", True)
    assert [r.library for r in capture.libraries(spark.createDataFrame([("p", {"gsap": True, "lenis": False})], "page string, found map<string,boolean>")).collect()] == ["gsap"]
    e = spark.createDataFrame([("t", "n")], "target string, name string")
    assert capture.uncovered_waapi(e, e.union(spark.createDataFrame([("t", "m")], "target string, name string"))).count() == 1
    st = spark.createDataFrame([("e", "p", None), ("e", "q", "x")], "element string, property string, to string")
    en = spark.createDataFrame([("e", "p", 1, "a"), ("e", "p", 2, "b"), ("e", "q", 1, "z")], "element string, property string, seq int, to string")
    assert {(r.property, r.to) for r in capture.filled_ends(st, en).collect()} == {("p", "b"), ("q", "x")}
    t = spark.createDataFrame([("T", "a", ["x", "y"]), ("T", "b", ["x", "z"])], "template string, page string, parts array<string>")
    r = capture.templates(t).first()
    assert (r.instances, r.fixed, r.varying) == (2, ["x"], ["y", "z"])
    assert capture.hydration(spark.createDataFrame([("p", "reference", 100), ("p", "build", 190)], "page string, side string, nodes int")).first().failed
    tiers = capture.palette_tiers(spark.createDataFrame([("p", "c", "red", 97), ("p", "c", "blue", 3)], "page string, kind string, value string, n int"))
    assert {(r.value, r.tier) for r in tiers.collect()} == {("red", "structural"), ("blue", "decoration")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    to = str(tmp_path / "t")
    assert sinks.install(df, to, lambda d: d.count() == 1)
    assert not sinks.install(df.union(df), to, lambda d: True)
    assert not sinks.install(df.union(df), to, lambda d: d.count() == 1, force=True)
    assert spark.read.parquet(to).count() == 1
    assert sinks.install(df.union(df), to, lambda d: True, force=True) and spark.read.parquet(to).count() == 2
    sinks.write_report(QUERIES["fixture_report_markdown"](spark, "").select("scope_id", "text"), str(tmp_path / "r"))
    sinks.write_json(gates.as_json(QUERIES["fixture_font_gate"](spark, "")), str(tmp_path / "j"))
    sinks.write_pages(spark.createDataFrame([("a", "b")], "slug string, html string"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "j")).count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a")
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "d.json").write_text('{"x":\n 1}')
    m = spark.createDataFrame([("a.html",)], "slug string")
    assert web.raw_pages(spark, str(tmp_path), m).first().html == "<p>a"
    with pytest.raises(FileNotFoundError):
        web.raw_pages(spark, str(tmp_path), m.union(spark.createDataFrame([("b.html",)], "slug string")))
    assert web.json_documents(spark, str(tmp_path / "n"), "x int").first().x == 1
    assert web.json_documents(spark, str(tmp_path / "n")).count() == 1
    assert sorted(r.rel for r in web.tree(spark, str(tmp_path)).collect()) == ["a.html", "n/d.json"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.jsonl").write_text('{"url": "u", "status": 200, "content_type": "text/html", "body": "b"}\n')
    spark.dataSource.register(landing.LandedPages)
    assert tuple(spark.read.format("landed_pages").load(str(tmp_path / "l")).first()) == ("u", 200, "text/html", "u", "b")


def test_matching_edges(spark):
    one = spark.createDataFrame([(100.0,)], "v double")
    for other, left in ((116.0, 0), (116.5, 1), (84.0, 0)):
        assert matching.tolerance_anti(one, spark.createDataFrame([(other,)], "other double"), "v", "other").count() == left
    wide_ = spark.createDataFrame([(1000.0,)], "v double")
    assert matching.tolerance_anti(wide_, spark.createDataFrame([(1149.0,)], "other double"), "v", "other").count() == 0
    assert matching.tolerance_anti(wide_, spark.createDataFrame([(1151.0,)], "other double"), "v", "other").count() == 1
    n = ordering.numbered(spark.range(50).select((F.col("id") * 7 % 50).alias("x")), ["x"], "place", 4)
    assert n.where("place <> x + 1").count() == 0
    assert tallies.keep_first(spark.createDataFrame([(1, 2), (1, 1)], "k int, o int"), ["k"], ["o"]).first().o == 1


def test_byte_types_cover_names(spark):
    assert binary.BY_NAME["mjs"] == "text/javascript" and copy_gate.KEPT == 3


def test_update_mode_keeps_every_key(spark, tmp_path):
    """Two files, one micro-batch each: keys of the first stay, and a later smaller record replaces its key's."""
    from weftline.queries import streams
    from weftline.streaming import recorder

    rows = [(1, 10, 5), (2, 11, 6), (3, 12, 7)], [(2, 13, 1), (3, 14, 9), (4, 15, 2)]
    schema = "user long, event long, seq long"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run(spark, recorder.numbered_first(stream, "user", "event", "seq"), "update", ["user"])
    assert sorted((r.user, r.event, r.seq) for r in out.collect()) == [(1, 10, 5), (2, 13, 1), (3, 12, 7), (4, 15, 2)]


def test_phrases_of_repeated_ids_count_once_a_row(spark):
    body = "over and again " * 60
    rows = spark.createDataFrame([(1, body), (1, body), (2, None), (3, "too short"), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.phrase, r.hits, r["first"], r.words) for r in copy_gate.frequent_phrases(rows, "doc_id", "text", (2,), habits=False).collect())
    assert got == sorted([(1, "over and", 60, 0, 180), (1, "and again", 60, 1, 180), (1, "again over", 59, 2, 180)] * 2)
    assert copy_gate.frequent_phrases(rows.limit(0), "doc_id", "text").collect() == []


def test_names_of_many_runs_are_traced(spark):
    files = spark.createDataFrame([("a", "By The Old Red Barn Door Works, ltd\nat alpha.example!"), ("b", "alphabet red.barn"), ("c", None)], "rel string, text string")
    names = spark.createDataFrame([("the old red barn door works",), ("alpha.example",), ("alpha",), ("red.barn",), ("barn door",)], "name string")
    got = {(r.rel, r.line, r.name) for r in bundle.corpus_traces(files, names).collect()}
    assert got == {("a", 1, "the old red barn door works"), ("a", 2, "alpha.example"), ("b", 1, "red.barn")}


def test_phrases_beyond_a_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown"), (3, None), (4, "")], "i int, t string")
    phrases = spark.createDataFrame([("quick br",), ("o",), ("brown fox jumps",), ("brown",), ("",)], "p string")
    small = sorted((r.i, r.p) for r in matching.phrases_in(texts, phrases, "t", "p").collect())
    monkeypatch.setattr(matching, "SMALL", 1)
    assert sorted((r.i, r.p) for r in matching.phrases_in(texts, phrases, "t", "p").collect()) == small
    words = spark.createDataFrame([("quick  brown fox",), ("brown",), ("own",), (" ",), ("a b c d e f g",)], "p string")
    texts = texts.unionByName(spark.createDataFrame([(5, "x a b\nc d e f g"), (6, "a b c d e g f"), (5, "brown")], "i int, t string"))
    assert sorted((r.i, r.p) for r in matching.word_phrases_in(texts, words, "i", "t", "p").collect()) == [(1, "brown"), (1, "quick  brown fox"), (2, "brown"), (5, "a b c d e f g"), (5, "brown")]


def test_archives(spark):
    import io
    import zipfile

    from weftline.plans import sinks

    files = spark.createDataFrame([("a", "x/one.md", b"1"), ("a", "two.md", None), ("a", "two.md", b"zz"), ("b", "one.md", b"1"), ("b", None, b"1")], "bundle string, rel string, body binary")
    got = {r.bundle: zipfile.ZipFile(io.BytesIO(r.archive)) for r in sinks.archives(files, "kit").collect()}
    assert {b: {n: z.read(n) for n in z.namelist()} for b, z in got.items()} == {"a": {"kit/two.md": b"", "kit/x/one.md": b"1"}, "b": {"kit/one.md": b"1"}}
    assert sinks.archives(files.limit(0), "kit").collect() == []


def test_manifests_as_lines(spark):
    pages = spark.createDataFrame([("https://a.example/x/", "x.html"), ("https://a.example/y", "y.html")], "url string, slug string")
    skipped = spark.createDataFrame([("u", "robots")], "url string, reason string")
    sides = spark.createDataFrame([("v", "crawl_only")], "url string, side string")
    got = sorted((r.section, json.loads(r.json)) for r in crawl.manifest_parts(pages, skipped, sides, "https://a.example").collect() if r.section != "page")
    assert got == [("coverage", {"side": "crawl_only", "url": "v"}), ("header", {"origin": "https://a.example", "n_pages": 2}), ("skipped", {"url": "u", "reason": "robots"})]
    b = fixtures.build(spark)
    rows_ = [(r.section, json.loads(r.json)) for r in assets.build_manifest_parts(b["fetched"], spark.createDataFrame([("sri", 2), ("sri", 1)], "name string, n int"), spark.createDataFrame([("index.html",), ("#inert",)], "place string")).collect()]
    assert [x for k, x in rows_ if k == "change"] == [{"name": "sri", "n": 3}] and next(x for k, x in rows_ if k == "header")["problems"] == 2
    assert sorted(x["bucket"] for k, x in rows_ if k == "failure") == ["integrity_problems", "network_failures", "origin_404s"]


def test_answers_of_a_server(spark):
    from weftline.plans import serving

    files = spark.createDataFrame([("/a.bin", bytes(range(20))), ("/cdn/b.js", b"js"), ("/index.html", b"<p>")], "path string, body binary")
    asked = spark.createDataFrame([(1, "/a.bin?range=0-1,18-99"), (2, "/deep/b.js?v=1#x"), (3, "/none"), (4, None), (5, "/a.bin?range=50-60"), (6, "/index.html")], "request_id int, target string")
    out = serving.responses(asked, files)
    got = {r.request_id: (r.status, r.content_type, r.content_length, r.cache_control, r.body and bytes(r.body)) for r in out.collect()}
    assert got[1] == (200, "application/octet-stream", 4, "no-store", bytes([0, 1, 18, 19])) and got[2] == (200, "text/javascript", 2, None, b"js") and got[3] == got[4] == (404, None, None, None, None)
    assert got[5][:4] == (200, "application/octet-stream", 0, "no-store") and got[6] == (200, "text/html", 3, None, b"<p>")
    assert serving.counters(out).first()[:] == (2, 2, 2)
