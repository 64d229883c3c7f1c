"""Small inputs for operators that the driver's tables give no signal: one clean case each, and cases that break one thing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

CLEAN_HEAD = """<html lang="en"><head><title>A workshop for hand-made chairs</title><meta name="description" content="Chairs made by hand in a small workshop since 1984, from local ash and oak, with a waiting list of 9 weeks."><link rel="canonical" href="https://chairs.example/"><meta property="og:title" content="x"><meta property="og:description" content="x"><meta property="og:image" content="x"><script type="application/ld+json">[{"@type": ["Organization", "Store"]}, {"@type": "WebSite"}]</script></head>"""


def copy_pages(spark: SparkSession) -> DataFrame:
    """clean, tells, habit, bare and matched pages."""
    prose = "The shop opened in 1984 with 3 people and 2 benches. Each chair takes 40 hours of work in all. We sell 120 of them a year."
    tells = "Our seamless, robust and pivotal journey. We leverage a tapestry of bespoke, unparalleled, world-class, finest work. Experts say it is the best. Not just a chair."
    filler = " ".join(f"word{i} rather than thing{i} 12" for i in range(60))
    rows = [
        ("clean", f"{CLEAN_HEAD}<body><h1>Chairs</h1><img src='a.png' alt=''><p>{prose}</p></body></html>", False),
        ("tells", f"{CLEAN_HEAD}<body><h1>Chairs</h1><p>{tells} {prose}</p></body></html>", False),
        ("habit", f"{CLEAN_HEAD}<body><h1>Chairs</h1><p>{filler}</p></body></html>", False),
        ("bare", f"<html><head></head><body><h1>a</h1><h1>b</h1><img src='a.png'><p>{prose}</p></body></html>", False),
        ("matched", f"{CLEAN_HEAD}<body><h1>Chairs</h1><p>{tells}</p></body></html>", True),
    ]
    return spark.createDataFrame(rows, "page_id string, html string, match_mode boolean")


def animations(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A reference with five staggered cards, a loop and a load animation, and a build that lacks the curve; transitions without duration in both."""
    card = lambda side, i, ease: (side, i, f"card{i}", "CSSTransition", "opacity", f"div.card:nth({i})", 700, 60 * i, ease, "1", ({"opacity": "0"}, {"opacity": "1", "transform": "none"}), 40 * i, 80)
    rows = [card("reference", i, "cubic-bezier(0.16, 1, 0.3, 1)") for i in range(5)] + [card("build", i, "ease") for i in range(5)]
    for side in ("reference", "build"):
        rows.append((side, 10, "spin", "CSSAnimation", None, "svg", 1200, 0, "linear", "infinite", ({}, {"transform": "rotate(360deg)"}), 0, 0))
        rows.append((side, 11, "load", "CSSAnimation", None, "h1", 900, 0, "ease-out", "1", ({"opacity": "0"}, {"opacity": "1"}), 0, 0))
        rows.append((side, 12, "none", "CSSTransition", "color", "a", 0, 0, "ease", "1", ({}, {"color": "red"}), 0, 0))
    schema = "side string, ord int, name string, kind string, property string, target string, duration int, delay int, easing string, iterations string, values struct<from: map<string,string>, to: map<string,string>>, firedAtScrollY int, triggerViewportPct int"
    meta = spark.createDataFrame([("reference", True), ("build", True)], "side string, reduced_motion boolean")
    return spark.createDataFrame(rows, schema), meta


def font_probe(spark: SparkSession) -> DataFrame:
    rows = []
    for scope in ("clean", "wide", "slipped", "one-sided", "empty"):
        if scope == "empty":
            rows.append((scope, "reference", 0, "A", "400", True, 10.0, 12.0))
            continue
        rows.append((scope, "reference", 67, "A", "400", True, 1183.3, 1208.3))
        rows.append((scope, "reference", 67, "B", "700", False, 900.0, 900.0))
        rows.append((scope, "build", 67, "A", "400", True, {"wide": 1190.0, "slipped": 1208.3}.get(scope, 1183.9), 1208.3))
        if scope != "one-sided":
            rows.append((scope, "build", 67, "B", "700", False, 900.0, 900.0))
    return spark.createDataFrame(rows, "scope string, side string, faces int, family string, weight string, check_ok boolean, real double, fallback double")


def design(spark: SparkSession) -> dict[str, DataFrame]:
    """Cases clean, split (three split sections in a row), dim (low contrast on a phone), tall (navigation) and blind (unreadable stylesheets)."""
    cases = ["clean", "split", "dim", "tall", "blind"]
    shots = [(c, w) for c in cases for w in (390, 1440)]
    probe = [(c, w, f"https://{c}.example/", 5000) for c, w in shots]
    sections = [(c, w, i, "#ffffff", 1.0, False, 1, c == "split" and i < 3, ["h2", f"p{i}"]) for c, w in shots for i in range(6)]
    hero = [(c, w, 40.0, 900, 400.0, 2, 1, 0, False, 480.0, 0) for c, w in shots]
    nav = [(c, w, 96.0 if c == "tall" else 80.2, 1, 5) for c, w in shots]
    buttons = [(c, w, "Get started", 1, 2, 2.1 if c == "dim" and w == 390 else 18.9, 4.5, False, False, 400.0) for c, w in shots]
    forms = [(c, 1440, "email", 8.0, 5.0, False, False) for c in cases]
    census = [x for c in cases for x in ((c, "accent", "#cc2200", 20, None), (c, "radius", "8", 12, None), (c, "font", "inter", 40, True), (c, "eyebrow", "e", 2, None), (c, "colour", "#ffffff", 9, None))]
    text = [(c, "Chairs made by hand", 0) for c in cases]
    hits = [(c, "a.css", 1, "NOTE", "fine") for c in cases]
    motion = [(c, 0 if c == "blind" else 1, 1 if c == "blind" else 0, 0, 0, 0) for c in cases]
    make = spark.createDataFrame
    return {
        "probe": make(probe, "case string, viewport_w int, url string, scroll_height int"),
        "sections": make(sections, "case string, viewport_w int, idx int, bg_hex string, bg_lum double, bg_image boolean, media int, split_image_text boolean, open_shape array<string>"),
        "hero": make(hero, "case string, viewport_w int, padding_top double, viewport_height int, first_cta_top double, headline_lines int, real_media int, background_photos int, gradient_only boolean, last_cta_bottom double, text_below_ctas int"),
        "nav": make(nav, "case string, viewport_w int, height double, rows int, items int"),
        "buttons": make(buttons, "case string, viewport_w int, label string, lines int, words int, contrast double, required double, over_image boolean, in_nav boolean, top double"),
        "forms": make(forms, "case string, viewport_w int, name string, contrast double, placeholder_contrast double, placeholder_only_label boolean, over_image boolean"),
        "census": make(census, "case string, kind string, value string, uses long, loaded boolean"),
        "page_text": make(text, "case string, body string, em_dashes int"),
        "src_hits": make(hits, "case string, file string, line int, tier string, message string"),
        "motion": make(motion, "case string, reduced_motion_rules int, stylesheets_unreadable int, infinite int, marquees int, canvases int"),
        "intents": make([("start", "get started"), ("start", "begin now"), ("talk", "contact us")], "intent string, phrase string"),
    }


def report(spark: SparkSession) -> dict[str, DataFrame]:
    """Scopes clean, residue, low, placeholder and bare (nothing measured)."""
    from weftline.operators.report import REQUIRED

    texts = {"mode": "match", "path": "mirror", "fonts.evidence": "both"}
    rows = []
    for scope in ("clean", "residue", "low", "placeholder"):
        for p in [*REQUIRED, "geometry.worst_px", "assets.problems"]:
            num = 100.0 if p == "text.pct" else 3.0 if (p, scope) == ("residue.origin_refs", "residue") else 0.0
            rows.append((scope, p, "measured", None if p in texts else num, texts.get(p), None))
        if scope == "placeholder":
            rows.append((scope, "placeholder", "measured", None, "true", None))
    rows += [("bare", p, "not measured", None, None, "not yet") for p in REQUIRED[:5]]
    px = [(s, "pages", "index.html", 1440, 94.0 if s == "low" else 99.2, 99.4) for s in ("clean", "residue", "low", "placeholder")] + [("clean", "pages", "nan.html", 390, float("nan"), 99.0)]
    gate_rows = [(s, g, True, []) for s in ("clean", "residue", "low", "placeholder") for g in ("motion", "content", "design")]
    crawl = [(s, ["https://a.example/x"], {"https://a.example/x": "HTTP 404"}) for s in ("clean", "residue", "low", "placeholder", "bare")]
    make = spark.createDataFrame
    return {
        "measurements": make(rows, "scope string, path string, status string, num double, txt string, why string"),
        "pixel_scores": make(px, "scope string, table string, slug string, breakpoint int, similarity_pct double, self_ceiling_pct double"),
        "gate_inputs": make(gate_rows, "scope string, gate string, passed boolean, failures array<string>"),
        "crawl": make(crawl, "scope string, sitemap_only array<string>, skipped map<string,string>"),
        "args": make([(s, "match", "mirror") for s in ("clean", "residue", "low", "placeholder", "bare")], "scope string, mode string, path string"),
    }


def entry(name: str, call: str, aliases: str, grade: str, table: str = "", before: str = "") -> str:
    return f"# {name}\n\n{before}**Callable as: {call}** (aliases: {aliases})\n\nCaptured @ 1440x900\n\n## Motion\n{table}\n**Motion fidelity: {grade}**\n"


SPEC = "\n| name | trigger | target | property | from | to | duration | easing |\n|---|---|---|---|---|---|---|---|\n| rise | scroll | card | opacity | 0 | 1 | 700 | ease |\n"


def library(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Entries: a specification, a partial one, a fenced table, a mention above the declaration, a shared name; and an index with an orphan row."""
    files = [
        ("lib/alpha.example.md", entry("alpha", "Alpha Works", '"AW", alphaworks', "spec", SPEC)),
        ("lib/beta.example.md", entry("beta", "Beta", "bee", "partial")),
        ("lib/gamma.example.md", entry("gamma", "Gamma", "gg", "spec", f"\n```{SPEC}```\n")),
        ("lib/delta.example.md", entry("delta", "Delta", "dd", "partial", before="Motion fidelity: see below.\n\n")),
        ("lib/omega.example.md", entry("omega", "Omega", "bee", "Partial")),
        ("lib/TEMPLATE.md", entry("t", "<Name>", "x", "none")),
    ]
    index = "# Index\n\n| Call it | File | Site | Grade | a | b |\n|---|---|---|---|---|---|\n" + "".join(f"| {n} | [{n}]({n}.example.md) | {n} | **{g}** | x | y |\n" for n, g in (("alpha", "spec"), ("beta", "none"), ("gamma", "spec"), ("delta", "partial"), ("zeta", "spec")))
    return spark.createDataFrame(files, "file string, text string"), spark.createDataFrame([(index + "\n- stranded\n\n## Patterns\n\n- fine\n",)], "text string")


CAPTURE = {
    "viewport": "1440x900", "captured": "2026-03-04", "type": {"families": ["Inter"], "scale": 1.2, "steps_px": [16, 20, 48], "weight": 700},
    "colour": {"hex": ["#0A0A0A", "#cc2200"]}, "motion": {"easings": [["cubic-bezier(0.16, 1, 0.3, 1)", 9]], "durations_ms": [[300, 12], [700, 5]], "travel_px": 24, "stagger_ms": 60}, "breakpoints": [390, 810, 1440],
}


def provenance(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Entries over one capture: clean, and one case for each rule."""
    good = "Captured 2026-03-04 at 1440x900. Type 16px, 20 px and 48px. Colours #0a0a0a and #CC2200. Curve cubic-bezier(0.16,1,.3,1), .3s and 700ms, stagger 60ms, travel 24px. 3 breakpoints: 390px, 810px, 1,440 px."
    cases = {
        "clean": good,
        "made-px": good + " A gap of 37px.",
        "made-hex": good + " Also #123456.",
        "made-date": good + " Updated 2025-01-02.",
        "time-is-weight": good + " It lasts 701ms.",
        "rgb": good.replace("#CC2200", "rgb(204, 34, 0)"),
        "dropped-hex": good.replace(" and #CC2200", ""),
        "dropped-curve": good.replace("Curve cubic-bezier(0.16,1,.3,1), ", ""),
        "joined-thousands": good + " Wide at 1,440px.",
        "dwell": good + " Dwell 1.2s, then 16px/1.2s.",
        "role": good + " Gutter 700px.",
        "precision": good + " 1.2 of it, 8.33vw wide, 0.3 x.",
        "month": good + " Measured March 2026, not April 2026.",
        "thin": "Colours #0a0a0a and #cc2200, curve cubic-bezier(0.16, 1, 0.3, 1), 404s.",
    }
    captures = [(c, json.dumps(CAPTURE)) for c in cases]
    return spark.createDataFrame(list(cases.items()), "capture_id string, text string"), spark.createDataFrame(captures, "capture_id string, doc string")


def bundles(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    base = [("SKILL.md", "steps"), ("README.md", "read"), ("library/INDEX.md", "# Index\n\nHow to use.\n\n| Call it | a |\n|---|---|\n"), ("library/TEMPLATE.md", "**Motion fidelity: spec**"), ("scripts/run.py", "pass")]
    rows = [("clean", r, False, len(t), t) for r, t in base]
    broken = {
        "entry": ("library/alpha.example.md", False, "x"), "pasted": ("references/notes.md", False, "**Motion fidelity: partial**"), "artifact": ("scripts/__pycache__/a.pyc", False, ""),
        "unlisted": ("extra/thing.txt", False, "x"), "link": ("scripts/link.py", True, ""), "trace": ("references/taste.md", False, "as seen on Alpha.example today"), "fixture": ("scripts/tests/data.py", False, "**Motion fidelity: partial**"),
    }
    for b, (rel, link, text) in broken.items():
        rows += [(b, r, False, len(t), t) for r, t in base] + [(b, rel, link, len(text), text)]
    rows += [("lacking", r, False, len(t), t) for r, t in base if r != "README.md"]
    rows += [("indexed", r, False, len(t), t + ("| a | [a](a.md) |\n" if r.endswith("INDEX.md") else "")) for r, t in base]
    names = spark.createDataFrame([("alpha.example",), ("alphaworks",)], "name string")
    return spark.createDataFrame(rows, "bundle string, rel string, is_link boolean, size long, text string"), names


def crawl(spark: SparkSession) -> dict[str, DataFrame]:
    """A small site: a start page, sections, a login, a hidden page in the sitemap, and one that isn't there."""
    o = "https://studio.example"
    a = lambda *p: "".join(f'<a href="{x}">x</a>' for x in p)
    pages = [
        (f"{o}", 200, "text/html", f"{o}", a("/about", "/projects/case-one", "/articles", "/dashboard", "/portal/secret", "https://else.example/x", "#top")),
        (f"{o}/about", 200, "text/html; charset=utf-8", f"{o}/about", a("/", "/private/x")),
        (f"{o}/projects/case-one", 200, "text/html", f"{o}/projects/case-one", ""),
        (f"{o}/articles", 200, "text/html", f"{o}/articles", a("/articles/visible")),
        (f"{o}/articles/visible", 200, "text/html", f"{o}/articles/visible", ""),
        (f"{o}/articles/hidden", 200, "text/html", f"{o}/articles/hidden", ""),
        (f"{o}/portal/secret", 403, "text/html", f"{o}/portal/secret", ""),
    ]
    robots = [(o, "# rules\nUser-agent: *\nDisallow: /private\nDisallow:\n\nUser-agent: other\nDisallow: /about\n")]
    sitemap = [(f"{o}/sitemap.xml", f"<urlset><loc>{o}/articles/hidden</loc><loc> {o}/never-reachable </loc><loc>{o}/more.xml</loc></urlset>"), (f"{o}/more.xml", f"<loc>{o}/about</loc><loc>{o}/deep.xml</loc>"), (f"{o}/deep.xml", f"<loc>{o}/too-deep</loc>")]
    make = spark.createDataFrame
    return {
        "pages": make(pages, "url string, status int, content_type string, final_url string, html string"),
        "robots": make(robots, "origin string, text string"),
        "sitemap": make(sitemap, "url string, text string"),
    }


def build(spark: SparkSession) -> dict[str, DataFrame]:
    """A page with every kind of reference, and its assets: a module that names another, an image that is a page, a stylesheet, a chunk map."""
    o, c = "https://site.example", "https://cdn.example"
    html = (
        f'<html><head><link rel="stylesheet" href="{c}/main.css" integrity="sha384-x" crossorigin="anonymous"><script type="module" src="{c}/app.mjs" integrity=\'y\'></script></head><body>'
        f'<div style="--bg:url({c}/hero.png?width=1024);--next-prop:red"></div><img src="{c}/hero.png?width=512&amp;q=2" srcset="/a.webp 1x, /b.webp 2x"><source srcset=\'/a.webp 480w\'>'
        f'<form method="post" action="/send"></form><script>{{"mixpanel":{{"on":1,"token":"0123456789abcdef0123"}},"other":{{"token":"0123456789abcdef0123"}}}}</script>'
        f'<script>(function(w){{w.push({{event:\'gtm.js\'}});f.parentNode.insertBefore(j,f)}})(window)</script><noscript><iframe class="gtm-iframe" src="x"></iframe></noscript><img src="{c}/fake.png"><a href="{c}/list-chunk-1.json">d</a></body></html>'
    )
    assets = [
        (f"{c}/main.css", 200, "text/css", b"@font-face{src:url(fonts/a.woff2)}", None),
        (f"{c}/fonts/a.woff2", 200, "font/woff2", b"wOF2....", None),
        (f"{c}/app.mjs", 200, "text/javascript", b"import('./chunk.mjs');x=`${a}.mjs`", None),
        (f"{c}/chunk.mjs", 200, "text/javascript", f'const u="{c}/only-here.png";'.encode(), None),
        (f"{c}/only-here.png", 200, "image/png", b"\x89PNG\r\n\x1a\n....", None),
        (f"{c}/hero.png?width=1024", 200, "image/png", b"\x89PNG\r\n\x1a\n1", None),
        (f"{c}/hero.png?width=512&q=2", 200, "image/png", b"\x89PNG\r\n\x1a\n2", None),
        (f"{c}/fake.png", 200, "image/png", b"<!DOCTYPE html><html></html>", None),
        (f"{c}/list-chunk-1.json", 200, "application/json", b"{}", None),
        (f"{c}/list-indexes-1.json", 404, "text/html", b"no", None),
        (f"{o}/a.webp", 200, "image/webp", b"RIFF....WEBP", None),
        (f"{o}/b.webp", 0, None, None, "TimeoutError"),
    ]
    return {"pages": spark.createDataFrame([(f"{o}/", "index.html", html)], "url string, slug string, html string"), "fetched": spark.createDataFrame(assets, "url string, status int, content_type string, body binary, error string")}


def heads(spark: SparkSession) -> DataFrame:
    rows = [
        ("a.png", b"\x89PNG\r\n\x1a\n0000", "image/png"), ("b.jpg", b"\xff\xd8\xff\xe0rest", "image/jpeg"), ("c.png", b"\x00\x00\x00\x1cftypavif0000", "image/avif"), ("d.bin", b"wOF2xxxx", "font/woff2"),
        ("e.css", b"\x89PNG\r\n\x1a\n", "text/css"), ("f.webp", b"RIFF\x00\x00\x00\x00WEBPVP8 ", "image/webp"), ("g.mp4", b"\x00\x00\x00\x18ftypisom0000", "video/mp4"), ("h.xyz", b"zzzz", "application/octet-stream"), ("i.ico", b"\x00\x00\x01\x00\x01\x00", "image/x-icon"),
    ]
    return spark.createDataFrame(rows, "name string, head binary, want string")
