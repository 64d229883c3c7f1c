"""Rules over probes of rendered pages: layout, colour, contrast, forms, motion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.functions import colour
from weftline.operators import matching, tallies
from weftline.plans import gates

#: Limits of the rules.
NAV_HEIGHT, NAV_SLACK, HERO_PADDING, HEADLINE_LINES, DESKTOP = 80, 2, 96, 2, 1024
FLAT_SHARE, REPEAT, SPLIT_RUN, ACCENT_USES, RADIUS_USES, RADII = 0.6, 4, 3, 3, 2, 3
#: Families that are no choice of a design.
SYSTEM_FACES = ("system-ui", "-apple-system", "blinkmacsystemfont", "segoe ui", "arial", "helvetica", "sans-serif", "serif", "monospace", "georgia", "times new roman")


def duplicate_intents(texts: DataFrame, intents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, intent, phrases): intents that a text states with more than one phrase. Intents are a rule table and are broadcast."""
    low = texts.select(id_col, F.lower(text_col).alias("__t"))
    hits = matching.phrases_in(low, intents, "__t", "phrase").select(id_col, "intent", "phrase").distinct()
    return hits.groupBy(id_col, "intent").agg(F.count("*").alias("phrases")).where("phrases > 1")


def visible(elements: DataFrame) -> Column:
    """Elements that take part in a page: shown, not near transparent, with a box, no program or metadata."""
    s = F.col("style")
    return (
        (F.coalesce(s["display"], F.lit("")) != "none")
        & ~F.coalesce(s["visibility"], F.lit("")).isin("hidden", "collapse")
        & (F.coalesce(s["opacity"].try_cast("double"), F.lit(1.0)) >= 0.05)
        & (F.col("rect.width") > 0)
        & (F.col("rect.height") > 0)
        & ~F.upper("tag").isin("SCRIPT", "STYLE", "NOSCRIPT", "META", "LINK", "HEAD", "TEMPLATE")
    )


def sections_of(elements: DataFrame) -> DataFrame:
    """Elements that are sections: visible, no header, footer or navigation nor inside one, tall and wide enough."""
    return elements.where(visible(elements) & ~F.upper("tag").isin("HEADER", "NAV", "FOOTER") & ~F.coalesce("in_nav", F.lit(False)) & (F.col("rect.height") >= 160) & (F.col("rect.width") >= 0.6 * F.col("viewport_w")))


def eyebrow_budget(sections: Column) -> Column:
    """Eyebrows that so many sections may have: one in three, rounded up."""
    return F.ceil(sections / 3)


def eyebrows(elements: DataFrame) -> DataFrame:
    """Small spaced capitals with a heading close below in the same host."""
    size, track = F.col("font_size"), F.col("letter_spacing")
    small = elements.where((F.col("text_transform") == "uppercase") & (size <= 16) & (track / size >= 0.06) & (F.length("text") <= 48) & (F.length("text") > 0))
    heads = elements.where(F.upper("tag").rlike("^H[1-6]$") | (size >= 26)).select("page", "host", F.col("rect.top").alias("heading_top"))
    return matching.near_above(small.withColumn("top", F.col("rect.top")), heads, ["page", "host"], "top", "heading_top", 220.0)


def button_like(elements: DataFrame) -> DataFrame:
    tag = F.upper("tag")
    padded = (F.col("padding_left") + F.col("padding_right") >= 16) & ((F.col("bg_alpha") > 0.05) | F.coalesce("border", F.lit(False)))
    return elements.where((tag == "BUTTON") | ((tag == "INPUT") & (F.coalesce("input_type", F.lit("")) != "hidden")) | ((tag == "A") & padded))


def required_contrast(size: Column, weight: Column) -> Column:
    """3 for large text, 4.5 for other."""
    return F.when((size >= 24) | ((size >= 18.66) & (weight >= 700)), 3.0).otherwise(4.5)


def accents(uses: DataFrame) -> DataFrame:
    """(case, hue, uses, samples): families of strong colours by 30 degrees of hue. uses (case, ord, hex, n)."""
    rgb = colour.hex_channels(F.col("hex"))
    rows = uses.withColumn("c", colour.hsl(rgb["r"], rgb["g"], rgb["b"])).where((F.col("c.c") >= 40) & F.col("c.l").between(0.12, 0.9))
    rows = rows.withColumn("hue", colour.hue_bucket(F.col("c.h")))
    return rows.groupBy("case", "hue").agg(F.sum("n").alias("uses"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "hex"))), lambda x: x["hex"]), 1, 4).alias("samples"))


def radii(boxes: DataFrame) -> DataFrame:
    """(case, value, uses): corner radii of boxes of some area; a radius of half the short edge is a pill. boxes (case, w, h, radius)."""
    edge = F.least("w", "h") / 2
    value = F.when((F.col("radius") > 0) & (F.col("radius") >= edge - 0.5), "pill").otherwise(F.floor(F.col("radius") + 0.5).cast("string"))
    return boxes.where(F.col("w") * F.col("h") >= 400).withColumn("value", value).where("value = 'pill' or cast(value as double) > 0").groupBy("case", "value").agg(F.count("*").alias("uses"))


def colour_census(elements: DataFrame, top: int = 40) -> DataFrame:
    """(case, hex, n, rank): backgrounds of boxes of some area that hide what is behind, and text colours that can be seen."""
    back = elements.where((F.col("w") * F.col("h") >= 400) & (F.col("bg.a") > 0.2)).select("case", colour.hex_of(F.col("bg.r"), F.col("bg.g"), F.col("bg.b")).alias("hex"))
    front = elements.where(F.col("has_text") & (F.col("fg.a") > 0.5)).select("case", colour.hex_of(F.col("fg.r"), F.col("fg.g"), F.col("fg.b")).alias("hex"))
    counted = back.unionAll(front).groupBy("case", "hex").agg(F.count("*").alias("n"))
    return tallies.ranked(counted, ["case"], [F.desc("n"), F.asc("hex")], top)


def line_count(inner: Column, line_height: Column, size: Column) -> Column:
    """Lines of a text box; a normal line is 1.2 times the size."""
    return F.greatest(F.lit(1), F.floor(inner / F.coalesce(line_height, size * 1.2) + 0.5)).cast("int")


def hero_media(media: DataFrame, hero: DataFrame) -> DataFrame:
    """Media that overlap the band of their page's hero."""
    return matching.overlapping(media, hero, ["case"], ("m_top", "m_bottom"), ("h_top", "h_bottom"), 1000)


def hero_actions(buttons: DataFrame, hero: DataFrame) -> DataFrame:
    """Actions that begin within the hero and outside the navigation."""
    h = hero.select("case", F.col("top").alias("h_top"), F.col("height").alias("h_height"))
    return buttons.join(h, "case").where(~F.coalesce("in_nav", F.lit(False)) & (F.col("top") >= F.col("h_top") - 1) & (F.col("top") < F.col("h_top") + F.col("h_height")))


def main_parts(navs: DataFrame, heads: DataFrame) -> DataFrame:
    """(case, nav, headline): the topmost, then widest navigation; the largest, then topmost headline."""
    n = navs.groupBy("case").agg(F.min_by("name", F.struct("top", -F.col("width"))).alias("nav"))
    h = heads.groupBy("case").agg(F.max_by("name", F.struct("size", -F.col("top"))).alias("headline"))
    return n.join(h, "case", "full_outer")


def widest_shot(probe: DataFrame) -> DataFrame:
    """(case, viewport_w): the widest desktop shot of a case, else its widest."""
    w = F.col("viewport_w")
    return probe.groupBy("case").agg(F.coalesce(F.max(F.when(w >= DESKTOP, w)), F.max(w)).alias("viewport_w"))


def design_gate(
    probe: DataFrame,
    sections: DataFrame,
    hero: DataFrame,
    nav: DataFrame,
    buttons: DataFrame,
    forms: DataFrame,
    census: DataFrame,
    page_text: DataFrame,
    src_hits: DataFrame,
    motion: DataFrame,
    intents: DataFrame,
    mode: str = "build",
    strict: bool = False,
    brief: str = "",
    banned: Sequence[str] = (),
    banned_serifs: Sequence[str] = (),
    warm: Sequence[str] = (),
) -> DataFrame:
    """Gate results of the design of each case; see the tables of fixtures for the columns of its inputs."""
    authored = mode != "match"
    shot = widest_shot(probe)
    at = lambda d: d.join(F.broadcast(shot), ["case", "viewport_w"], "left_semi")
    cases = probe.select("case").distinct()

    def per_case(d: DataFrame) -> DataFrame:
        return cases.join(d, "case", "left")

    strings = F.array(*[F.lit(b) for b in banned]).cast("array<string>")
    hit = F.filter(strings, lambda b: F.contains(F.lower("body"), F.lower(b)))
    prose = gates.judged(
        per_case(page_text),
        "case",
        [gates.rule("em dash", F.lit(not authored) | (F.col("em_dashes") == 0), F.col("em_dashes")), gates.rule("banned strings", F.lit(not authored) | (F.size(hit) == 0), F.array_join(hit, ", "), known=F.col("body").isNotNull())],
    )
    sec = at(sections)
    flat = ~F.coalesce("bg_image", F.lit(False)) & (F.coalesce("media", F.lit(0)) == 0)
    per = sec.groupBy("case").agg(F.count("*").alias("n"), F.avg(F.when(flat, 1.0).otherwise(0.0)).alias("flat"))
    shapes = sec.where(F.size("open_shape") >= 2).withColumn("shape", F.array_join("open_shape", ">"))
    top = tallies.most_common(shapes, ["case"], "shape", "idx").select("case", "shape", F.col("n").alias("repeats"))
    run = tallies.true_runs(sec, ["case"], "split_image_text", ["idx"]).withColumnRenamed("longest", "split_run")
    cross = tallies.sign_changes(sec.where(~F.coalesce("bg_image", F.lit(False)) & F.col("bg_lum").isNotNull()), ["case"], F.col("bg_lum") > 0.5, ["idx"])
    brows = census.where("kind = 'eyebrow'").groupBy("case").agg(F.sum("uses").alias("eyebrows"))
    layout = gates.judged(
        per_case(per).join(top, "case", "left").join(run, "case", "left").join(cross, "case", "left").join(brows, "case", "left"),
        "case",
        [
            gates.rule("eyebrows", F.coalesce("eyebrows", F.lit(0)) <= eyebrow_budget(F.col("n")), F.col("eyebrows")),
            gates.rule("flat sections", F.col("flat") <= FLAT_SHARE, F.bround("flat", 2), "WARN"),
            gates.rule("opening shape", F.coalesce("repeats", F.lit(0)) < REPEAT, F.concat("shape", F.lit(" x"), "repeats"), "WARN", F.col("n").isNotNull()),
            gates.rule("split runs", F.col("split_run") < SPLIT_RUN, F.col("split_run")),
            F.struct(
                F.lit("theme").alias("gate"),
                F.when(F.col("changes").isNull(), "UNVERIFIED").when(F.col("changes") == 0, "pass").when(F.col("changes") == 1, "WARN").otherwise("FAIL").alias("status"),
                F.when(F.col("changes") > 0, F.concat("changes", F.lit(" crossings"))).otherwise("").alias("detail"),
            ),
        ],
    )
    bar = gates.judged(per_case(at(nav)), "case", [gates.rule("navigation height", F.col("height") <= NAV_HEIGHT + NAV_SLACK, F.col("height")), gates.rule("navigation rows", F.col("rows") <= 1, F.col("rows"))])
    seen = (F.col("real_media") > 0) | (F.col("background_photos") > 0)
    front = gates.judged(
        per_case(at(hero)),
        "case",
        [
            gates.rule("hero padding", F.col("padding_top") <= HERO_PADDING, F.col("padding_top")),
            gates.rule("first action in view", F.col("first_cta_top") < F.col("viewport_height"), F.col("first_cta_top")),
            gates.rule("headline lines", F.col("headline_lines") <= HEADLINE_LINES, F.col("headline_lines")),
            gates.rule("hero visual", seen, "no real visual", "FAIL" if strict else "WARN"),
            gates.rule("below the actions", F.col("text_below_ctas") == 0, F.col("text_below_ctas"), "WARN"),
        ],
    )
    low = F.col("contrast") < F.col("required")
    bad = buttons.groupBy("case").agg(F.count_if(low & ~F.coalesce("over_image", F.lit(False))).alias("low"), F.count_if(F.coalesce("over_image", F.lit(False))).alias("over"))
    wraps = at(buttons).groupBy("case").agg(F.count_if((F.col("lines") >= 2) & (F.col("words") >= 2)).alias("wrapped"))
    calls = gates.judged(
        per_case(bad).join(wraps, "case", "left"),
        "case",
        [gates.rule("action contrast", F.col("low") == 0, F.col("low")), gates.rule("action contrast over images", F.col("over") == 0, F.col("over"), "WARN"), gates.rule("action labels", F.coalesce("wrapped", F.lit(0)) == 0, F.col("wrapped"), known=F.col("low").isNotNull())],
    )
    field = forms.groupBy("case").agg(F.count_if(F.col("contrast") < 4.5).alias("dim"), F.count_if("placeholder_only_label").alias("unlabelled"), F.count_if(F.col("placeholder_contrast") < 4.5).alias("faint"))
    fields = gates.judged(
        cases.join(field, "case", "left").na.fill(0, ["dim", "unlabelled", "faint"]),
        "case",
        [gates.rule("form contrast", F.col("dim") == 0, F.col("dim")), gates.rule("form labels", F.col("unlabelled") == 0, F.col("unlabelled")), gates.rule("placeholder contrast", F.col("faint") == 0, F.col("faint"), "WARN")],
    )
    kind, uses, low_value = F.col("kind"), F.col("uses"), F.lower("value")
    loaded = F.coalesce("loaded", F.lit(False))
    counted = census.groupBy("case").agg(
        F.count_if((kind == "accent") & (uses >= ACCENT_USES)).alias("accents"),
        F.count_if((kind == "radius") & (uses >= RADIUS_USES)).alias("radii"),
        F.count_if((kind == "font") & loaded & (uses >= 2) & low_value.isin(list(banned_serifs))).alias("serifs"),
        F.count_if((kind == "font") & ~loaded & (uses >= 2) & ~low_value.isin(*SYSTEM_FACES)).alias("unloaded"),
        F.array_sort(F.array_intersect(F.collect_set(F.when(kind == "colour", low_value)), F.array(*[F.lit(w) for w in warm]).cast("array<string>"))).alias("warm"),
    )
    palette = gates.judged(
        per_case(counted),
        "case",
        [
            gates.rule("one accent", F.col("accents") <= 1, F.col("accents")),
            gates.rule("radii", F.col("radii") <= RADII, F.col("radii")),
            gates.rule("banned serif", F.col("serifs") == 0, F.col("serifs")),
            gates.rule("fonts load", F.col("unloaded") == 0, F.col("unloaded")),
            gates.rule("warm palette", F.size("warm") == 0, F.array_join("warm", ", "), "FAIL" if brief == "premium-consumer" else "WARN", F.col("accents").isNotNull()),
        ],
    )
    moves = gates.judged(
        per_case(motion),
        "case",
        [
            gates.rule("reduced motion", (F.col("reduced_motion_rules") > 0) | (F.col("infinite") + F.col("marquees") + F.col("canvases") < 0), "no rule for reduced motion", "FAIL" if authored else "WARN", (F.col("reduced_motion_rules") > 0) | (F.col("stylesheets_unreadable") == 0)),
            gates.rule("marquees", F.col("marquees") <= 1, F.col("marquees")),
        ],
    )
    twice = duplicate_intents(buttons.groupBy("case").agg(F.array_join(F.array_sort(F.collect_set("label")), "\n").alias("labels")), intents, "case", "labels").groupBy("case").agg(F.array_join(F.array_sort(F.collect_list("intent")), ", ").alias("twice"))
    same = gates.judged(cases.join(twice, "case", "left"), "case", [gates.rule("duplicate intents", F.col("twice").isNull(), F.col("twice"), "WARN")])
    src = src_hits.groupBy("case").agg(F.count_if(F.col("tier") == "FAIL").alias("bad"), F.count_if(F.col("tier") == "WARN").alias("warned"))
    source = gates.judged(per_case(src), "case", [gates.rule("source", F.col("bad") == 0, F.col("bad")), gates.rule("source advice", F.col("warned") == 0, F.col("warned"), "WARN")])
    return gates.together(prose, layout, bar, front, calls, fields, palette, moves, same, source)


#: Folders of a source tree that are not read, and extensions that are.
SOURCE_SKIP = ("node_modules", "dist", "build", "out", "vendor", "coverage")
SOURCE_EXT = ("js", "jsx", "ts", "tsx", "css", "scss", "html", "vue", "svelte", "astro", "mjs")


#: Characters of a literal that lines are looked up by.
GRAM = 3


def required(pattern: str) -> str:
    """The longest literal, in small letters, that every match of a pattern holds; empty where none is sure."""
    from re import _constants as op
    from re import _parser

    best, run = "", ""

    def take(parts) -> None:
        nonlocal best, run
        for what, value in parts:
            if what is op.LITERAL and chr(value).lower() == chr(value).lower().casefold() and len(chr(value).lower()) == 1:
                run += chr(value).lower()
            elif what is op.SUBPATTERN and not value[1] and not value[2]:
                take(value[3])
                continue
            elif what is not op.AT:
                if what in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:  # once at least
                    run = ""
                    take(value[2])
                run = ""
            best = max(best, run, key=len)

    try:
        take(_parser.parse(pattern))
    except Exception:  # a pattern of the engine's own kind
        return ""
    return best


def line_hits(lines: DataFrame, rules: DataFrame, body: str = "body") -> DataFrame:
    """Columns of lines and rules of each line in which a rule's pattern is found.

    Rules (pattern, ...) are matching.SMALL at most. Lines are looked up by the
    first characters of a literal that a rule's matches must hold, by an
    equi-join; only those that hold the literal are tried with the pattern.
    Rules without such a literal are tried on every line, in one expression.
    Null lines have no hit; a rule that repeats gives each of its hits again.
    """
    from weftline.operators import matching

    spark = lines.sparkSession
    own = [r.asDict() for r in rules.limit(matching.SMALL + 1).collect()]
    if len(own) > matching.SMALL:
        raise ValueError(f"more than {matching.SMALL} rules")
    kind = rules.schema
    sure = [(required(r["pattern"]), r) for r in own]
    low = F.lower(F.col(body))
    found = []
    by_gram = [(lit[:GRAM], lit, *(r[c] for c in kind.names)) for lit, r in sure if len(lit) >= GRAM]
    if by_gram:
        keyed = spark.createDataFrame(by_gram, StructType([StructField("__gram", StringType()), StructField("__literal", StringType()), *kind.fields]))
        grams = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
        spots = lines.where(F.length(body) >= GRAM).withColumn("__gram", F.explode(grams))
        hit = spots.join(F.broadcast(keyed), "__gram").where(F.contains(low, F.col("__literal"))).where(F.expr(f"regexp_like(`{body}`, pattern)"))
        found.append(hit.select(*lines.columns, *rules.columns))
    rest = [r for lit, r in sure if len(lit) < GRAM]
    if rest:
        tried = F.array(*[F.when(F.regexp_like(body, F.lit(r["pattern"])), F.struct(*[F.lit(r[c]).cast(kind[c].dataType).alias(c) for c in kind.names])) for r in rest])
        found.append(lines.withColumn("__rule", F.explode(F.array_compact(tried))).select(*lines.columns, "__rule.*"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], StructType([*lines.schema.fields, *kind.fields]))


def source_hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(rel, line, tier, message): one hit for each line and rule. files (rel, text); rules (pattern, tier, message), see line_hits()."""
    parts = F.split("rel", "/")
    kept = files.where(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*SOURCE_SKIP) | p.startswith(".")) & F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*SOURCE_EXT))
    lines = kept.select("rel", F.posexplode(F.split("text", "\n")).alias("at", "body"))
    return line_hits(lines, rules).select("rel", (F.col("at") + 1).alias("line"), "tier", "message")
