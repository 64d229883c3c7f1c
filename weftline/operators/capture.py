"""Token captures of rendered pages: style tallies, rules, canvases."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import tallies
from weftline.session import cut

#: Elements read of a page, and the style properties of each tally.
ELEMENTS = 4000
KINDS = {"families": "font-family", "type": "font-size", "colours": "color", "backgrounds": "background-color", "radii": "border-radius", "shadows": "box-shadow", "transitions": "transition", "spacing": "padding", "gaps": "gap", "borders": "border"}
#: Classes that name a state, and elements of a selector path.
STATE_CLASS, HOPS = r"^(is|has)-|active|visible", 4
STATES = r"(?i):(hover|focus-visible|focus|active)\b"


#: A piece of a style sheet up to the next brace or semicolon that stands in no string and no brackets.
_QUOTED = r"""\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'"""
PIECE = rf"""(?s)(?:[^{{}};"'(]++|{_QUOTED}|\((?:[^()"']++|{_QUOTED})*+\)|\()*+[{{}};]"""


def css_rules(sheets: DataFrame) -> DataFrame:
    """(page, sheet, ord, type, selector, condition, media, declarations, css_text, readable): the rules of source text (page, sheet, css), those within grouping rules too.

    type is style, or the at-rule's name; condition is what stands behind that
    name; media are the conditions of the rules around, outermost first. What
    stands in keyframes belongs to them and is no rule. A sheet is cut at its
    braces; their running sum is the depth of each piece, and a piece belongs
    to the last block that was opened on its level, so no sheet is walked in
    one piece. Null and empty sheets have no rules, a block that isn't closed
    ends with its sheet, a brace too many closes nothing.
    """
    clean = sheets.where("css is not null").select("page", "sheet", F.regexp_replace("css", r"(?s)/\*.*?\*/", " ").alias("css"))
    clean = cut(clean.withColumn("id", F.monotonically_increasing_id()))
    # what follows the last brace or semicolon counts as a piece of its own
    pieces = F.regexp_extract_all(F.concat("css", F.lit(";")), F.lit(PIECE), F.lit(0))
    w = Window.partitionBy("id").orderBy("pos")
    mark, body = F.substring("piece", -1, 1), F.trim(F.regexp_replace(F.expr("left(piece, length(piece) - 1)"), r"\s+", " "))
    rows = clean.select("id", F.posexplode(pieces).alias("pos", "piece")).select("id", "pos", mark.alias("mark"), body.alias("body"), F.length("piece").alias("size"), F.length(F.regexp_extract("piece", r"^\s*", 0)).alias("lead"))
    step = F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)
    rows = rows.withColumn("sum", F.sum(step).over(w)).withColumn("end", F.sum("size").over(w))
    depth = F.col("sum") - F.least(F.min("sum").over(w), F.lit(0))
    rows = rows.withColumn("after", depth)
    level = F.when(F.col("mark") == "}", F.col("after") + 1).otherwise(F.col("after"))
    rows = rows.select("id", "pos", "mark", "body", "end", (F.col("end") - F.col("size") + F.col("lead") + 1).alias("begin"), level.alias("level"))
    # on its level, each block is opened and closed before the next one
    by_level = Window.partitionBy("id", "level").orderBy("pos")
    edges = rows.where("mark in ('{', '}')").withColumn("close", F.lead(F.when(F.col("mark") == "}", F.col("end"))).over(by_level))
    opened = edges.where("mark = '{'").select("id", "pos", "level", "body", "begin", "close")
    # declarations, and blocks one level further in, look for the last block that was opened before them
    asking = rows.where("mark <> '{' and body <> ''").select("id", "pos", "level", F.col("body").alias("text"), F.lit(None).cast("int").alias("own")).unionByName(
        opened.select("id", "pos", (F.col("level") - 1).alias("level"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("own"))
    )
    told = asking.unionByName(opened.select("id", "pos", "level", F.lit(None).cast("string").alias("text"), F.col("pos").alias("own")))
    found = told.withColumn("owner", F.last("own", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("own is null")
    said = found.where("text is not null and owner is not null").groupBy("id", F.col("owner").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("said"))
    parents = found.where("text is null").select("id", "pos", F.col("owner").alias("parent"))
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract("body", r"^@(?:-[a-z]+-)?([\w-]+)", 1)), F.lit("")), F.lit("style"))
    rest = F.trim(F.regexp_replace("body", r"^@[\w-]+", ""))
    blocks = cut(opened.join(parents, ["id", "pos"], "left").select("id", "pos", "level", "parent", "begin", "close", "body", kind.alias("type"), rest.alias("rest")))
    done = [blocks.where("parent is null").withColumn("media", F.array().cast("array<string>"))]
    for depth_ in range(2, (blocks.agg(F.max("level")).first()[0] or 0) + 1):
        above = done[-1].where("type <> 'keyframes'").select("id", F.col("pos").alias("parent"), F.when(F.col("type") == "style", F.col("media")).otherwise(F.array_append("media", F.col("rest"))).alias("media"))
        done.append(cut(blocks.where(F.col("level") == depth_).join(above, ["id", "parent"]).select("id", "pos", "level", "parent", "begin", "close", "body", "type", "rest", "media")))
    rules = reduce(DataFrame.unionByName, done).join(said, ["id", "pos"], "left").join(clean, "id")
    pair = lambda d: F.struct(F.lower(F.trim(F.substring_index(d["text"], ":", 1))).alias("property"), F.trim(F.substring(d["text"], F.instr(d["text"], F.lit(":")) + 1, F.length(d["text"]))).alias("value"))
    own = F.transform(F.filter(F.coalesce("said", F.array().cast("array<struct<pos:int,text:string>>")), lambda d: F.contains(d["text"], F.lit(":")) & ~d["text"].startswith("@")), pair)
    return rules.select(
        "page", "sheet", F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("ord"), "type", F.when(F.col("type").isin("style", "keyframes"), F.col("rest")).alias("selector"),
        F.when(~F.col("type").isin("style", "keyframes", "font-face"), F.col("rest")).alias("condition"), "media", F.when(F.col("type") == "keyframes", F.array().cast("array<struct<property:string,value:string>>")).otherwise(own).alias("declarations"),
        F.expr("substring(css, begin, coalesce(close, length(css)) - begin + 1)").alias("css_text"), F.lit(True).alias("readable"),
    )


def style_tallies(elements: DataFrame, top: int = 12) -> DataFrame:
    """(page, kind, value, n, rank): the most frequent values of each style property, over the first elements of a page that have a box."""
    seen = elements.where((F.col("ord") < ELEMENTS) & (F.col("rect.width") > 0) & (F.col("rect.height") > 0))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.try_element_at("style", F.lit(p)).alias("value")) for k, p in KINDS.items()])
    return tallies.tally(seen.select("page", F.explode(pairs).alias("s")).select("page", "s.*"), "value", ["page", "kind"], top)


def palette_tiers(tally: DataFrame, structural: float = 0.05) -> DataFrame:
    """(page, kind, value, tier): frequent values are the system, rare ones decoration."""
    total = tally.groupBy("page", "kind").agg(F.sum("n").alias("total"))
    return tally.join(total, ["page", "kind"]).select("page", "kind", "value", "n", F.when(F.col("n") / F.col("total") >= structural, "structural").otherwise("decoration").alias("tier"))


def root_properties(rules: DataFrame) -> DataFrame:
    """(page, name): custom properties that root rules set."""
    own = rules.where(F.regexp_like("selector", F.lit(r"(?i)(^|,)\s*(:root|html)\s*(,|$)")))
    return own.select("page", F.explode(F.regexp_extract_all("css_text", F.lit(r"(--[\w-]+)\s*:"), F.lit(1))).alias("name")).distinct()


def conditions(rules: DataFrame) -> DataFrame:
    """(page, condition): distinct media conditions, the real breakpoints."""
    return rules.where("type = 'media' and condition is not null").select("page", "condition").distinct()


def first_of(rows: DataFrame, n: int) -> DataFrame:
    return tallies.ranked(rows, ["page"], [F.asc("ord")], n).drop("rank")


def font_faces(rules: DataFrame) -> DataFrame:
    """(page, family, src): the first 30 faces, sources cut to 120 characters."""
    own = first_of(rules.where("type = 'font-face'"), 30)
    return own.select("page", F.regexp_extract("css_text", r"(?i)font-family:\s*([^;]+)", 1).alias("family"), F.substring(F.regexp_extract("css_text", r"(?is)src:\s*([^;]+)", 1), 1, 120).alias("src"))


def interaction_rules(rules: DataFrame) -> DataFrame:
    return first_of(rules.where(F.regexp_like("selector", F.lit(STATES))), 40).select("page", "selector", "css_text")


def keyframes(rules: DataFrame) -> DataFrame:
    return rules.where("type = 'keyframes'").select("page", F.col("selector").alias("name"), "css_text")


def scroll_driven(rules: DataFrame) -> DataFrame:
    own = rules.where((F.col("type") == "style") & F.regexp_like("css_text", F.lit(r"(?i)(animation-timeline|scroll-timeline|view-timeline|scroll-snap|position:\s*sticky)")))
    return first_of(own, 20).select("page", "selector", "css_text")


def unreadable_sheets(rules: DataFrame) -> DataFrame:
    return rules.where("not readable").groupBy("page").agg(F.count_distinct("sheet").alias("unreadable"))


def libraries(probes: DataFrame) -> DataFrame:
    """(page, library): runtime libraries whose probe is true. probes (page, found map)."""
    return probes.select("page", F.explode(F.map_filter("found", lambda k, v: v)).alias("library", "yes")).select("page", "library")


def live_animations(animations: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, n, note): live animations, at most 60, and a note where none live but keyframes exist: the page wasn't scrolled."""
    live = animations.groupBy("page").agg(F.least(F.count("*"), F.lit(60)).alias("n"))
    kf = rules.where("type = 'keyframes'").groupBy("page").agg(F.count("*").alias("k"))
    j = live.join(kf, "page", "full_outer").na.fill(0)
    return j.select("page", "n", F.when((F.col("n") == 0) & (F.col("k") > 0), "keyframes but nothing live: scroll first").alias("note"))


def largest_canvas(canvases: DataFrame) -> DataFrame:
    """(page, id, warn): the largest canvas of a page, marked if both of its sides reach 200."""
    best = canvases.groupBy("page").agg(F.max_by(F.struct("id", "css_w", "css_h"), F.struct(F.col("css_w") * F.col("css_h"), "id")).alias("c"))
    return best.select("page", "c.id", ((F.col("c.css_w") >= 200) & (F.col("c.css_h") >= 200)).alias("warn"))


def uncovered_waapi(events: DataFrame, polled: DataFrame) -> DataFrame:
    """Polled animations that no event has covered already, by target and name."""
    return polled.join(events.select("target", "name"), ["target", "name"], "left_anti")


def filled_ends(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Starts without an end value take the last one that was seen for their element and property."""
    last = ends.groupBy("element", "property").agg(F.max_by("to", "seq").alias("__to"))
    return starts.join(last, ["element", "property"], "left").withColumn("to", F.coalesce("to", "__to")).drop("__to")


def selector_paths(elements: DataFrame) -> DataFrame:
    """(page, node, path): a selector of each element (page, node, parent, tag, id, classes, nth, alike): itself and its ancestors up to an id or HOPS of them, outermost first.

    A step is the tag in small letters and #id, which ends the way up, or up
    to two classes that are no state, and its place among siblings of its tag
    where there are several (nth of alike). Each hop is an equi-join of the
    elements still on their way.
    """
    kept = F.slice(F.filter(F.coalesce("classes", F.array().cast("array<string>")), lambda c: ~F.regexp_like(c, F.lit(STATE_CLASS))), 1, 2)
    own = F.concat(F.lower("tag"), F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit("#"), "id")).otherwise(F.concat(F.array_join(F.transform(kept, lambda c: F.concat(F.lit("."), c)), ""), F.when(F.col("alike") > 1, F.concat(F.lit(":nth-of-type("), "nth", F.lit(")"))).otherwise(""))))
    steps = elements.select("page", "node", "parent", own.alias("step"), (F.coalesce("id", F.lit("")) != "").alias("named"))
    way = steps.select("page", "node", F.when(~F.col("named"), F.col("parent")).alias("up"), F.col("step").alias("path"))
    above = steps.select(F.col("page").alias("p"), F.col("node").alias("n"), F.col("parent").alias("next"), "step", "named")
    for _ in range(HOPS - 1):
        joined = way.join(above, (F.col("page") == F.col("p")) & (F.col("up") == F.col("n")), "left")
        way = joined.select("page", "node", F.when(~F.col("named"), F.col("next")).alias("up"), F.when(F.col("step").isNotNull(), F.concat("step", F.lit(" > "), "path")).otherwise(F.col("path")).alias("path"))
    return way.select("page", "node", "path")


def design_dials(motion: DataFrame, sections: DataFrame) -> DataFrame:
    """(page, animations, durations, layouts): how much moves and how many layouts there are."""
    m = motion.groupBy("page").agg(F.count("*").alias("animations"), F.array_sort(F.collect_set("duration")).alias("durations"))
    s = sections.groupBy("page").agg(F.count_distinct("open_shape").alias("layouts"))
    return m.join(s, "page", "full_outer")


def hydration(counts: DataFrame) -> DataFrame:
    """(page, failed): about twice the nodes of the reference says that a page was rendered twice. counts (page, side, nodes)."""
    j = counts.groupBy("page").agg(F.max(F.when(F.col("side") == "reference", F.col("nodes"))).alias("r"), F.max(F.when(F.col("side") == "build", F.col("nodes"))).alias("b"))
    return j.select("page", (F.col("b") >= 1.8 * F.col("r")).alias("failed"))


#: Elements without content, and those that end an open one of their kind.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
SELF_CLOSING = ("p", "li", "tr", "td", "th", "option", "dt", "dd")
#: Comments, what scripts and styles hold, and tags.
TAGS = re.compile(r"""<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-z][\w-]*)(?:[^>"']|"[^"]*"|'[^']*')*>""", re.I | re.S)


def tag_paths(html: str) -> list[str]:
    """The distinct paths of tags of a page, sorted."""
    stack: list[str] = []
    found = set()
    for m in TAGS.finditer(html):
        raw, closes, tag = m.group(1), m.group(2), (m.group(3) or "").lower()
        if raw:
            found.add(" > ".join([*stack, raw.lower()]))
        elif closes:
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]
        elif tag:
            if tag in SELF_CLOSING and tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            found.add(" > ".join([*stack, tag]))
            if tag not in VOID:
                stack.append(tag)
    return sorted(found)


def by_structure(pages: DataFrame, page_col: str = "page", html_col: str = "html", depth: int = 3) -> DataFrame:
    """(page, template, parts): the paths of tags of each page, and as its template a hash of those of few steps. Null and empty pages have no parts and share a template."""

    @F.pandas_udf("array<string>")
    def paths(html: pd.Series) -> pd.Series:
        return html.map(lambda h: tag_paths(h) if isinstance(h, str) else [])

    rows = pages.select(F.col(page_col).alias("page"), paths(html_col).alias("parts"))
    return rows.withColumn("template", F.md5(F.array_join(F.filter("parts", lambda p: F.size(F.split(p, " > ")) <= depth), "\n"))).select("page", "template", "parts")


def templates(pages: DataFrame) -> DataFrame:
    """(template, instances, fixed, varying): what all instances of a template share and what differs."""
    flat = pages.select("template", "page", F.explode("parts").alias("part"))
    n = pages.groupBy("template").agg(F.count_distinct("page").alias("instances"))
    p = flat.groupBy("template", "part").agg(F.count_distinct("page").alias("k")).join(n, "template")
    kind = F.col("k") == F.col("instances")
    return p.groupBy("template", "instances").agg(F.array_sort(F.collect_list(F.when(kind, F.col("part")))).alias("fixed"), F.array_sort(F.collect_list(F.when(~kind, F.col("part")))).alias("varying"))
