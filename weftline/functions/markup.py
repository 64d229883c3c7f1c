"""Column functions over HTML, CSS and script source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Patterns of page source that the rules read.
ANCHOR = r'<a\b[^>]*?href="([^"#][^"]*)"'
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["'](.*?)["']"""
CANONICAL = r"""(?i)<link[^>]+rel=["']canonical["']"""
LANG = r"(?i)<html[^>]+lang="
H1 = r"(?i)<h1[\s>]"
IMAGE = r"(?i)<img\b[^>]*>"
LINKED_DATA = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
STYLE = r"(?is)<style[^>]*>(.*?)</style>"
IMPORT_MAP = r"""(?is)<script[^>]+type=["']importmap["'][^>]*>(.*?)</script>"""
APPEAR = r"""(?is)<script[^>]+type=["']framer/appear["'][^>]*>(.*?)</script>"""
FIGURE = r"\b\d[\d,.:]*\b"


def hrefs(html: Column) -> Column:
    """Double-quoted link targets that aren't fragments, in order."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))


def og_flag(html: Column, name: str) -> Column:
    return F.regexp_like(html, F.lit(rf"""(?i)property=["']og:{name}["']"""))


def images_without_alt(html: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)), lambda i: ~F.regexp_like(i, F.lit(r"(?i)\balt="))))


def linked_data(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(LINKED_DATA), F.lit(1)), lambda b: F.trim(b))


def import_map(html: Column) -> Column:
    """Entries of the first import map; an empty map without a readable one."""
    raw = F.regexp_extract(html, IMPORT_MAP, 1)
    parsed = F.from_json(raw, "struct<imports: map<string, string>>")
    return F.coalesce(parsed["imports"], F.from_json(F.lit("{}"), "map<string,string>"))


def entrance_payloads(html: Column) -> Column:
    """Readable JSON of embedded entrance animations."""
    raw = F.regexp_extract_all(html, F.lit(APPEAR), F.lit(1))
    return F.filter(F.transform(raw, lambda s: F.to_json(F.try_parse_json(s))), lambda s: s.isNotNull())


def srcset_urls(srcset: Column) -> Column:
    """The URL of each candidate of an image list."""
    return F.filter(F.transform(F.split(srcset, ","), lambda c: F.element_at(F.split(F.trim(c), r"\s+"), 1)), lambda u: u != "")


def srcset_rewrite(srcset: Column, places: Column) -> Column:
    """An image list with each URL replaced by its place; the list as it was if none has one."""
    parts = F.transform(F.split(srcset, ","), lambda c: F.split(F.trim(c), r"\s+"))
    new = F.transform(
        parts,
        lambda p: F.array_join(F.concat(F.array(F.coalesce(F.element_at(places, F.element_at(p, 1)), F.element_at(p, 1))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))), " "),
    )
    return F.when(F.exists(parts, lambda p: F.map_contains_key(places, F.element_at(p, 1))), F.array_join(new, ", ")).otherwise(srcset)


#: Fixed values: (class of change, pattern, replacement) of each pass that takes live parts out of a page.
NEUTRALISERS = [
    ("sri-strip", r"""\s(?:integrity|crossorigin)=(?:"[^"]*"|'[^']*')""", ""),
    ("sri-strip", r"""\s(?:crossorigin)(?=[\s>])""", ""),
    ("tracker-strip", r"""(?s)<script(?:(?!</script>)[^>])*>(?:(?!</script>).)*?event:\s*['"]gtm\.js['"](?:(?!</script>).)*?insertBefore\(j\s*,\s*f\)(?:(?!</script>).)*?</script>""", ""),
    ("tracker-strip", r"(?i)<noscript>\s*<iframe[^>]*\bgtm-iframe\b[^>]*></iframe>\s*</noscript>", ""),
    ("tracker-strip", r'("mixpanel":\{[^}]*?"token":")[a-f0-9]{16,64}(")', "$1$2"),
    ("form-inert", r"""(?i)(<form\b[^>]*?\baction=)(?:"[^"]*"|'[^']*')""", '$1"#inert"'),
    ("sdk-hardened", r"""\.get_config=function\((\w+)\)\{return\s+this(?:\.config|\[['"]config['"]\])\[\1\]\}""", ".get_config=function($1){return(this.config||{})[$1]}"),
]


def neutralised(html: Column) -> Column:
    for _, pattern, new in NEUTRALISERS:
        html = F.regexp_replace(html, pattern, new)
    return html


def neutralised_counts(html: Column) -> Column:
    """How often each class of change applies, as a map."""
    counts: dict[str, Column] = {}
    for name, pattern, new in NEUTRALISERS:
        own = F.regexp_count(html, F.lit(pattern))
        counts[name] = counts[name] + own if name in counts else own
        html = F.regexp_replace(html, pattern, new)
    return F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v)])


def styles(html: Column) -> Column:
    """Style sheets that stand in a page, in order."""
    return F.regexp_extract_all(html, F.lit(STYLE), F.lit(1))


def selector_rules(css: Column, selector: str) -> Column:
    """Bodies of the rules of a selector in raw CSS."""
    import re

    return F.regexp_extract_all(css, F.lit(rf"(?s){re.escape(selector)}\s*\{{([^}}]*)\}}"), F.lit(1))


def custom_properties(css: Column) -> Column:
    return F.regexp_extract_all(css, F.lit(r"(--[\w-]+)\s*:"), F.lit(1))


def audit(html: Column) -> dict[str, Column]:
    """Measures of a page that the copy gate judges."""
    seen = T.visible_text(html, decode=False)
    return {
        "title_len": F.coalesce(F.length(F.nullif(T.first_match(html, TITLE), F.lit(""))), F.lit(0)),
        "has_description": F.regexp_like(html, F.lit(DESCRIPTION)),
        "h1_count": F.regexp_count(html, F.lit(H1)),
        "has_lang": F.regexp_like(html, F.lit(LANG)),
        "has_canonical": F.regexp_like(html, F.lit(CANONICAL)),
        "has_json_ld": F.regexp_like(html, F.lit(LINKED_DATA)),
        "og_count": sum((og_flag(html, n).cast("int") for n in ("title", "description", "image")), F.lit(0)),
        "no_alt": images_without_alt(html),
        "word_count": F.size(T.space_words(seen)),
        "numeric_tokens": F.regexp_count(seen, F.lit(FIGURE)),
        "em_dashes": F.length(seen) - F.length(F.replace(seen, F.lit("—"), F.lit(""))),
    }
