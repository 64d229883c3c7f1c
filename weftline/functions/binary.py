"""Column functions over bytes, byte ranges and media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (first bytes in hex, offset, media type).
SIGNATURES = [
    ("89504E470D0A1A0A", 0, "image/png"),
    ("FFD8FF", 0, "image/jpeg"),
    ("47494638", 0, "image/gif"),
    ("774F4632", 0, "font/woff2"),
    ("774F4646", 0, "font/woff"),
    ("4F54544F", 0, "font/otf"),
    ("00010000", 0, "font/ttf"),
    ("74727565", 0, "font/ttf"),
]
ICON = "00000100"
#: Brands of ISO media files and their types.
BRANDS = [("avif", "image/avif"), ("avis", "image/avif"), ("heic", "image/heic"), ("heix", "image/heic"), ("mif1", "image/heic")]
#: Types by extension.
BY_NAME = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "mjs": "text/javascript", "json": "application/json",
    "map": "application/json", "xml": "application/xml", "txt": "text/plain", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "ico": "image/x-icon", "woff2": "font/woff2", "woff": "font/woff", "ttf": "font/ttf", "otf": "font/otf",
    "mp4": "video/mp4", "webm": "video/webm", "wasm": "application/wasm",
}


def sniffed(head: Column) -> Column:
    """Media type by the first bytes; null if they say nothing."""
    h = F.hex(F.substring(head, 1, 16))
    out = F.when(F.lit(False), F.lit(""))
    for sign, at, kind in SIGNATURES:
        out = out.when(F.substring(h, 2 * at + 1, len(sign)) == sign, kind)
    out = out.when((F.substring(h, 1, 8) == "52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    iso = F.substring(h, 9, 8) == "66747970"
    for brand, kind in BRANDS:
        out = out.when(iso & (F.substring(h, 17, 8) == brand.encode().hex().upper()), kind)
    return out.when(iso, "video/mp4").when(F.substring(h, 1, 8) == ICON, "image/x-icon")


def named(name: Column) -> Column:
    """Media type by the extension of a file name."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./?#]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv]), ext)


def media_type(name: Column, head: Column) -> Column:
    """Types of text stand by name; for others the bytes decide where they can."""
    own = named(name)
    is_text = own.startswith("text/") | own.isin("application/json", "application/xml", "image/svg+xml")
    return F.when(F.coalesce(is_text, F.lit(False)), own).otherwise(F.coalesce(sniffed(head), own, F.lit("application/octet-stream")))


def byte_ranges(text: Column) -> Column:
    """"a-b,c-d" as inclusive ranges; null if any part is malformed or runs backwards."""
    fine = F.regexp_like(text, F.lit(r"^ *\d+-\d+ *(?:, *\d+-\d+ *)*$"))
    ends = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "-"))
    made = F.transform(ends, lambda e: F.struct(F.get(e, F.lit(0)).try_cast("long").alias("first"), F.get(e, F.lit(1)).try_cast("long").alias("last")))
    return F.when(fine & F.forall(made, lambda r: F.coalesce(r["first"] <= r["last"], F.lit(False))), made)


def sliced(payload: Column, ranges: Column) -> Column:
    """Bytes of the ranges one behind the other, in the order asked for; a range ends with the payload, and beyond it is empty."""
    return F.aggregate(
        ranges, F.lit(b"").cast("binary"), lambda acc, r: F.concat(acc, F.substring(payload, (r["first"] + 1).cast("int"), F.greatest(F.least(r["last"], F.length(payload) - 1) - r["first"] + 1, F.lit(0)).cast("int")))
    )
