"""Queries of colour, time, range and naming kernels, over values derived from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import binary, colour, text, urls
from weftline.queries.registry import query
from weftline.session import table

RGB_SQL = "select p_partkey as k, (p_partkey * 37) % 256 as r, (p_partkey * 91) % 256 as g, (p_partkey * 151) % 256 as b from part"
LIN = "case when {0} / 255.0 <= 0.03928 then {0} / 255.0 / 12.92 else pow(({0} / 255.0 + 0.055) / 1.055, 2.4) end"
LUM = "(0.2126 * (" + LIN.format("r") + ") + 0.7152 * (" + LIN.format("g") + ") + 0.0722 * (" + LIN.format("b") + "))"


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), (k * 37 % 256).alias("r"), (k * 91 % 256).alias("g"), (k * 151 % 256).alias("b"))


@query("colour_luminance", f"select k, floor({LUM} * 1000 + 0.5) / 1000 as luminance, floor((greatest({LUM}, 1.0) + 0.05) / (least({LUM}, 1.0) + 0.05) * 100 + 0.5) / 100 as on_white from ({RGB_SQL})")
def colour_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lum = colour.luminance(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, sf_dir).select("k", colour.round3(lum).alias("luminance"), (F.floor(colour.contrast(lum, F.lit(1.0)) * 100 + 0.5) / 100).alias("on_white"))


@query("colour_contrast", f"select k, contrast, contrast >= 4.5 as readable from (select k, floor((greatest(l, m) + 0.05) / (least(l, m) + 0.05) * 1000 + 0.5) / 1000 as contrast from (select k, {LUM} as l, {LUM.replace('r /', '(255 - r) /').replace('g /', '(255 - g) /').replace('b /', '(255 - b) /')} as m from ({RGB_SQL})))")
def colour_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of each colour with its opposite."""
    a = colour.luminance(F.col("r"), F.col("g"), F.col("b"))
    b = colour.luminance(255 - F.col("r"), 255 - F.col("g"), 255 - F.col("b"))
    return _rgb(spark, sf_dir).select("k", colour.round3(colour.contrast(a, b)).alias("contrast")).withColumn("readable", F.col("contrast") >= 4.5)


@query("colour_hsl", f"""with c as ({RGB_SQL}), m as (select *, greatest(r, g, b) / 255.0 as mx, least(r, g, b) / 255.0 as mn from c), d as (select *, mx - mn as d, (mx + mn) / 2 as l from m),
 h as (select *, case when d = 0 then 0.0 when mx = r / 255.0 then fmod((g - b) / 255.0 / d, 6) when mx = g / 255.0 then (b - r) / 255.0 / d + 2 else (r - g) / 255.0 / d + 4 end * 60 as h0 from d)
 select k, (floor((case when h0 < 0 then h0 + 360 else h0 end) / 30 + 0.5) * 30 % 360)::int as bucket, floor((case when d = 0 then 0 else d / (1 - abs(2 * l - 1)) end) * 100 + 0.5) / 100 as s, floor(l * 100 + 0.5) / 100 as l, (d * 255 >= 40 and l between 0.12 and 0.9) as accent from h""")  # fmt: skip
def colour_hsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rgb(spark, sf_dir).withColumn("c", colour.hsl(F.col("r"), F.col("g"), F.col("b")))
    two = lambda x: F.floor(x * 100 + 0.5) / 100
    return c.select("k", colour.hue_bucket(F.col("c.h")).alias("bucket"), two(F.col("c.s")).alias("s"), two(F.col("c.l")).alias("l"), ((F.col("c.c") >= 40) & F.col("c.l").between(0.12, 0.9)).alias("accent"))


@query("colour_families", f"""with c as ({RGB_SQL}), m as (select *, greatest(r, g, b) / 255.0 as mx, least(r, g, b) / 255.0 as mn from c), d as (select *, mx - mn as d, (mx + mn) / 2 as l from m where mx > mn),
 h as (select *, case when mx = r / 255.0 then fmod((g - b) / 255.0 / d, 6) when mx = g / 255.0 then (b - r) / 255.0 / d + 2 else (r - g) / 255.0 / d + 4 end * 60 as h0 from d where d * 255 >= 40 and l between 0.12 and 0.9)
 select (floor((case when h0 < 0 then h0 + 360 else h0 end) / 30 + 0.5) * 30 % 360)::int as hue, count(*) as uses from h group by 1""")  # fmt: skip
def colour_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators import design

    rows = _rgb(spark, sf_dir).select(F.lit("all").alias("case"), F.col("k").alias("ord"), colour.hex_of(F.col("r"), F.col("g"), F.col("b")).alias("hex"), F.lit(1).alias("n"))
    return design.accents(rows).select("hue", "uses")


@query("colour_hex", f"select k, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') as hex, r as back, '#' || repeat(lower(to_hex(r % 16)), 2) || repeat(lower(to_hex(g % 16)), 2) || repeat(lower(to_hex(b % 16)), 2) as doubled from ({RGB_SQL})")
def colour_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.concat(F.lit("#"), *[F.hex(F.col(c) % 16) for c in "rgb"])
    hex_ = colour.hex_of(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, sf_dir).select("k", hex_.alias("hex"), colour.hex_channels(hex_)["r"].alias("back"), colour.hex_normal(short).alias("doubled"))


@query("colour_over", f"select k, floor(r * 0.25 + 255 * 0.75 + 0.5)::int as r, floor(g * 0.25 + 255 * 0.75 + 0.5)::int as g, floor(b * 0.25 + 255 * 0.75 + 0.5)::int as b from ({RGB_SQL})")
def colour_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours written as text with a quarter of opacity, parsed and laid over white."""
    said = F.concat(F.lit("rgba("), "r", F.lit(", "), "g", F.lit(" "), "b", F.lit(" / 0.25)"))
    white = F.struct(*[F.lit(255.0).alias(c) for c in "rgb"])
    laid = colour.over(colour.rgb(said), white)
    return _rgb(spark, sf_dir).select("k", laid.alias("c")).select("k", *[F.floor(F.col(f"c.{x}") + 0.5).cast("int").alias(x) for x in "rgb"])


@query("css_times", "select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then l_suppkey when 1 then l_suppkey * 100 else null end::bigint as ms from lineitem")
def css_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat("l_suppkey", F.lit("ms"))).when(F.col("l_linenumber") % 3 == 1, F.concat((F.col("l_suppkey") / 10).cast("decimal(12,1)"), F.lit("s"))).otherwise("auto")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", colour.milliseconds(said).alias("ms"))


@query("curve_numbers", "select p_partkey, case when p_size % 4 = 0 then null else round_even(p_size / 50.0, 4)::varchar || ' ' || round_even(p_size / 64.0, 4)::varchar end as curve from (select p_partkey, p_size::double as p_size from part)")
def curve_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("cubic-bezier("), "p_size", F.lit(", x, 1, 1)"))).otherwise(F.concat(F.lit("cubic-bezier("), F.col("p_size") / 50.0, F.lit(", "), F.col("p_size") / 64.0, F.lit(" , 1, 1)")))
    c = colour.bezier(said)
    return part.select("p_partkey", F.when(c.isNotNull(), F.concat_ws(" ", F.get(c, 0).cast("string"), F.get(c, 1).cast("string"))).alias("curve"))


@query("range_parse", r"""with s as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then l_partkey || '-' || (l_partkey + l_suppkey) when 1 then '0-9, ' || l_partkey || '-' || (l_partkey + 5) when 2 then (l_partkey + 5) || '-' || l_partkey else 'x-' || l_partkey end as raw from lineitem),
 p as (select *, list_transform(string_split(raw, ','), lambda x: trim(x)) as parts from s)
 select l_orderkey, l_linenumber, case when len(list_filter(parts, lambda x: not regexp_full_match(x, '\d+-\d+'))) = 0 and len(list_filter(parts, lambda x: try_cast(split_part(x, '-', 1) as bigint) > try_cast(split_part(x, '-', 2) as bigint))) = 0 then array_to_string(parts, ',') end as ranges from p""")  # fmt: skip
def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") % 4
    raw = F.when(n == 0, F.concat(p, F.lit("-"), p + s)).when(n == 1, F.concat(F.lit("0-9, "), p, F.lit("-"), p + 5)).when(n == 2, F.concat(p + 5, F.lit("-"), p)).otherwise(F.concat(F.lit("x-"), p))
    r = binary.byte_ranges(raw)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(r.isNotNull(), F.array_join(F.transform(r, lambda x: F.concat(x["first"], F.lit("-"), x["last"])), ",")).alias("ranges"))


@query("comma_parts", "select p_partkey, 3 as n, 'opacity ' || p_size || 'ms cubic-bezier(0.1, 1, 0.3, 1)' as second from part")
def comma_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("color 1s, opacity "), "p_size", F.lit("ms cubic-bezier(0.1, 1, 0.3, 1) ,  top 2s"))
    parts = text.top_level_parts(said)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(parts).alias("n"), F.element_at(parts, 2).alias("second"))


@query("asset_truncation", "select page_id, case when page_id % 3 = 0 then base || '/i.png' when page_id % 3 = 1 then base || '/i.webp?w=' || page_id end as asset from (select page_id, regexp_extract(url, '^[^:]+://[^/?#]*', 0) as base from pages)")
def asset_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = urls.origin(F.col("url"))
    said = F.when(F.col("page_id") % 3 == 0, F.concat(base, F.lit("/i.png);--next-prop:red"))).when(F.col("page_id") % 3 == 1, F.concat(base, F.lit("/i.webp?w="), "page_id", F.lit(");x"))).otherwise(F.concat(base, F.lit("/plain")))
    # a host whose own name ends in an asset extension is no case here
    return table(spark, sf_dir, "pages").select("page_id", urls.asset_url(said).alias("asset"))


@query("hash_prefix", "select page_id, substr(sha1(url), 1, 8) as tag from pages")
def hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.url_tag(F.col("url")).alias("tag"))


@query("eyebrow_budget", "select conv_id, count(*) as sections, ceil(count(*) / 3.0)::bigint as allowed from conversations group by conv_id")
def eyebrow_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators import design

    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("sections")).withColumn("allowed", design.eyebrow_budget(F.col("sections")))


@query("text_samples", "select doc_id, substr(text, 1, 60) as sample, lower(regexp_extract(text, '([A-Za-z0-9-]+)', 1)) as label from documents")
def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.sample(F.col("text")).alias("sample"), F.lower(F.regexp_extract("text", "([A-Za-z0-9-]+)", 1)).alias("label"))


@query("first_attribute", """select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title, nullif(trim(regexp_extract(html, '(?is)<html[^>]+lang="([^"]*)"', 1)), '') as lang, nullif(trim(regexp_extract(html, '(?is)<meta[^>]+charset="([^"]*)"', 1)), '') as charset from pages""")
def first_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    found = {"title": text.first_match(h, r"(?is)<title[^>]*>(.*?)</title>"), "lang": text.first_match(h, r'(?is)<html[^>]+lang="([^"]*)"'), "charset": text.first_match(h, r'(?is)<meta[^>]+charset="([^"]*)"')}
    return table(spark, sf_dir, "pages").select("page_id", *[F.nullif(c, F.lit("")).alias(n) for n, c in found.items()])


@query("hostname_shape", "select page_id, regexp_full_match(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '[a-z0-9-]+(\\.[a-z0-9-]+)+') as plain_host from pages")
def hostname_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_like(urls.part(F.col("url"), "authority"), F.lit(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")).alias("plain_host"))
