"""Queries over sites that the driver's pages are made into: rewriting, asset discovery, crawls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import markup, urls
from weftline.operators import assets, crawl, ordering
from weftline.queries.pages import KEY_SQL, LINKS_SQL, PATH_SQL, SITE, TARGET_SQL, slug_sql
from weftline.queries.registry import query
from weftline.session import cut, table


@query(
    "rewritten_pages",
    f"""with {LINKS_SQL}, t as (select distinct page_id, 'href="' || href as a, 'href="' || {slug_sql(TARGET_SQL)} as p from links),
 o as (select page_id, list(a || chr(1) || p order by length(a) desc, a) as o from (select page_id, a, p from t union select page_id, replace(a, '&', '&amp;'), p from t) group by page_id),
 r as (select page_id, case when o is null then html else list_reduce(list_concat([html], o), lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) end as h from pages left join o using (page_id))
 select page_id, length(h) as n_chars, md5(h) as digest from r""",
)
def rewritten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its anchors pointing at the files of their targets; many of the references begin others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = crawl.links(pages, "page_id", site=SITE)
    own = links.select("src_url", F.concat(F.lit('href="'), "href").alias("asset_url"), F.concat(F.lit('href="'), urls.slug(F.col("target_url"))).alias("place")).distinct()
    done = assets.rewrite(pages, own, "page_id")
    return done.select("page_id", F.length("html").alias("n_chars"), F.md5("html").alias("digest"))


WORDS_SQL = """w as (select page_id, list_transform(list_concat(regexp_extract_all(html, '<a\\b[^>]*?href="([^"#][^"]*)"', 1), ['', '', '', '', '', '']), lambda x: substr(md5(x), 1, 8)) as w from pages)"""


def _words(pages: DataFrame, k: int):
    """Eight digits of the k-th anchor's target."""
    return F.substring(F.md5(F.coalesce(F.get(markup.hrefs(F.col("html")), F.lit(k)), F.lit(""))), 1, 8).alias(f"w{k}")


@query(
    "asset_closure",
    f"""with recursive {WORDS_SQL}, c as (select page_id, w, 'https://site.example/css/' || page_id || '.css?v=1' as src, 'https://site.example/css/' || (page_id * 7 + 3) % (select count(*) from pages) || '.css?v=1' as dst from w),
 e as (select src, dst from c union select src, 'https://site.example/img/' || w[3] || page_id || '-chunk-1.json' from c union select src, 'https://site.example/img/' || w[3] || page_id || '-indexes-1.json' from c),
 s as (select 'https://site.example/css/' || page_id // 40 * 40 || '.css?v=1' as url from w union select 'https://site.example/p/$' || '{{t}}.js' from w union select 'https://far.example/' || w[2] || '.png' from w
  union select 'https://site.example/' || w[4] || '.webp' from w union select 'https://site.example/p/x/' || w[5] || '.webp?w=2' from w
  union select case when page_id % 4 = 0 then 'https://cdn.example/x/' else 'https://site.example/p/lib/x/' end || w[1] || '.js' from w
  union select case when page_id % 4 = 0 then 'https://cdn.example/l/' else 'https://site.example/p/lib/' end || w[2] || '.mjs' from w union select case when page_id % 4 = 0 then '../own.js' else null end from w),
 r(url, round) as (select url, 0 from s where url is not null union select dst, round + 1 from r join e on src = url where round < 6)
 select url, min(round) as round from r group by url""",
)
def asset_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets that pages and style sheets name, made of the pages' own anchors and numbers: absolute, from the root, with dots, through import maps, in lists of candidates, and as halves of collections. Round 6 is what six rounds leave."""
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    words = pages.select("page_id", F.concat(F.lit(SITE + "/p/"), "page_id").alias("url"), *[_words(None, k) for k in range(6)])
    base = cut(words.withColumns({"sheet": (F.floor(F.col("page_id") / 40) * 40).cast("string"), "next": ((F.col("page_id") * 7 + 3) % n).cast("string")}))
    c = lambda *parts: F.concat(*[F.col(p) if p in base.columns else F.lit(p) for p in parts])
    maps = F.when(F.col("page_id") % 4 == 0, F.lit('<script type="importmap">{"imports": {"lib/": "https://cdn.example/l/", "lib/x/": "https://cdn.example/x/", "own": "../own.js"}}</script><script>import o from "own"</script>')).otherwise("")
    html = F.concat(
        maps,
        c('<link rel="s" href="../css/./', "sheet", '.css?v=1">', "<script>import a from 'lib/x/", "w0", ".js'; import(`lib/", "w1", ".mjs`); import(`./${i.value}.js`); import(`./${t}.js`)</script>"),
        c('<a href="mailto:x@y.css">', "https://far.example/", "w1", ".png)", '<img srcset="/', "w3", ".webp 1x, x/./", "w4", '.webp?w=2 2x" src="data:a.png">', "<p style='background: url(  #x.svg )'>"),
    )
    body = c('@import url("../css/', "next", '.css?v=1"); a{background:url(/a/../img/', "w2", "page_id", "-chunk-1.json)}")
    files = base.select(c(SITE + "/css/", "page_id", ".css?v=1").alias("url"), body.alias("text"))
    fetched = files.select("url", F.lit(200).alias("status"), F.lit("text/css").alias("content_type"), F.lit(None).cast("string").alias("error"), F.encode("text", "UTF-8").alias("body"))
    found, left = assets.fixpoint(base.select("url", html.alias("html")), cut(fetched))
    return found.unionByName(left.withColumn("round", F.lit(assets.ROUNDS)))


CRAWL_DEPTH = 4


def _crawl_sql(depth: int) -> str:
    """Levels of the queue, one statement each."""
    policy = f"case when regexp_matches({PATH_SQL.format('key')}, '^/(the|of)') then 'bulk-section' else 'follow' end"
    levels = ["l0 as (select key, 0 as depth, 1::bigint as seq from k where page_id = (select min(page_id) from k) and ord = 0)"]
    for d in range(1, depth + 1):
        known = " union all ".join(f"select key, seq from l{i}" for i in range(d))
        mapped = "union all select key, 0, ord from m" if d == 1 else ""
        levels.append(
            f"""l{d} as materialized (select key, {d} as depth, (select count(*) from ({known})) + row_number() over (order by q) as seq from (select key, min({{'f': f, 'o': o}}) as q from (
  select e.dst as key, l.seq as f, e.ord as o from e join l{d - 1} l on l.key = e.src where l.seq <= (select n from cap) {mapped}) group by key)
  where key in (select key from a where reason = 'follow') and key not in (select key from ({known})))"""
        )
    every = " union all ".join(f"select key, depth, seq from l{i}" for i in range(depth + 1))
    return f"""with {LINKS_SQL}, k as (select page_id, ord, {KEY_SQL} as key from links),
 e as (select f.key as src, k.page_id * 1048576 + k.ord as ord, k.key as dst from k join (select page_id, key from k where ord = 0) f using (page_id)),
 m as (select key, row_number() over (order by key) as ord from (select distinct key from k) where substr(md5(key), 1, 1) = '0'), a as (select key, {policy} as reason from (select distinct key from k)),
 cap as (select count(*) // 5 as n from pages), {', '.join(levels)}, q as ({every})
 select key, depth, seq, null as reason from q where seq <= (select n from cap) union all select key, null, null, 'max-pages cap' from q where seq > (select n from cap) union all select key, null, null, reason from a where reason <> 'follow'"""


@query("crawl_queue", _crawl_sql(CRAWL_DEPTH))
def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the site in which each first anchor of a page is a page with its anchors: the queue's order, the cap (a fifth as many as there are pages), what the policy refuses. One key in 16 stands in the sitemap."""
    pages = table(spark, sf_dir, "pages")
    links = cut(crawl.links(pages, "page_id", site=SITE).select(F.col("src_url").alias("page_id"), "ord", "key"))
    first = links.where("ord = 0").select("page_id", F.col("key").alias("src"))
    edges = links.join(first, "page_id").select("src", (F.col("page_id") * (1 << 20) + F.col("ord")).alias("ord"), F.col("key").alias("dst"))
    keys = links.select("key").distinct()
    sitemap = ordering.numbered(keys.where(F.substring(F.md5("key"), 1, 1) == "0"), ["key"], "ord")
    allowed = keys.select("key", urls.follow_policy(F.col("key"), F.lit(SITE), exclude="^/(the|of)").alias("reason"))
    start = first.orderBy("page_id").first()
    done, skipped = crawl.crawl(edges, start.src if start else SITE, sitemap, allowed, pages.count() // 5, CRAWL_DEPTH)
    return done.select("key", "depth", "seq", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("key", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("seq"), "reason"))


@query(
    "style_rules",
    """with p as (select page_id, page_id::varchar as n from pages), r as (
 select page_id, 0 as sheet, 1 as ord, 'style' as type, 'p' as selector, null as condition, '' as media, 'margin=0' as said, 'p{margin:0}' as css_text from p
 union all select page_id, 1, 1, 'media', null, '(min-width: ' || n || 'px)', '', '', null from p union all select page_id, 1, 2, 'style', 'a:hover, b', null, '(min-width: ' || n || 'px)', 'color=#0' || n || ';background=url(a;b}.png)', null from p
 union all select page_id, 1, 3, 'supports', null, '(x: y)', '(min-width: ' || n || 'px)', '', null from p union all select page_id, 1, 4, 'style', '.c' || n, null, '(min-width: ' || n || 'px) and (x: y)', 'content="}";--w=' || n || 'px', '.c' || n || '{content:"}";--w:' || n || 'px}' from p
 union all select page_id, 1, 5, 'keyframes', 'k' || n, null, '', '', '@keyframes k' || n || '{from{top:0}to{top:' || n || 'px}}' from p union all select page_id, 1, 6, 'style', ':root', null, '', '--gap=' || n || 'px', null from p)
 select page_id, sheet, ord, type, selector, condition, media, said, case when sheet = 0 or ord in (4, 5) then css_text end as css_text from r""",
)
def style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of each page's own style block, and of one with nested rules that is made for it."""
    from weftline.operators import capture

    n = F.col("page_id").cast("string")
    made = F.concat(
        F.lit("/* a{b:c} */ @import url(x;y.css);\n@media  (min-width: "), n, F.lit("px) {\n a:hover, b { color : #0"), n, F.lit("; background: url(a;b}.png) }\n @supports (x: y) { .c"), n, F.lit('{content:"}";--w:'), n,
        F.lit("px} } }\n@keyframes k"), n, F.lit("{from{top:0}to{top:"), n, F.lit("px}} :root { --gap: "), n, F.lit("px }"),
    )
    sheets = F.array_append(markup.styles(F.col("html")), made)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("page_id"), F.posexplode(sheets).alias("sheet", "css"))
    rules = capture.css_rules(pages.select("page", "sheet", "css"))
    said = F.array_join(F.transform("declarations", lambda d: F.concat(d["property"], F.lit("="), d["value"])), ";")
    whole = F.when((F.col("sheet") == 0) | F.col("ord").isin(4, 5), F.col("css_text"))
    return rules.select(F.col("page").alias("page_id"), "sheet", "ord", "type", "selector", "condition", F.array_join("media", " and ").alias("media"), said.alias("said"), whole.alias("css_text"))


@query(
    "robots_verdicts",
    rf"""with p as (select page_id, url, regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) as o, {PATH_SQL.format('url')} || case when regexp_extract(url, '^[^?#]*\?([^#]*)', 1) <> '' then '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) else '' end as t from pages),
 r as (select distinct o, '/' || split_part(t, '/', 2) || '/' as b, (page_id % 10)::varchar as d, page_id % 4 as k, t from p where page_id % 4 < 3)
 select p.page_id, bool_or(coalesce(case r.k when 0 then starts_with(p.t, r.b) and contains(substr(p.t, length(r.b) + 1), r.d) when 1 then starts_with(p.t, r.t) else starts_with(p.t, '/z') or contains(p.t, r.d || r.d || 'f') end, false)) as robots from p left join r using (o) group by p.page_id""",
)
def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against rules that are made of their own paths: a section with a star and a digit, a whole path, a beginning that no page has, a star in front."""
    from weftline.sources import web

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    u, k, digit = F.col("url"), F.col("page_id") % 4, (F.col("page_id") % 10).cast("string")
    tail = F.concat(urls.part(u, "path"), F.when(urls.part(u, "query") != "", F.concat(F.lit("?"), urls.part(u, "query"))).otherwise(""))
    section = F.concat(F.lit("/"), F.element_at(F.split(tail, "/"), 2), F.lit("/*"), digit)
    made = F.when(k == 0, F.array(section)).when(k == 1, F.array(tail)).otherwise(F.array(F.lit("/z"), F.concat(F.lit("*"), digit, digit, F.lit("f"))))
    rules = pages.where(k < 3).select(urls.origin(u).alias("origin"), F.explode(made).alias("rule"))
    return web.robots_blocked(pages, rules).select("page_id", "robots")


LINE_RULES = [
    ("mit license", "WARN"), ("(?i)Apache +License", "WARN"), ("idiot", "FAIL"), ("[$]{3} ", "WARN"), ("and the [a-z]+er", "WARN"), ("(?i)(?:heit|keit) und", "WARN"), ("que la(?: ou)? de", "WARN"), ("[.]$", "WARN"), ("^(The|Der|La) ", "WARN"),
    ("[A-Z]{6}!!", "FAIL"), ("of of", "FAIL"), ("(?:th)+ing on", "WARN"), ("x{0,1}tion,", "WARN"), ("http://", "WARN"),
]


@query(
    "line_rule_hits",
    "with r(pattern, tier) as (values " + ", ".join(f"('{p}', '{t}')" for p, t in LINE_RULES) + """), l as (select doc_id, unnest(range(1, len(l) + 1)) as line, l from (select doc_id, string_split(text, chr(10)) as l from documents))
 select pattern, tier, count(*) as hits, count(distinct doc_id) as docs, sum(doc_id * line)::bigint as places from l, r where regexp_matches(l[line], pattern) group by pattern, tier""",
)
def line_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents against a set of rules."""
    from weftline.operators import design

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "body"))
    hits = design.line_hits(lines, spark.createDataFrame(LINE_RULES, "pattern string, tier string"))
    return hits.groupBy("pattern", "tier").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"), F.sum(F.col("doc_id") * (F.col("at") + 1)).alias("places"))


PAGE_PATHS = [
    ("<html", "html"), ("<head", "html > head"), ("<meta", "html > head > meta"), ("<title", "html > head > title"), ("<style", "html > head > style"), ("<script", "html > head > script"), ("<body", "html > body"), ("<nav", "html > body > nav"),
    ("<ul", "html > body > nav > ul"), ("<li", "html > body > nav > ul > li"), ("<a ", "html > body > nav > ul > li > a"), ("<div", "html > body > div"), ("<article", "html > body > article"), ("<h1", "html > body > article > h1"), ("<p>", "html > body > article > p"),
    ("<b>", "html > body > article > p > b"), ("<br>", "html > body > article > p > b > br"), ("<footer", "html > body > footer"),
]


@query(
    "page_templates",
    "with t(tag, path) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in PAGE_PATHS) + """), p as (select page_id, path from pages, t where contains(html, tag)), n as (select count(*) as n from pages), c as (select path, count(*) as k from p group by path)
 select (select n from n) as instances, string_agg(path, '|' order by path) filter (k = (select n from n)) as fixed, coalesce(string_agg(path, '|' order by path) filter (k < (select n from n)), '') as varying from c""",
)
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of all pages by the paths of their tags: how many pages each has, and which paths all or only some of them have."""
    from weftline.operators import capture

    out = capture.templates(capture.by_structure(table(spark, sf_dir, "pages"), "page_id"))
    return out.select("instances", F.array_join("fixed", "|").alias("fixed"), F.array_join("varying", "|").alias("varying"))


RASTER_SQL = "list_transform(embedding, lambda x: least(255, greatest(0, floor(128 + 400 * x::double)))::int)"
BANDS = {"first": (0, 16), "second": (16, 40), "third": (40, 64)}


@query(
    "band_similarity",
    f"""with v as (select vec_id, {RASTER_SQL} as r from embeddings), b(band, lo, hi) as (values ('first', 0, 16), ('second', 16, 40), ('third', 40, 64)),
 d as (select a.vec_id, band, list_transform(list_zip(a.r[lo + 1:hi], c.r[lo + 1:hi], s.r[lo + 1:hi]), lambda z: [abs(z[1] - z[2]), abs(z[1] - z[3])]) as d from v a join v c on c.vec_id = a.vec_id + 1 join v s on s.vec_id = a.vec_id + 2, b),
 m as (select vec_id, band, 100 - list_sum(list_transform(d, lambda x: x[1])) / len(d) / 255 * 100 as cross_pct, 100 - list_sum(list_transform(d, lambda x: x[2])) / len(d) / 255 * 100 as self_pct, len(list_filter(d, lambda x: x[1] <= 16)) / len(d) * 100 as w, list_max(list_transform(d, lambda x: x[1])) as x from d)
 select vec_id, band, round(cross_pct, 6) as similarity_pct, round(w, 6) as within16_pct, x as max_delta, abs(cross_pct - self_pct) <= 0.5 as phase from m""",
)
def band_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rasters of 64 samples, each compared band by band with the next one, and whether it differs as much from the one behind that."""
    from weftline.operators import report

    raster = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * x.cast("double")).cast("int"))))
    v = table(spark, sf_dir, "embeddings").select("vec_id", raster.alias("r"))
    at = lambda n, name: v.select((F.col("vec_id") - n).alias("vec_id"), F.col("r").alias(name))
    trio = v.join(at(1, "next"), "vec_id").join(at(2, "later"), "vec_id")
    cross = report.band_scores(trio.select("vec_id", "r", "next", "later"), "r", "next", BANDS).drop("next").withColumnRenamed("similarity_pct", "cross_pct").withColumnsRenamed({"within16_pct": "w", "max_delta": "m"})
    again = report.band_scores(trio.select("vec_id", "r", "later"), "r", "later", BANDS).select("vec_id", "band", F.col("similarity_pct").alias("self_pct"))
    both = cross.join(again, ["vec_id", "band"])
    phase = report.phase_residual(both.select(F.struct("vec_id", "band").alias("band"), "cross_pct", "self_pct"), 0.5).select("band.*", "phase")
    return both.join(phase, ["vec_id", "band"]).select("vec_id", "band", F.round("cross_pct", 6).alias("similarity_pct"), F.round("w", 6).alias("within16_pct"), F.col("m").alias("max_delta"), "phase")


@query("written_pages", "select page_id || '.html' as slug, md5(html) as digest, length(html) as n_chars from pages")
def written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as files by partitions, which appear together, and read back."""
    from weftline.plans.page_files import PageFiles
    from weftline.session import kept, shared_dir
    from weftline.sources import web

    spark.dataSource.register(PageFiles)
    path = kept(spark, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}")
    table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("slug"), "html").write.format("page_files").mode("append").save(path)
    files = web.whole_files(spark, path, "*.html").select(F.regexp_extract("file", r"([^/]+)$", 1).alias("slug"), "text")
    return files.select("slug", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))
