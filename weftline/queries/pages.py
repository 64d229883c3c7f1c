"""Queries over captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import markup, text, urls
from weftline.operators import crawl, matching, tallies
from weftline.queries.registry import query
from weftline.session import table

SITE = "https://site.example"
AUTH_SQL = "(?i)/(login|signin|sign-in|signup|sign-up|register|account|dashboard|settings|billing|checkout|logout|auth|oauth|admin)([^0-9A-Za-z_]|$)"
BULK_SQL = "(?i)^/(community|dictionary|help|docs|developers|marketplace|blog|news|tag|tags|category|categories|author|authors|glossary|forum|support|kb)(/|$)"
BINARY_SQL = r"(?i)\.(zip|dmg|exe|pkg|pdf|mp4|webm|mov|woff2?|ttf|otf|png|jpe?g|gif|svg|webp|avif|ico|mjs|js|css|json|xml)$"

SEEN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<!--.*?-->', ' ', 'gs'), '<script[^>]*>.*?</script>', ' ', 'gsi'), '<style[^>]*>.*?</style>', ' ', 'gsi'), '<svg[^>]*>.*?</svg>', ' ', 'gsi'),
  '<noscript[^>]*>.*?</noscript>', ' ', 'gsi'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""
WORDS_SQL = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"
PATH_SQL = "regexp_extract({0}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)', 3)"
SLUG_SQL = """case when regexp_replace({p}, '^/+|/+$', '', 'g') = '' then 'index.html' else
  (case when {n} = '' then 'page' else {n} end) || '.html' end"""


def slug_sql(url: str) -> str:
    p = PATH_SQL.format(url)
    n = f"substr(regexp_replace(regexp_replace(replace(regexp_replace({p}, '^/+|/+$', '', 'g'), '/', '__'), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120)"
    return SLUG_SQL.format(p=p, n=n)


LINKS_SQL = r"""links as (select page_id, url as src_url, (i - 1)::int as ord, replace(h[i], '&amp;', '&') as href from (
  select page_id, url, h, unnest(range(1, len(h) + 1)) as i from (select page_id, url, regexp_extract_all(html, '<a\b[^>]*?href="([^"#][^"]*)"', 1) as h from pages)))"""
TARGET_SQL = "split_part('https://site.example' || href, '#', 1)"
KEY_SQL = f"regexp_replace({TARGET_SQL}, '/+$', '')"


@query(
    "page_copy_audit",
    f"""with a as (select page_id, html, {SEEN_SQL} as seen from pages),
 b as (select page_id, coalesce(length(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), 0) as title_len,
  regexp_matches(html, '(?is)<meta[^>]+name=["'']description["''][^>]+content=["''](.*?)["'']') as has_description,
  len(regexp_extract_all(html, '(?i)<h1[\\s>]')) as h1_count, regexp_matches(html, '(?i)<html[^>]+lang=') as has_lang,
  regexp_matches(html, '(?i)<link[^>]+rel=["'']canonical["'']') as has_canonical, regexp_matches(html, '(?is)<script[^>]+application/ld\\+json[^>]*>(.*?)</script>') as has_json_ld,
  regexp_matches(html, '(?i)property=["'']og:title["'']')::int + regexp_matches(html, '(?i)property=["'']og:description["'']')::int + regexp_matches(html, '(?i)property=["'']og:image["'']')::int as og_count,
  len(list_filter(regexp_extract_all(html, '(?i)<img\\b[^>]*>'), lambda i: not regexp_matches(i, '(?i)\\balt='))) as no_alt,
  {WORDS_SQL.format('seen')} as word_count, len(regexp_extract_all(seen, '[0-9][0-9,.:]*')) as numeric_tokens, length(seen) - length(replace(seen, '—', '')) as em_dashes from a)
 select *, (title_len = 0)::int + (not has_description)::int + (h1_count <> 1)::int + (not has_lang)::int + (no_alt > 0)::int + (not has_json_ld)::int + (em_dashes > greatest(2.0, greatest(word_count, 1) / 150.0))::int as fail_count,
  (title_len > 0 and title_len not between 15 and 65)::int + (not has_canonical)::int + (og_count < 3)::int + (numeric_tokens / greatest(word_count, 1) < 0.01)::int as warn_count from b""",
)
def page_copy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    html = F.col("html")
    # the count of figures keeps to ASCII so that both engines agree next to accented letters
    own = markup.audit(html) | {"numeric_tokens": F.regexp_count(text.visible_text(html, decode=False), F.lit("[0-9][0-9,.:]*"))}
    b = pages.select("page_id", *[c.alias(n) for n, c in own.items()])
    fails = [F.col("title_len") == 0, ~F.col("has_description"), F.col("h1_count") != 1, ~F.col("has_lang"), F.col("no_alt") > 0, ~F.col("has_json_ld"), F.col("em_dashes") > F.greatest(F.lit(2.0), F.greatest("word_count", F.lit(1)) / 150)]
    warns = [(F.col("title_len") > 0) & ~F.col("title_len").between(15, 65), ~F.col("has_canonical"), F.col("og_count") < 3, F.col("numeric_tokens") / F.greatest("word_count", F.lit(1)) < 0.01]
    return b.withColumns({"fail_count": sum((x.cast("int") for x in fails), F.lit(0)), "warn_count": sum((x.cast("int") for x in warns), F.lit(0))})


@query("visible_text_stats", f"select page_id, length(seen) as n_chars, {WORDS_SQL.format('seen')} as n_words, md5(seen) as digest from (select page_id, {SEEN_SQL} as seen from pages)")
def visible_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html"), decode=False).alias("seen"))
    return seen.select("page_id", F.length("seen").alias("n_chars"), F.size(text.space_words(F.col("seen"))).alias("n_words"), F.md5("seen").alias("digest"))


@query("page_links", f"with {LINKS_SQL} select src_url, ord, href, {TARGET_SQL} as target_url, {KEY_SQL} as key from links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.links(table(spark, sf_dir, "pages"), site=SITE)


@query("page_slugs", f"select page_id, url, {slug_sql('url')} as slug from pages")
def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.slug(F.col("url")).alias("slug"))


@query("slug_collisions", f"select slug, count(distinct url) as n, string_agg(distinct url, ' ' order by url) as owners from (select url, {slug_sql('url')} as slug from pages) group by slug having count(distinct url) > 1")
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("url", urls.slug(F.col("url")).alias("slug"))
    return matching.collisions(rows, "slug", "url").select("slug", "n", F.array_join("owners", " ").alias("owners"))


@query(
    "url_parts",
    r"""select page_id, regexp_extract(url, '^(?:([^:/?#]+):)?', 1) as scheme, regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1) as authority,
 regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query, regexp_replace(split_part(url, '#', 1), '/+$', '') as key from pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", *[urls.part(u, n).alias(n) for n in ("scheme", "authority", "path", "query")], urls.key(u).alias("key"))


@query("path_segment_histogram", f"select split_part(regexp_replace({PATH_SQL.format('url')}, '^/+', ''), '/', 1) as segment, count(*) as n from pages group by 1")
def path_segment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(urls.first_segment(F.col("url")).alias("segment")).agg(F.count("*").alias("n"))


@query("segment_exemplars", f"select segment, min_by(url, page_id) as url, count(*) as n from (select page_id, url, split_part(regexp_replace({PATH_SQL.format('url')}, '^/+', ''), '/', 1) as segment from pages) group by segment")
def segment_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of each section of a sitemap, and how many there are."""
    rows = table(spark, sf_dir, "pages").withColumn("segment", urls.first_segment(F.col("url")))
    return rows.groupBy("segment").agg(F.min_by("url", "page_id").alias("url"), F.count("*").alias("n"))


POLICY_SQL = f"""case when lower(regexp_extract(u, '^([^:/?#]+):', 1)) not in ('http', 'https') then 'scheme'
  when regexp_extract(u, '^[^:/?#]+://[^/?#]*', 0) <> site then 'offsite'
  when regexp_matches({PATH_SQL.format('u')}, '{BINARY_SQL}') then 'binary' when regexp_matches({PATH_SQL.format('u')}, '{AUTH_SQL}') then 'auth-gated'
  when not regexp_matches({PATH_SQL.format('u')}, '^/th') and (regexp_matches({PATH_SQL.format('u')}, '{BULK_SQL}') or regexp_matches({PATH_SQL.format('u')}, '^/(the|of)')) then 'bulk-section' else 'follow' end"""


@query("follow_policy_reasons", f"with {LINKS_SQL} select reason, count(*) as n from (select {POLICY_SQL} as reason from (select {TARGET_SQL} as u, 'https://site.example' as site from links union all select url, 'https://site.example' from pages union all select 'https://site.example/' || (case page_id % 5 when 0 then 'login/x' when 1 then 'blog' when 2 then 'a.pdf' when 3 then 'account' else 'docs/guide' end), 'https://site.example' from pages)) group by reason")
def follow_policy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    made = F.element_at(F.array(*[F.lit(x) for x in ("login/x", "blog", "a.pdf", "account", "docs/guide")]), (F.col("page_id") % 5 + 1).cast("int"))
    targets = crawl.links(pages, site=SITE).select(F.col("target_url").alias("u")).unionAll(pages.select("url")).unionAll(pages.select(F.concat(F.lit(SITE + "/"), made)))
    reason = urls.follow_policy(F.col("u"), F.lit(SITE), include="^/th", exclude="^/(the|of)")
    return tallies.reason_histogram(targets.select(reason.alias("reason")))


MAP_SQL = f"urlmap as (select distinct key, {slug_sql('key')} as slug from (select {KEY_SQL} as key from links) where substr(md5(key), 1, 1) < '8')"


def _urlmap(link_rows: DataFrame) -> DataFrame:
    """A page for half of the targets, as links of the driver's pages lead to none of its pages."""
    return link_rows.where(F.substring(F.md5("key"), 1, 1) < "8").select("key", urls.slug(F.col("key")).alias("slug")).distinct()


@query("link_wiring", f"with {LINKS_SQL}, {MAP_SQL} select src_url, ord, href, coalesce(slug, '#inert') as place from (select *, {KEY_SQL} as key from links) left join urlmap using (key)")
def link_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.links(table(spark, sf_dir, "pages"), site=SITE)
    return crawl.wired(rows, _urlmap(rows))


@query("missing_targets", f"with {LINKS_SQL}, {MAP_SQL} select distinct slug from urlmap where substr(md5(slug), 1, 1) >= '4'")
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.links(table(spark, sf_dir, "pages"), site=SITE)
    pages = _urlmap(rows)
    return crawl.missing_targets(crawl.wired(rows, pages), pages.where(F.substring(F.md5("slug"), 1, 1) < "4"))


@query("link_change_counts", f"with {LINKS_SQL}, {MAP_SQL} select src_url, count(*) filter (slug is not null) as wired, count(*) filter (slug is null) as inert from (select *, {KEY_SQL} as key from links) left join urlmap using (key) group by src_url")
def link_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.links(table(spark, sf_dir, "pages"), site=SITE)
    placed = crawl.wired(rows, _urlmap(rows))
    return placed.groupBy("src_url").agg(F.count_if(F.col("place") != "#inert").alias("wired"), F.count_if(F.col("place") == "#inert").alias("inert"))


@query(
    "crawl_reachability",
    """with recursive n as (select count(*) as n from pages), edges as (select page_id as src, (7 * page_id + k) % (select n from n) as dst from pages, (values (1), (2)) as t(k)),
 hop(node, depth) as (select 0::bigint, 0 union select dst, depth + 1 from hop join edges on src = node where depth < 6) select node, min(depth) as depth from hop group by node""",
)
def crawl_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reached within 6 steps over a fixed link rule between page numbers, as the driver's anchors lead to no other page."""
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    edges = pages.select(F.col("page_id").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("src", ((7 * F.col("src") + F.col("k")) % n).alias("dst"))
    return crawl.reach(edges, spark.createDataFrame([(0,)], "node bigint"), 6)


@query(
    "coverage_diff",
    f"""with {LINKS_SQL}, s as (select distinct {KEY_SQL} as k from links where page_id % 3 <> 0), r as (select distinct {KEY_SQL} as k from links where page_id % 3 <> 1)
 select k as url, 'sitemap_only' as side from s where k not in (select k from r) union all select k, 'crawl_only' from r where k not in (select k from s)""",
)
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.links(table(spark, sf_dir, "pages"), site=SITE, keep=["page_id"])  # pages may share a URL
    part = lambda cond: rows.where(cond).select(F.col("key").alias("url")).distinct()
    return crawl.coverage(part("page_id % 3 <> 0"), part("page_id % 3 <> 1"))


NAME_SQL = """with u as (select distinct url || (case page_id % 3 when 0 then '/logo.png' when 1 then '/app.js?v=' || page_id else '/fonts/' || (page_id % 7) || '.woff2' end) as url from (select page_id, regexp_extract(url, '^[^?#]*', 0) as url from pages)),
 b as (select url, regexp_extract(url, '([^/?#]+)(\\?[^#]*)?$', 1) as base, strpos(url, '?') > 0 as q from u), c as (select *, row_number() over (partition by base order by url) as rn from b)
 select url, case when q or rn > 1 then regexp_extract(base, '^(.+)\\.[^.]*$', 1) || '__' || substr(sha1(url), 1, 8) || regexp_extract(base, '(\\.[^.]*)$', 1) else base end as name from c"""


@query("claimed_names", NAME_SQL)
def claimed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators import assets

    base = F.regexp_extract("url", "^[^?#]*", 0)
    tail = F.when(F.col("page_id") % 3 == 0, "/logo.png").when(F.col("page_id") % 3 == 1, F.concat(F.lit("/app.js?v="), "page_id")).otherwise(F.concat(F.lit("/fonts/"), F.col("page_id") % 7, F.lit(".woff2")))
    found = table(spark, sf_dir, "pages").select(F.concat(base, tail).alias("url"), F.lit(0).alias("round"))
    return assets.claimed(found).select("url", "name")


@query("origin_sweep", f"with s as (select page_id, url, html, regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) as origin from pages), {LINKS_SQL} select s.page_id, (length(html) - length(replace(html, origin, ''))) // length(origin) as origin_refs, (select count(*) from links l where l.page_id = s.page_id and not starts_with('https://site.example' || l.href, s.origin)) as off_origin from s")
def origin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to its own origin left in each page, and links that lead elsewhere."""
    pages = table(spark, sf_dir, "pages").withColumn("origin", urls.origin(F.col("url")))
    refs = F.floor((F.length("html") - F.length(F.replace("html", F.col("origin"), F.lit("")))) / F.length("origin")).cast("long")
    off = F.size(F.filter(markup.hrefs(F.col("html")), lambda h: ~F.startswith(F.concat(F.lit(SITE), F.replace(h, F.lit("&amp;"), F.lit("&"))), F.col("origin"))))
    return pages.select("page_id", refs.alias("origin_refs"), off.cast("long").alias("off_origin"))


@query(
    "range_responses",
    """select page_id as request_id, case when page_id % 4 = 3 then 404 else 200 end as status, case page_id % 4 when 0 then 'text/css' when 3 then null else 'text/plain' end as content_type,
 length(body)::int as content_length, case when page_id % 4 < 2 then 'no-store' end as cache_control, body from (select page_id, case page_id % 4 when 0 then substr(url, 1, 4) when 1 then substr(url, 1, 5) || substr(url, 3, 8) when 2 then url end as body from pages)""",
)
def range_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as files of a copied site: slices in the order asked for, an asset found by its base name, a malformed range, a missing file."""
    from weftline.plans import serving

    pages, n = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    files = pages.select(F.concat(F.when(n == 0, F.lit("/cdn/a")).otherwise("/p/"), "page_id", F.when(n == 0, ".css").otherwise(".txt")).alias("path"), F.encode("url", "UTF-8").alias("body")).where(n != 3)
    target = F.when(n == 0, F.concat(F.lit("/made/by/script/a"), "page_id", F.lit(".css?v=2&range=0-3"))).when(n == 1, F.concat(F.lit("/p/"), "page_id", F.lit(".txt?range=0-4%2C2-9"))).when(n == 2, F.concat(F.lit("/p/"), "page_id", F.lit(".txt?range=9-1"))).otherwise(F.concat(F.lit("/p/"), "page_id", F.lit(".txt")))
    out = serving.responses(pages.select(F.col("page_id").alias("request_id"), target.alias("target")), files)
    return out.withColumn("body", F.decode("body", "UTF-8"))


@query(
    "selector_paths",
    """select 'c' || c_custkey as node, case when n_nationkey % 5 = 0 then 'ul#n' || n_nationkey || ' > ' else 'body > div > ul > ' end || 'li.card.big' || case when c_custkey % 2 = 0 then ':nth-of-type(' || c_custkey || ')' else '' end as path from customer join nation on c_nationkey = n_nationkey""",
)
def selector_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as nested elements of one page, and the paths to the innermost."""
    from weftline.operators import capture

    schema = ["page", "node", "parent", "tag", "id", "classes", "nth", "alike"]
    none = F.array().cast("array<string>")
    make = lambda d, *c: d.select(F.lit("w").alias("page"), *[x.alias(n) for x, n in zip(c, schema[1:], strict=True)])
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = F.lit(1).cast("long")
    top = make(spark.range(1), F.lit("top"), F.lit(None).cast("string"), F.lit("BODY"), F.lit(""), none, one, one)
    regions = make(table(spark, sf_dir, "region"), key("r", "r_regionkey"), F.lit("top"), F.lit("DIV"), F.lit(None).cast("string"), none, one, one)
    nations = make(table(spark, sf_dir, "nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit("UL"), F.when(F.col("n_nationkey") % 5 == 0, key("n", "n_nationkey")), F.array(F.lit("has-list")), one, one)
    classes = F.array(*[F.lit(c) for c in ("is-x", "card", "active-tab", "big", "huge")])
    items = make(table(spark, sf_dir, "customer"), key("c", "c_custkey"), key("n", "c_nationkey"), F.lit("LI"), F.lit(""), classes, F.col("c_custkey").cast("long"), F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(1).cast("long"))
    return capture.selector_paths(top.unionByName(regions).unionByName(nations).unionByName(items)).where(F.col("node").startswith("c")).select("node", "path")


TRACED = ["apache license", "license", "mit license", "que", "und", "the", "der", "http"]


@query(
    "corpus_names_traced",
    f"""with l as (select doc_id, l, unnest(range(1, len(l) + 1)) as line, l[line] as body from (select doc_id, string_split(lower(text), chr(10)) as l from documents)),
 h as (select doc_id, line, name, length(regexp_extract(body, '^((?s:.*?[^a-z0-9])??)' || name || '(?:[^a-z0-9]|$)', 1)) as place from l, (values {', '.join(f"('{n}')" for n in TRACED)}) as n(name) where regexp_matches(body, '(?:^|[^a-z0-9])' || name || '(?:[^a-z0-9]|$)'))
 select doc_id::varchar as rel, line, arg_min(name, (place, -length(name))) as name from h group by doc_id, line""",
)
def corpus_names_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of some names on each line of all documents."""
    from weftline.operators import bundle

    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel"), "text")
    return bundle.corpus_traces(files, spark.createDataFrame([(n,) for n in TRACED], "name string"))
