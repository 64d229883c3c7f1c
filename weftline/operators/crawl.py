"""Crawling over pages that have been collected: links, reach, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import markup, urls
from weftline.operators.ordering import numbered
from weftline.session import cut

#: Content type of pages, and states that ask for a login.
HTML_TYPE, AUTH_STATUS = "text/html", (401, 403)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html", site: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(src_url, ord, href, target_url, key): anchors in order, behind the columns of their page to keep. Resolved against the page, or against a site's root."""
    base = F.lit(site) if site else F.col("src_url")
    return (
        pages.select(*keep, F.col(url_col).alias("src_url"), F.posexplode(markup.hrefs(F.col(html_col))).alias("ord", "href"))
        .withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&")))
        .withColumn("target_url", F.substring_index(urls.rooted_join(base, F.col("href")), "#", 1))
        .withColumn("key", urls.key(F.col("target_url")))
    )


def fetch_outcome(status, content_type, final_url):
    """Why a fetched page doesn't count, or null: an error state (marked for a login), another type, a login page in the end."""
    auth = F.when(status.isin(*AUTH_STATUS), F.lit(" (auth)")).otherwise(F.lit(""))
    return (
        F.when(status >= 400, F.concat(F.lit("HTTP "), status, auth))
        .when(F.regexp_like(urls.part(final_url, "path"), F.lit(urls.AUTH_PATH)), "redirects to auth")
        .when(~F.contains(F.lower(content_type), F.lit(HTML_TYPE)), "not html")
    )


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): nodes that edges (src, dst) reach from seeds (node), with the fewest steps. Level by level, each an anti-join with what is known."""
    levels = [cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))]
    while max_depth is None or len(levels) <= max_depth:
        known = reduce(DataFrame.unionByName, levels)
        fresh = edges.join(levels[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
        levels.append(cut(fresh.withColumn("depth", F.lit(len(levels)))))
        if not levels[-1].limit(1).count():
            break
    return reduce(DataFrame.unionByName, levels)


def crawl(edges: DataFrame, start: str, sitemap: DataFrame, allowed: DataFrame, max_pages: int = 30, max_depth: int = 2, sitemap_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages in the order of a first-in first-out queue, and what was left out with a reason.

    edges (src, ord, dst) are keys of links, sitemap (ord, key) what is queued
    at depth 1, before the start's own links or (sitemap_first=False) behind
    them, even if the start names it too, allowed (key, reason) the policy's answer ("follow" or why not).
    Returns (key, depth, seq) of at most max_pages and (key, reason) of the
    others; a page that only pages beyond the cap name was never queued and
    isn't among them.

    Each level is numbered as a whole, by its finder's place in the queue and
    the link's place on that page, over range partitions. Only pages within the
    cap are followed, so a crawl never looks further than one level beyond it.
    """
    spark = edges.sparkSession
    follow = allowed.where("reason = 'follow'").select("key")
    levels = [cut(spark.createDataFrame([(start, 0, 1)], "key string, depth int, seq long"))]
    queued = 1
    for depth in range(1, max_depth + 1):
        found = edges.join(levels[-1].where(F.col("seq") <= max_pages).select(F.col("key").alias("src"), F.col("seq").alias("finder")), "src").select(F.col("dst").alias("key"), "finder", F.col("ord").cast("long").alias("ord"))
        if depth == 1:  # what the sitemap lists has its place there, wherever that is
            found = found.join(sitemap.select("key"), "key", "left_anti").unionByName(sitemap.select("key", F.lit(0 if sitemap_first else 2).cast("long").alias("finder"), F.col("ord").cast("long").alias("ord")))
        known = reduce(DataFrame.unionByName, levels)
        fresh = found.groupBy("key").agg(F.min(F.struct("finder", "ord")).alias("q")).join(follow, "key", "left_semi").join(known.select("key"), "key", "left_anti")
        new = numbered(fresh.select("key", "q.finder", "q.ord"), ["finder", "ord", "key"], "n")
        levels.append(cut(new.select("key", F.lit(depth).alias("depth"), (F.col("n") + queued).alias("seq"))))
        more = levels[-1].count()
        if not more:
            break
        queued += more
    done = reduce(DataFrame.unionByName, levels)
    capped = done.where(F.col("seq") > max_pages).select("key", F.lit("max-pages cap").alias("reason"))
    refused = allowed.where("reason <> 'follow'").select("key", "reason")
    return done.where(F.col("seq") <= max_pages), capped.unionByName(refused).groupBy("key").agg(F.min("reason").alias("reason"))


def coverage(sitemap: DataFrame, reached: DataFrame) -> DataFrame:
    """(url, side): sitemap URLs that weren't reached and reached ones outside the sitemap, compared by key; the second only where there is a sitemap."""
    s = sitemap.select(F.col("url"), urls.key(F.col("url")).alias("k"))
    r = reached.select(F.col("url"), urls.key(F.col("url")).alias("k"))
    only_s = s.join(r, "k", "left_anti").select("url").distinct().withColumn("side", F.lit("sitemap_only"))
    only_r = r.join(s, "k", "left_anti").select("url").distinct().withColumn("side", F.lit("crawl_only"))
    some = s.limit(1).select(F.lit(1).alias("some"))
    return only_s.unionByName(only_r.join(F.broadcast(some)).select("url", "side"))


def unexplained(listed: DataFrame, reached: DataFrame, skipped: DataFrame, key: str = "key") -> DataFrame:
    """(key): what a sitemap lists that was neither reached nor skipped with a reason."""
    return listed.select(key).distinct().join(reached.select(key), key, "left_anti").join(skipped.select(key), key, "left_anti")


def wired(link_rows: DataFrame, urlmap: DataFrame) -> DataFrame:
    """(src_url, ord, href, place): where an anchor points in a copy of a site: the file of its page, or #inert where the page isn't part of it."""
    return link_rows.join(urlmap.select("key", "slug"), "key", "left").select("src_url", "ord", "href", F.coalesce("slug", F.lit("#inert")).alias("place"))


def missing_targets(placed: DataFrame, built: DataFrame) -> DataFrame:
    """Files that anchors point to and that weren't built."""
    return placed.where("place <> '#inert'").select(F.col("place").alias("slug")).distinct().join(built.select("slug"), "slug", "left_anti")


def manifest_parts(pages: DataFrame, skipped: DataFrame, coverage_rows: DataFrame, origin: str) -> DataFrame:
    """(section, json): the manifest of a crawl of any size as lines: a header with counts, pages with their keys, skipped ones with reasons, differences with the sitemap."""
    from weftline.plans import sinks

    header = pages.agg(F.lit(origin).alias("origin"), F.count("*").alias("n_pages"))
    return sinks.manifest_lines(header, page=pages.select("url", "slug", urls.key(F.col("url")).alias("key")), skipped=skipped.select("url", "reason"), coverage=coverage_rows.select("side", "url"))


def manifest(pages: DataFrame, skipped: DataFrame, coverage_rows: DataFrame, origin: str) -> DataFrame:
    """One JSON document of a small crawl: pages, skipped with reasons, urlmap, differences with the sitemap. All of it in one row; manifest_parts() is for any size."""
    p = pages.agg(F.array_sort(F.collect_list(F.struct("url", "slug"))).alias("pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(urls.key(F.col("url")).alias("key"), "slug")))).alias("urlmap"))
    s = skipped.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "reason")))).alias("skipped"))
    c = coverage_rows.agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("url")))).alias(side) for side in ("sitemap_only", "crawl_only")])
    return p.crossJoin(s).crossJoin(c).select(F.to_json(F.struct(F.lit(origin).alias("origin"), "pages", "skipped", "urlmap", "sitemap_only", "crawl_only")).alias("json"))
