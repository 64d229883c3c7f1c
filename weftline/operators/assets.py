"""Assets of collected pages: harvest, fixed point, names, validation, rewriting."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import markup, urls
from weftline.session import cut

#: How source text refers to files. The reference is the second group, behind its quote.
PATTERNS = [
    ("module", r"""(?:import\s*\(|from\s+|new\s+URL\s*\()\s*(['"`])([^'"`]+)\1"""),
    ("css", r"""url\(\s*(['"]?)([^'")]+)\1"""),
    ("attribute", r"""(?i)(?:src|href|poster|data-src)\s*=\s*(["'])([^"']+)\1"""),
]
#: Absolute references, lists of candidates, names of chunks, and what is left out though it looks like a reference.
ABSOLUTE = r"(?i)https?://[^\s\"'<>\\`]+"
SRCSET = r"""(?i)\bsrcset\s*=\s*(["'])([^"']+)\1"""
CHUNK_MAP = r'(\d+)===(\w+)\?"static/chunks/"\+\2\+"-([0-9a-f]{6,})\.js"'
CHUNK_LITERAL = r'"(static/chunks/[\w./-]+\.js)"'
TEMPLATE = "${i.value}"
#: Rounds of fetching.
ROUNDS = 6


def plain_amp(text: Column) -> Column:
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def named(text: Column) -> Column:
    """(kind, ref) of all that a source text names, as written but for escaped ampersands."""

    def found(kind: str, refs: Column) -> Column:
        return F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))

    parts = [found("absolute", F.regexp_extract_all(plain_amp(text), F.lit(ABSOLUTE), F.lit(0)))]
    for kind, pattern in PATTERNS:
        refs = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda r: plain_amp(F.regexp_replace(r, r"^\s+|\s+$", "")))
        parts.append(found(kind, F.filter(refs, lambda r: (r != "") & ~urls.skipped_scheme(r))))
    lists = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SRCSET), F.lit(2)), markup.srcset_urls))
    parts.append(found("srcset", F.transform(lists, plain_amp)))
    mapped = F.transform(
        F.regexp_extract_all(text, F.lit(CHUNK_MAP), F.lit(0)),
        lambda m: F.concat(F.lit("static/chunks/"), F.regexp_extract(m, CHUNK_MAP, 1), F.lit("-"), F.regexp_extract(m, CHUNK_MAP, 3), F.lit(".js")),
    )
    parts.append(found("chunk", F.concat(mapped, F.regexp_extract_all(text, F.lit(CHUNK_LITERAL), F.lit(1)))))
    return F.concat(*parts)


def by_import_map(refs: DataFrame, maps: DataFrame) -> DataFrame:
    """(src_url, ref, mapped): references (src_url, ref) that their source's import map (src_url, entry, target) answers: by the whole reference, else by the longest entry that ends in a slash and begins it.

    A reference is asked for as a whole and cut behind each slash, so an entry
    is found by equality.
    """
    at = F.filter(F.sequence(F.lit(1), F.length("ref")), lambda i: F.substring(F.col("ref"), i, F.lit(1)) == "/")
    asked = refs.select("src_url", "ref").distinct().withColumn("entry", F.explode(F.array_distinct(F.concat(F.array("ref"), F.transform(at, lambda i: F.substring(F.col("ref"), F.lit(1), i))))))
    hit = asked.join(maps.dropDuplicates(["src_url", "entry"]), ["src_url", "entry"])
    found = F.concat("target", F.substring(F.col("ref"), F.length("entry") + 1, F.length("ref")))
    return hit.groupBy("src_url", "ref").agg(F.max_by(found, F.length("entry")).alias("mapped"))


def harvest(sources: DataFrame, url_col: str = "url", text_col: str = "text", mapped: bool = False) -> DataFrame:
    """(src_url, asset_url, kind, ref): distinct references of source texts, and the assets that they name.

    mapped: modules, styles and attributes are looked up in the source's own
    import map first. Every other reference is resolved against its source, and
    cut behind the extension of a file; what has none is no asset.
    """
    text = F.col(text_col)
    imports = markup.import_map(text) if mapped else F.lit(None).cast("map<string,string>")
    src = sources.select(F.col(url_col).alias("src_url"), text.alias("text"), imports.alias("imports"))
    refs = src.select("src_url", F.coalesce(F.size("imports") > 0, F.lit(False)).alias("has_map"), F.explode(named(F.col("text"))).alias("r")).select("src_url", "has_map", "r.kind", "r.ref").distinct()
    full = (
        F.when(F.col("kind") == "absolute", F.col("ref"))
        .when(F.col("kind") == "chunk", urls.next_root(F.col("src_url"), F.when(F.contains("src_url", F.lit("_next/")), F.col("ref"))))
        .otherwise(urls.resolved(F.col("src_url"), F.col("ref")))
    )
    if mapped:  # only sources that have a map take part in the join; texts are searched once
        refs = cut(refs)
        own = refs.where("has_map and kind in ('module', 'css', 'attribute')")
        entries = src.where("size(imports) > 0").select("src_url", F.explode("imports").alias("entry", "target"))
        refs = refs.where("not (has_map and kind in ('module', 'css', 'attribute'))").withColumn("full", full).unionByName(own.join(by_import_map(own, entries), ["src_url", "ref"], "left").withColumn("full", F.coalesce("mapped", full)).drop("mapped"))
    else:
        refs = refs.withColumn("full", full)
    odd = F.col("kind").isin("module", "css", "attribute") & F.contains("full", F.lit(TEMPLATE))
    return refs.where(~F.coalesce(odd, F.lit(False))).select("src_url", urls.asset_url(F.col("full")).alias("asset_url"), "kind", "ref").where("asset_url is not null").distinct()


def verdict(fetched: DataFrame) -> Column:
    """What is wrong with a fetched asset, "ok", or "stub" for an analytics library that isn't kept; the first that holds."""
    path, kind = urls.part(F.col("url"), "path"), F.lower(F.coalesce("content_type", F.lit("")))
    head = F.lower(F.ltrim(F.decode(F.substring("body", 1, 64), "ISO-8859-1")))
    page = head.startswith("<!doctype") | head.startswith("<html")
    is_text = F.regexp_like(path, F.lit(urls.TEXT_ASSET))
    return (
        F.when(F.regexp_like("url", F.lit(urls.ANALYTICS_FILE)), "stub")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status") != 200, F.concat(F.lit("HTTP "), "status"))
        .when(F.coalesce(F.length("body"), F.lit(0)) == 0, "empty body")
        .when(~is_text & page, "HTML body")
        .when(F.contains(kind, F.lit("text/html")) & ~F.regexp_like(path, F.lit(r"(?i)\.html?$")), F.concat(F.lit("content-type "), kind))
        .otherwise("ok")
    )


def bucket(why: Column) -> Column:
    return (
        F.when(why.startswith("HTTP "), "origin_404s")
        .when(why.startswith("content-type"), "content_type_mismatches")
        .when(why.startswith("HTML body") | (why == "empty body"), "integrity_problems")
        .otherwise("network_failures")
    )


def fixpoint(pages: DataFrame, fetched: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Assets that pages reach, through text assets that name further ones and through the siblings of paged collections: (url, round) of those that `rounds` rounds fetch, and (url) of those that are left then.

    Each round reads only the texts that the one before has brought, and keeps
    only URLs that no round has seen. The second table is empty where the
    rounds came to an end by themselves. Import maps are those of the pages.
    """
    found = harvest(pages, "url", "html", mapped=True).select(F.col("asset_url").alias("url")).distinct()
    levels = [cut(with_siblings(found).withColumn("round", F.lit(0)))]
    readable = fetched.where(verdict(fetched) == "ok").where(F.regexp_like(urls.part(F.col("url"), "path"), F.lit(urls.TEXT_ASSET))).select("url", F.make_valid_utf8(F.col("body").cast("string")).alias("text"))
    while len(levels) <= rounds:
        text = readable.join(levels[-1].select("url"), "url", "left_semi")
        new = with_siblings(harvest(text).select(F.col("asset_url").alias("url")).distinct())
        known = reduce(DataFrame.unionByName, levels)
        levels.append(cut(new.join(known.select("url"), "url", "left_anti").withColumn("round", F.lit(len(levels)))))
        if not levels[-1].limit(1).count():
            break
    done = reduce(DataFrame.unionByName, levels)
    return done.where(F.col("round") < rounds), done.where(F.col("round") >= rounds).select("url")


def with_siblings(found: DataFrame) -> DataFrame:
    other = found.select(urls.chunk_sibling(F.col("url")).alias("url")).where("url is not null")
    return found.unionByName(other).distinct()


def claimed(found: DataFrame) -> DataFrame:
    """(url, round, name, tag): local names. The first URL of a base name, by round and then alphabetically, keeps it plain; those with a query never do."""
    plain = urls.asset_name(F.col("url"), F.lit(False))
    base = F.regexp_extract(urls.part(F.col("url"), "path"), r"([^/]*)$", 1)
    rows = found.groupBy("url").agg(F.min("round").alias("round")).withColumn("__base", F.when(base == "", "index").otherwise(base))
    first = rows.groupBy("__base").agg(F.min_by("url", F.struct("round", "url")).alias("__first"))
    rows = rows.join(first, "__base").withColumn("__clash", F.col("url") != F.col("__first"))
    named = F.when(F.col("__clash"), urls.asset_name(F.col("url"), F.lit(True))).otherwise(plain)
    return rows.select("url", "round", named.alias("name"), F.when(named != F.col("__base"), urls.url_tag(F.col("url"))).alias("tag"))


def longest_first(text: str, own: dict[str, str], machine) -> str:
    """text with each of its own patterns replaced, in one pass: of occurrences that overlap the longest counts (of equal ones the smaller, then the earlier)."""
    at = sorted((-len(p), p, end + 1 - len(p)) for end, p in machine.iter(text) if p in own)
    taken = bytearray(len(text))
    chosen = []
    for n, p, start in at:
        # what is taken already is at least as long, so it covers an end of whatever it overlaps
        if not (taken[start] or taken[start - n - 1]):
            taken[start : start - n] = b"\1" * -n
            chosen.append((start, p))
    out, last = [], 0
    for start, p in sorted(chosen):
        out += [text[last:start], own[p]]
        last = start + len(p)
    return "".join([*out, text[last:]])


def rewrite(pages: DataFrame, page_assets: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, html): absolute asset URLs of each page replaced by their places, longest URL first, written plainly or with escaped ampersands.

    page_assets (src_url, asset_url, place) names what each page holds. All of
    a batch's URLs make one automaton, which reads each of its pages once,
    whatever their number. Assets that could not be fetched are among them:
    nothing keeps pointing at the origin. Of several places of one URL the
    smallest counts; an empty URL is none.
    """
    import ahocorasick

    both = F.explode(F.array_distinct(F.array("asset_url", F.replace("asset_url", F.lit("&"), F.lit("&amp;")))))
    own = page_assets.where("asset_url <> '' and place is not null").select(F.col("src_url").alias("__u"), both.alias("a"), "place").groupBy("__u", "a").agg(F.min("place").alias("p"))
    own = own.groupBy("__u").agg(F.map_from_entries(F.collect_list(F.struct("a", "p"))).alias("__own"))
    joined = pages.join(own, F.col(url_col) == F.col("__u"), "left").drop("__u")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            where = [{} if w is None else dict(w) for w in part.pop("__own")]
            machine = ahocorasick.Automaton()
            for w in where:
                for p in w:
                    machine.add_word(p, p)
            machine.make_automaton()
            part[html_col] = [longest_first(t, w, machine) if w and isinstance(t, str) else t for t, w in zip(part[html_col], where, strict=True)]
            yield part

    return joined.mapInPandas(run, pages.schema)


def relative_rewrite(sources: DataFrame, places: DataFrame, url_col: str = "url", text_col: str = "text") -> DataFrame:
    """(url, text): relative references of source texts replaced by places; quotes, descriptors and everything else stay.

    places (src_url, ref, place) is what harvest() has found in each source,
    joined with where its assets lie; it is brought to each source by its URL.
    """
    wanted = places.where(~urls.skipped_scheme(F.col("ref"), absolute=True)).groupBy("src_url", "ref").agg(F.min("place").alias("place"))
    own = wanted.groupBy(F.col("src_url").alias("__u")).agg(F.map_from_entries(F.collect_list(F.struct("ref", "place"))).alias("__places"))
    patterns = [re.compile(p) for _, p in PATTERNS]
    lists = re.compile(SRCSET)

    def one(text: str, where: dict) -> str:
        def target(ref: str) -> str:
            return where.get(ref.strip().replace("&amp;", "&"), ref)

        def swap(m: re.Match) -> str:
            at, end = m.start(2) - m.start(), m.end(2) - m.start()
            return m.group()[:at] + target(m.group(2)) + m.group()[end:]

        def swap_list(m: re.Match) -> str:
            parts = [p.split() for p in m.group(2).split(",") if p.split()]
            new = [[target(p[0]), *p[1:]] for p in parts]
            if new == parts:
                return m.group()
            return m.group()[: m.start(2) - m.start()] + ", ".join(" ".join(p) for p in new) + m.group()[m.end(2) - m.start() :]

        for pattern in patterns:
            text = pattern.sub(swap, text)
        return lists.sub(swap_list, text)

    @F.pandas_udf("string")
    def apply(text: pd.Series, where: pd.Series) -> pd.Series:
        return pd.Series([t if w is None or t is None else one(t, dict(w)) for t, w in zip(text, where, strict=True)])

    return sources.join(own, F.col(url_col) == F.col("__u"), "left").withColumn(text_col, apply(text_col, "__places")).drop("__u", "__places")


def totals(fetched: DataFrame) -> DataFrame:
    """(mirrored, bytes, problems) and the URLs and reasons of each kind of failure."""
    v = fetched.withColumn("why", verdict(fetched)).withColumn("bucket", F.when(~F.col("why").isin("ok", "stub"), bucket(F.col("why"))))
    lists = [F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("url", "why")))).alias(b) for b in ("origin_404s", "content_type_mismatches", "integrity_problems", "network_failures")]
    return v.agg(F.count_if(F.col("bucket").isNull()).alias("mirrored"), F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.length("body"))), F.lit(0)).alias("bytes"), F.count_if(F.col("bucket").isin("integrity_problems", "network_failures")).alias("problems"), *lists)


def build_manifest_parts(fetched: DataFrame, changes: DataFrame, placed: DataFrame) -> DataFrame:
    """(section, json): the manifest of a build of any size as lines: a header with counts, each asset's failure with its kind, changes by class, and links."""
    from weftline.plans import sinks

    why = fetched.select("url", verdict(fetched).alias("why"), F.length("body").alias("size")).withColumn("bucket", F.when(~F.col("why").isin("ok", "stub"), bucket(F.col("why"))))
    own = F.col("bucket").isNull()
    header = why.agg(F.count_if(own).alias("mirrored"), F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("bucket").isin("integrity_problems", "network_failures")).alias("problems"))
    links = placed.groupBy(F.when(F.col("place") == "#inert", "inert").otherwise("wired").alias("state")).agg(F.count("*").alias("n"))
    return sinks.manifest_lines(header, failure=why.where(~own).select("bucket", "url", "why"), change=changes.groupBy("name").agg(F.sum("n").alias("n")), links=links)


def build_manifest(fetched: DataFrame, changes: DataFrame, placed: DataFrame) -> DataFrame:
    """One JSON document of a small build: assets, changes by class (name, n), links wired and inert. All of it in one row; build_manifest_parts() is for any size."""
    c = changes.groupBy("name").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("changes"))
    w = placed.agg(F.count_if(F.col("place") != "#inert").alias("wired"), F.count_if(F.col("place") == "#inert").alias("inert"))
    return totals(fetched).crossJoin(c).crossJoin(w).select(F.to_json(F.struct("*")).alias("json"))


def rerouted(missing: DataFrame, files: DataFrame) -> DataFrame:
    """(path, place): a requested path that isn't there, served by a file of the same base name (the smallest path of several)."""
    by_base = files.groupBy(F.regexp_extract("path", r"([^/]*)$", 1).alias("__base")).agg(F.min("path").alias("place"))
    return missing.withColumn("__base", F.regexp_extract("path", r"([^/?#]*)(?:[?#].*)?$", 1)).join(by_base, "__base", "left").select("path", "place")
