"""Readers of collected sites: robots rules, sitemaps, raw pages, documents, trees. Nothing here uses the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOC = r"<loc>\s*([^<\s]+)\s*</loc>"


def robots_rules(texts: DataFrame) -> DataFrame:
    """(origin, ord, rule): Disallow values under the latest `User-agent: *` line.

    Every User-agent line opens a scope of its own, so of agents that are
    listed together only the last one counts. Blank and comment lines are
    passed over, empty values dropped; an origin without a readable file has no
    rules. texts (origin, text).
    """
    lines = texts.where("text is not null").select("origin", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#')")
    value = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    agent = F.when(F.regexp_like("line", F.lit(r"(?i)^user-agent\s*:")), value)
    scope = F.last(agent, ignorenulls=True).over(Window.partitionBy("origin").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("agent", scope).where(F.regexp_like("line", F.lit(r"(?i)^disallow\s*:")) & (F.col("agent") == "*")).select("origin", "ord", value.alias("rule")).where("rule <> ''")


def robots_blocked(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with a column `robots`: a rule of its origin begins its path and query; stars in rules are wild.

    What a rule has before its first star is joined for equality with as many
    first characters of the paths of its origin; only then are stars tried. The
    lengths of these beginnings reach the driver, no more numbers than the
    longest rule has characters. A null URL isn't blocked.
    """
    from weftline.functions import urls as U

    u = F.col(url_col)
    tail = F.concat(U.part(u, "path"), F.when(U.part(u, "query") != "", F.concat(F.lit("?"), U.part(u, "query"))).otherwise(""))
    keyed = urls.withColumns({"__origin": U.origin(u), "__tail": tail})
    begins = F.substring_index("rule", "*", 1)
    own = rules.where("rule is not null").select(F.col("origin").alias("__origin"), begins.alias("__begin"), F.length(begins).alias("__n"), F.when(F.contains("rule", F.lit("*")), U.robots_pattern(F.col("rule"))).alias("__pattern")).distinct()
    sizes = sorted(r[0] for r in own.select("__n").distinct().collect())
    asked = keyed.select("__origin", "__tail").where("__tail is not null").distinct().withColumn("__n", F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("__tail"))))
    hit = asked.withColumn("__begin", F.substring(F.col("__tail"), F.lit(1), F.col("__n"))).join(own, ["__origin", "__n", "__begin"])
    hit = hit.where(F.col("__pattern").isNull() | F.regexp_like("__tail", F.col("__pattern"))).select("__origin", "__tail", F.lit(True).alias("__hit")).distinct()
    return keyed.join(hit, ["__origin", "__tail"], "left").withColumn("robots", F.coalesce("__hit", F.lit(False))).drop("__origin", "__tail", "__hit").select(*urls.columns, "robots")


def sitemap_urls(files: DataFrame, root: str) -> DataFrame:
    """(loc): URLs of a sitemap. An entry that ends in .xml is an index and is read one level deep; what is nested deeper is dropped. files (url, text)."""
    locs = lambda d: d.select(F.explode(F.regexp_extract_all("text", F.lit(LOC), F.lit(1))).alias("loc"))
    top = locs(files.where(F.col("url") == root))
    inner = locs(files.join(top.select(F.col("loc").alias("url")).where(F.col("url").endswith(".xml")), "url", "left_semi"))
    return top.unionByName(inner).where(~F.col("loc").endswith(".xml")).distinct()


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, text) of every file below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def raw_pages(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(slug, html) of a crawl's pages. Fails when the folder lacks a page that the manifest (slug) names."""
    pages = whole_files(spark, path, "*.html").select(F.regexp_extract("file", r"([^/]+)$", 1).alias("slug"), F.col("text").alias("html"))
    lost = manifest.select("slug").join(pages.select("slug"), "slug", "left_anti").limit(5).collect()
    if lost:
        raise FileNotFoundError(f"pages of the manifest are missing: {', '.join(r['slug'] for r in lost)}")
    return pages.join(manifest.select("slug"), "slug", "left_semi")


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one per file: by a schema, or as (file, doc) with free form."""
    if schema:
        return spark.read.schema(schema).json(path, multiLine=True)
    return whole_files(spark, path, "*.json").select("file", F.try_parse_json("text").alias("doc"))


def dig(doc, path: str):
    """A value of a document and whether it is there at all: {found, value}. A null that is written down is found."""
    value = F.try_variant_get(doc, f"$.{path}", "variant")
    return F.struct(value.isNotNull().alias("found"), F.try_variant_get(doc, f"$.{path}", "string").alias("value"))


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(rel, ext, size, text) of the files of a tree. Links are followed by the file system and can't be told here; listings that know them add is_link."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "/" + path.split(":", 1)[-1].strip("/") + "/"
    rows = files.withColumn("rel", F.regexp_replace("path", r"^[a-z]+:/*", "/")).withColumn("rel", F.substring("rel", len(root) + 1, 4096))
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    return rows.select("rel", ext.alias("ext"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"), F.lit(False).alias("is_link"))
