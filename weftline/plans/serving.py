"""Answers to requests for files of a copied site, as a table: what a server would send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import binary

#: Fixed value: the folder that holds all assets of a copied site side by side.
ASSETS = "/cdn/"


def responses(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, status, content_type, content_length, cache_control, body) for requests (request_id, target) to files (path, body).

    A path that isn't there is served by the asset of the same base name, if
    there is one. Well-formed ranges in the query (`range=a-b,c-d`) answer with
    the slices one behind the other, status 200, not to be stored; malformed
    ones, and none, with the whole file. Without a file the status is 404 and
    the rest null, as for a null target. Of files that repeat a path the
    smallest body counts.
    """
    path = F.regexp_extract("target", r"^([^?#]*)", 1)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    asked = F.url_decode(F.regexp_extract("target", r"[?&]range=([^&#]+)", 1))
    own = files.groupBy("path").agg(F.min("body").alias("body"))
    rows = requests.select("request_id", "target", path.alias("wanted"), F.when(base != "", F.concat(F.lit(ASSETS), base)).alias("other"), asked.alias("asked"))
    rows = rows.join(own.select(F.col("path").alias("wanted"), F.col("body").alias("first")), "wanted", "left")
    rows = rows.join(own.select(F.col("path").alias("other"), F.col("body").alias("second")), "other", "left")
    body = F.coalesce("first", "second")
    name = F.when(F.col("first").isNotNull(), F.col("wanted")).otherwise(F.col("other"))
    rows = rows.select("request_id", body.alias("whole"), name.alias("name"), F.when(F.col("asked") != "", binary.byte_ranges(F.col("asked"))).alias("ranges"))
    there = F.col("whole").isNotNull()
    sent = F.when(F.col("ranges").isNotNull(), binary.sliced(F.col("whole"), F.col("ranges"))).otherwise(F.col("whole"))
    rows = rows.withColumn("sent", sent)
    return rows.select(
        "request_id",
        F.when(there, 200).otherwise(404).alias("status"),
        F.when(there, binary.media_type(F.col("name"), F.col("whole"))).alias("content_type"),
        F.when(there, F.length("sent")).alias("content_length"),
        F.when(there & F.col("ranges").isNotNull(), "no-store").alias("cache_control"),
        F.when(there, F.col("sent")).alias("body"),
    )


def counters(answers: DataFrame) -> DataFrame:
    """(ranges_served, whole, missing): what was sent."""
    return answers.agg(F.count_if(F.col("cache_control").isNotNull()).alias("ranges_served"), F.count_if((F.col("status") == 200) & F.col("cache_control").isNull()).alias("whole"), F.count_if(F.col("status") == 404).alias("missing"))
