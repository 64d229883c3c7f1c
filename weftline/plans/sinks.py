"""Writers: pages, manifests, reports, staged installs."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, path: str) -> None:
    """Rewritten pages (slug, html) as a table; files are an export of it."""
    pages.select("slug", "html").write.mode("overwrite").parquet(path)


def write_json(documents: DataFrame, path: str) -> None:
    """One JSON document per row (json) as text."""
    documents.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def manifest_lines(header: DataFrame, **parts: DataFrame) -> DataFrame:
    """(section, json): a manifest as lines, one for the header and one for each row of each part, so that no task holds a whole part."""
    out = header.select(F.lit("header").alias("section"), F.to_json(F.struct("*")).alias("json"))
    for name, rows in parts.items():
        out = out.unionByName(rows.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json")))
    return out


def archives(files: DataFrame, name: str) -> DataFrame:
    """(bundle, archive): the files (bundle, rel, body) of each bundle as a compressed archive, below a folder of that name, in order of their paths.

    An archive is one value, so a bundle must fit a task; equal bundles give
    equal bytes. Null bodies are empty files; of files that repeat a path the
    first in order of bytes is taken.
    """

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        held, done = io.BytesIO(), set()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for rel, body in sorted((r, bytes(b or b"")) for r, b in zip(part["rel"], part["body"], strict=True)):
                if rel not in done:
                    done.add(rel)
                    z.writestr(zipfile.ZipInfo(f"{name}/{rel}"), body, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"bundle": [key[0]], "archive": [held.getvalue()]})

    return files.where("rel is not null").select("bundle", "rel", "body").groupBy("bundle").applyInPandas(pack, "bundle string, archive binary")


def write_report(texts: DataFrame, path: str) -> None:
    """Reports (scope_id, text), a folder for each scope."""
    texts.select("scope_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("scope_id").text(path)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def install(rows: DataFrame, path: str, check, force: bool = False) -> bool:
    """Puts a table in place of the one at a path, if check(new table) holds.

    The new rows are written beside it first and checked as read back; then
    the old folder is renamed away and the new one renamed in, so the old table
    stays, byte for byte, whenever something fails. An existing table is only
    replaced with force. Returns whether it was installed.
    """
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not force:
        return False
    staged, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    _, new_path = _fs(spark, staged)
    _, old_path = _fs(spark, old)
    try:
        rows.write.parquet(staged)
        if not check(spark.read.parquet(staged)):
            return False
        if fs.exists(target) and not fs.rename(target, old_path):
            return False
        if not fs.rename(new_path, target):
            fs.rename(old_path, target)
            return False
        fs.delete(old_path, True)
        return True
    finally:
        fs.delete(new_path, True)
