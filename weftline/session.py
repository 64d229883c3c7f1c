"""Session factory and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "weftline", cpus: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with the settings that the engine expects (UTC, AQE)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if there:
        return there
    held = sc.getCheckpointDir()
    if held is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "weftline-shared"))
        held = sc.getCheckpointDir()
    return held


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files that outlive executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that held() has written and that are still there, by their path.
_written: set[str] = set()


def held(df: DataFrame, name: str = "part") -> DataFrame:
    """df as written to a table in the shared folder: computed once, and read again by whoever needs it. It stays until discard() or release()."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._held_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of held() that nothing reads any more."""
    for t in tables:
        path = t._held_at
        _written.discard(path)
        remove(t.sparkSession, path)


def kept(spark: SparkSession, path: str) -> str:
    """path, to be deleted by release()."""
    _written.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all tables that held() has written and kept() has named, once the results that read them are no longer needed."""
    for path in sorted(_written):
        remove(spark, path)
    _written.clear()
