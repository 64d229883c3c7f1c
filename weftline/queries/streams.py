"""The driver's events replayed as a stream; each result equals that of the batch form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.queries.registry import query
from weftline.session import kept, shared_dir
from weftline.streaming import recorder


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run(spark: SparkSession, out: DataFrame, mode: str, key: Sequence[str] = ()) -> DataFrame:
    """Replays into the shared folder, until release().

    append adds to a table, complete replaces it with each micro-batch, and
    update keeps what each micro-batch changes in a folder of its own (written
    again if it is repeated), of which the latest row of each key counts.
    """
    where = kept(spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    w = out.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/log").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{where}/out").start().awaitTermination()
    elif mode == "complete":
        w.foreachBatch(lambda d, _: d.write.mode("overwrite").parquet(f"{where}/out")).start().awaitTermination()
    else:
        w.foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(f"{where}/out/micro_batch={n}")).start().awaitTermination()
        rows = spark.read.parquet(f"{where}/out")
        own = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "micro_batch"])
        return rows.groupBy(*[F.col(f"`{k}`").alias(f"key_{k}") for k in key]).agg(F.max_by(own, "micro_batch").alias("latest")).select("latest.*")
    return spark.read.parquet(f"{where}/out")


@query("stream_first_keys", "select distinct user_id, event_type from events")
def stream_first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per key: which keys there are doesn't depend on the order of arrival."""
    return run(spark, recorder.keep_first(_stream(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("stream_running_counts", "select event_type, count(*) as n from events group by event_type")
def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, recorder.running_counts(_stream(spark, sf_dir), ["event_type"]), "complete")


@query("stream_channels", "select user_id, min(case when event_type = 'click' then 'event' else 'poll' end) as channel, count(*) as n from events group by user_id")
def stream_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("channel", F.when(F.col("event_type") == "click", "event").otherwise("poll"))
    return run(spark, recorder.merged_channels(rows, ["user_id"]), "complete")


@query("stream_timed", "select event_type, count(*) as n from events where floor(value / 10) <> 0 group by event_type")
def stream_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("duration", F.floor(F.col("value") / 10))
    return run(spark, recorder.running_counts(recorder.timed(rows), ["event_type"]), "complete")


@query("stream_ordered_first", "select user_id, min(event_id) as event_id from events group by user_id")
def stream_ordered_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("seq", F.col("event_id"))
    got = run(spark, recorder.numbered_first(rows, "user_id", "event_id", "seq"), "update", ["user_id"])
    return got.select("user_id", "event_id")


#: Parts of time in which the events arrive.
SPANS = 4


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as a stream of several micro-batches, one for each span of time and two last ones with nothing but a far later time, after which nothing is awaited; and the length of a span, by which records may be late."""
    where = kept(spark, f"{shared_dir(spark)}/spans-{uuid.uuid4().hex}")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = rows.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    length = max(1, int(((hi or 0) - (lo or 0)) / SPANS) + 1)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = F.floor((F.col("ts").cast("double") - F.lit(lo or 0)) / length)
    for k in range(SPANS):
        rows.where(span == k).repartition(files).write.mode("append").parquet(where)
    # a user of their own, as joins leave out rows without one, and the time of closing rows must be seen on either side
    far = {"ts": F.timestamp_seconds(F.lit(int(hi or 0) + 100 * length)), "user_id": F.lit(-1)}
    end = [far.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    for _ in range(2):  # what the first of them puts an end to comes out with the second
        spark.range(files).repartition(files, "id").select(*end).write.mode("append").option("maxRecordsPerFile", 1).parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(where), f"{length} seconds"


@query("stream_ends", """select s.event_id, s.user_id, e.event_id as end_id from (select * from events where event_type = 'view') s
 left join (select * from events where event_type = 'purchase') e on e.user_id = s.user_id and e.ts >= s.ts and e.ts <= s.ts + interval 6 hours""")  # fmt: skip
def stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the next six hours, as two streams that are joined; views without any come out once six hours have passed."""
    rows, late = _spans(spark, sf_dir)
    other, _ = _spans(spark, sf_dir)
    closing = F.col("event_id").isNull()
    starts = rows.where((F.col("event_type") == "view") | closing).select("event_id", "user_id", "ts")
    ends = other.where((F.col("event_type") == "purchase") | closing).select("user_id", "ts", F.col("event_id").alias("to"))
    out = recorder.with_ends(starts, ends, ["user_id"], "6 hours", late)
    # a filter here would reach the sources, and the closing rows with their time would go
    return run(spark, out.select("event_id", "user_id", F.col("e_to").alias("end_id")), "append").where("event_id is not null")


@query("stream_visits", """with e as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hours, true)::int as new from events),
 v as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as visit from e)
 select user_id, epoch_us(min(ts)) as begins, epoch_us(max(ts)) + 43200000000 as ends, min(event_id) as event_id, count(*) as n from v group by user_id, visit""")  # fmt: skip
def stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each visit of a user, with state that ends with the visit."""
    rows, late = _spans(spark, sf_dir)
    rows = rows.withColumn("order", F.col("event_id"))
    out = recorder.first_of_visit(rows, ["user_id"], "event_id", "order", "ts", "12 hours", late)
    return run(spark, out.select("user_id", F.unix_micros("begins").alias("begins"), F.unix_micros("ends").alias("ends"), "event_id", "n"), "append").where("event_id is not null")
