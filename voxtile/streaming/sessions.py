"""Sessions: groups of spans whose pauses stay within a bound, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtile.session import shared_folder


def islands(df: DataFrame, key: str, max_pause: int, chunk: int = 86_400_000_000) -> DataFrame:
    """(key, start_us, end_us, n): spans (start_us, end_us) of a key merged while the pause is at most ``max_pause``.

    Two levels, so that a key with very many spans is spread over its chunks of time: the
    latest end before a chunk is carried by a summary with one row per key and chunk.
    """
    s = df.select(key, "start_us", "end_us").withColumn("__c", F.floor(F.col("start_us") / chunk))
    before = Window.partitionBy(key).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ends = s.groupBy(key, "__c").agg(F.max("end_us").alias("__e")).select(key, "__c", F.max("__e").over(before).alias("__carry"))
    w = Window.partitionBy(key, "__c").orderBy("start_us", "end_us")
    edge = F.greatest(F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carry"))
    marked = s.join(ends, [key, "__c"]).withColumn("__new", edge.isNull() | (F.col("start_us") - edge > max_pause))
    opened = F.last(F.when(F.col("__new"), F.col("start_us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__o", opened)
    last = marked.where("__new").groupBy(key, "__c").agg(F.max("start_us").alias("__l"))
    every = marked.select(key, "__c").distinct().join(last, [key, "__c"], "left")
    carried = every.select(key, "__c", F.last("__l", ignorenulls=True).over(before).alias("__lo"))
    full = marked.join(carried, [key, "__c"]).withColumn("start", F.coalesce("__o", "__lo"))
    return full.groupBy(key, "start").agg(F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n")).select(key, F.col("start").alias("start_us"), "end_us", "n")


def session_stream(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions with late data up to a watermark: (key, start, end, n). The last session of a key comes with the final watermark."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(key, F.session_window("__t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding event-time windows with a watermark: (start, end, n)."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    w = F.window("__t", size, slide) if slide else F.window("__t", size)
    return timed.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def settled(stream: DataFrame, schema: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives what it wrote, with the number of the micro-batch in ``_batch``.

    Checkpoint and output lie in the shared checkpoint folder, under a name of their own.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, "stream")

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(f"{schema}, _batch long").parquet(f"{base}/out/*")
