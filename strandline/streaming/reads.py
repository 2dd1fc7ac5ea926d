"""Reads as a stream: overlaps with the exons of a static model, counted in
event-time windows with a watermark for late reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.ranges import div, strands_agree
from strandline.operators.intervals import BIN
from strandline.sources.star import reads
from strandline.sources.store import shared_folder

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint"


def read_stream(spark: SparkSession, sf_dir: str, files: str = "events.parquet", at_once: int | None = None) -> DataFrame:
    """Reads with ``ts`` from the events file as it grows; ``at_once`` limits the
    files of a batch."""
    source = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", files)
    events = (source if at_once is None else source.option("maxFilesPerTrigger", at_once)).parquet(sf_dir)
    return reads(spark, sf_dir, events, keep=("ts",))


def overlap_counts(stream: DataFrame, exons: DataFrame, window: str = "1 day", late: str = "2 days", bin_width: int = BIN) -> DataFrame:
    """Read-exon overlaps by event-time window and chromosome. The model's side is
    static, so the join holds no state; only open windows do."""
    bins = lambda: F.explode(F.sequence(div(F.col("start"), bin_width), div(F.col("end"), bin_width)))
    left = stream.withWatermark("ts", late).withColumn("bin", bins()).withColumn("l_bin", div(F.col("start"), bin_width))
    right = exons.select("seqnames", F.col("start").alias("s"), F.col("end").alias("e"), F.col("strand").alias("x"), "start", "end").withColumn("bin", bins()).drop("start", "end")
    first = F.greatest(F.col("l_bin"), div(F.col("s"), bin_width))
    hits = left.join(right, ["seqnames", "bin"]).where((F.col("bin") == first) & (F.col("start") <= F.col("e")) & (F.col("end") >= F.col("s")) & strands_agree(F.col("strand"), F.col("x")))
    return hits.groupBy(F.window("ts", window).alias("w"), "seqnames").agg(F.count(F.lit(1)).alias("n_overlaps"))


def write_counts(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts ``counts`` into a Parquet table at ``path``, one folder a batch.

    A batch that runs again after a failure writes over its own folder, so
    nothing counts twice. ``append`` writes a window once, when the watermark
    has passed it; ``update`` writes open windows too, as often as they change.
    Both folders must be where all executors see them."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("w.start").alias("start"), "seqnames", "n_overlaps")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """start, seqnames and n_overlaps of the table, each window as last written."""
    rows = spark.read.schema("start timestamp, seqnames string, n_overlaps bigint, batch bigint").option("basePath", path).parquet(path)
    return rows.groupBy("start", "seqnames").agg(F.max_by("n_overlaps", "batch").alias("n_overlaps"))


def overlap_counts_of(spark: SparkSession, sf_dir: str, exons: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs the stream over what is there and returns day, seqnames and count,
    with windows that are still open. The table and the checkpoint go to
    ``folder``, by default a new one in the shared folder of the session; with a
    folder of an earlier run the stream goes on where that ended."""
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write_counts(overlap_counts(read_stream(spark, sf_dir), exons), f"{folder}/counts", f"{folder}/checkpoint", "update").awaitTermination()
    return read_counts(spark, f"{folder}/counts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "seqnames", "n_overlaps")
