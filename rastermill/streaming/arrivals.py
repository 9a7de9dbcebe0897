"""File-arrival streams: the batch operators run on what is new, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rastermill.functions.lineage import cut_lineage
from rastermill.functions.scalars import EXTENSIONS, content_hash, extension
from rastermill.operators import batch
from rastermill.sources.keyed import KeyedTable


def stream_images(spark: SparkSession, folder: str, limit: int = 100, recursive: bool = False) -> DataFrame:
    """path, name, size, mtime, content, sha of files as they arrive, at most `limit` a trigger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", limit).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.where(extension(F.col("path")).isin(list(EXTENSIONS)))
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", content_hash(F.col("content")).alias("sha"))


def stream_dedupe(stream: DataFrame, time: str, delay: str, key: str = "sha") -> DataFrame:
    """The first arrival of each key within the delay; state older than the watermark is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_status_counts(log_stream: DataFrame) -> DataFrame:
    """Running number of records per status; write in complete mode."""
    return log_stream.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Micro-batches after which the table of done contents is written anew as one snapshot.
COMPACT_EVERY = 50


def stream_recognise(stream: DataFrame, recognise: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Per micro-batch: look contents up, dedupe, recognise what is new, write answers and log. Every file gets one record.

    stream: path, sha, ... ; recognise: rows with path and sha -> path, status, answer, error. What a
    batch writes stands in folders of its own number, so a batch that is run again replaces its output.
    Copies of a file that is done, in this batch or an earlier one, are done from cache and name it as
    duplicate_of; contents that failed are tried again with their next file. What is done is kept by sha in a
    keyed table (`out`/done), of which a batch reads the shards of its own contents; the log is never read.
    """
    out = out.rstrip("/")

    def each(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = KeyedTable(spark, f"{out}/done", "first_rel string")
        if number and number % compact_every == 0:
            done.compact(below=number)
        files = rows.withColumnRenamed("path", "rel")
        known = done.lookup(files.select(F.col("sha").alias("key")), but=number).withColumnRenamed("key", "sha")
        old, new = batch.known_copies(files, cut_lineage(known))
        marked = batch.dedupe_content(new)
        answers = recognise(marked.where("duplicate_of IS NULL").withColumnRenamed("rel", "path"))
        answers.write.mode("overwrite").parquet(f"{out}/answers/batch={number}")
        got = spark.read.schema(answers.schema).parquet(f"{out}/answers/batch={number}")
        results = got.select(F.col("path").alias("rel"), "status", F.lit(0).cast("long").alias("ms"), "error")
        entries = batch.fan_out_duplicates(marked, results).join(marked.select("rel", "sha"), "rel").unionByName(old)
        entries.select("rel", "status", "sha", "error", "cached", "duplicate_of").write.mode("overwrite").json(f"{out}/log/batch={number}")
        shas = marked.where("duplicate_of IS NULL").select("rel", F.col("sha").alias("key"))
        done.put(shas.join(results.where("status = 'done'").select("rel"), "rel").withColumnRenamed("rel", "first_rel"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
