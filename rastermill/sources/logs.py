"""Progress log with snapshots, tiles and reports on disk."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.operators import batch

LOG = "rel string, status string, ms long, sha string, cached boolean, duplicate_of string, error string, at string, seq long"


NAMES = [f.split()[0] for f in LOG.split(", ")]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the JSON lines below a path; other lines, and those whose rel is not a JSON string, are skipped."""
    try:
        # Lines may stand in folders of any depth, beside loose files.
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)
    rows = lines.select("value", F.try_parse_json("value").alias("v")).where(F.schema_of_variant(F.try_variant_get("v", "$.rel", "variant")) == "STRING")
    kinds = [f.split()[1] for f in LOG.split(", ")]
    return rows.select(*(F.try_variant_get("v", f"$.{n}", k).alias(n) for n, k in zip(NAMES, kinds, strict=True)))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The last record of every rel in a log of JSON lines (by at, then seq).

    Lines that are not JSON, or whose rel is not a JSON string, are skipped. No log gives no rows.
    """
    return batch.latest_per_key(_records(spark, path), "rel", ("at", "seq")).select(NAMES)


def append_index(entries: DataFrame, path: str) -> None:
    """Appends one JSON line for each entry; nothing that was written is touched."""
    entries.write.mode("append").json(path)


class ProgressLog:
    """A log of which a run reads a snapshot and what was appended since, not all that was ever written.

    Generation g has the snapshot `<path>_snapshots/gen=g` (none for 0) and the lines in `<path>/gen=g`; those
    that stand loose in `path` belong to generation 0. `<path>_snapshots/pointer` names the last generation
    whose snapshot is complete, so a snapshot that was not finished does not count and is written again.
    Lines are never removed: read_index over `path` still gives the same rows. One run writes at a time.
    """

    #: A tail of so many rows, and half of the snapshot's, is folded into a new snapshot; or one of so many files.
    LEAST_ROWS, MOST_FILES = 100_000, 500

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generation(self) -> int:
        try:
            return self.spark.read.schema("gen int").json(f"{self.path}_snapshots/pointer").agg(F.max("gen")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def _tail(self, gen: int) -> str:
        return f"{self.path}/gen={gen}" if gen else self.path

    def _snapshot(self, gen: int) -> DataFrame:
        if not gen:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}_snapshots/gen={gen}")

    def read(self) -> DataFrame:
        """The last record of every rel, as read_index gives it."""
        gen = self.generation()
        rows = self._snapshot(gen).unionByName(_records(self.spark, self._tail(gen)))
        return batch.latest_per_key(rows, "rel", ("at", "seq")).select(NAMES)

    def append(self, entries: DataFrame) -> None:
        append_index(entries, f"{self.path}/gen={self.generation()}")

    def compact(self) -> None:
        """A new generation, whose snapshot is what read() gives."""
        gen = self.generation() + 1
        self.read().write.mode("overwrite").parquet(f"{self.path}_snapshots/gen={gen}")
        self.spark.range(1).select(F.lit(gen).alias("gen")).coalesce(1).write.mode("append").json(f"{self.path}_snapshots/pointer")

    def compact_if_long(self) -> bool:
        """Compacts once the tail is long beside the snapshot, so that all snapshots together cost a small multiple of the log."""
        gen = self.generation()
        try:
            lines = self.spark.read.option("recursiveFileLookup", "true").text(self._tail(gen))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False
        files = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        n, rows = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        long = n > self.MOST_FILES or rows >= max(self.LEAST_ROWS, self._snapshot(gen).count() // 2)
        if long:
            self.compact()
        return long


def write_tiles(tiles: DataFrame, path: str, buckets: int = 64) -> None:
    """Tile rows with their bytes, in folders by a hash of the image."""
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")
    tiles.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_reports(status: DataFrame, results: DataFrame, path: str) -> None:
    """Rebuilds the three reports: summary and full text as lines in order, items as JSON lines. All are written at once."""
    path = path.rstrip("/")

    def summary() -> None:
        lines = batch.report_lines(status, results)
        lines.repartitionByRange("section", "rel", "ord").sortWithinPartitions("section", "rel", "ord").select("line").write.mode("overwrite").text(f"{path}/summary")

    def full() -> None:
        # Blocks come out of with_rank in order, in the partitions they are to be written in.
        batch.full_report(status).select("block").write.mode("overwrite").text(f"{path}/full")

    def items() -> None:
        batch.report_json(status).select("item").write.mode("overwrite").text(f"{path}/items")

    def counts() -> None:
        batch.batch_stats(status, results).write.mode("overwrite").json(f"{path}/stats")

    with ThreadPoolExecutor(4) as pool:
        for job in [pool.submit(f) for f in (summary, full, items, counts)]:
            job.result()
