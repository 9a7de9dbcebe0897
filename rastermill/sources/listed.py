"""Files by an exact list: a data source that opens the files of a path table and no others.

The table stands as Parquet on storage that driver and executors share; each of its part files is one
partition, so the driver sees the names of the part files and never the paths in them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rastermill.functions.lineage import scratch_dir

#: Files and bytes of one partition, about.
FILES, BYTES = 1000, 128 << 20
#: Bytes of content in one batch; a larger file is a batch of its own.
BATCH = 16 << 20
#: Storage that is read from Python.
SCHEMES = ("", "file", "s3", "s3a", "gs", "hdfs", "abfs", "abfss")

_FOUND = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def scheme_of(path: str) -> str:
    head, colon, _ = path.partition(":")
    return head.lower() if colon and "/" not in head else ""


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    scheme = scheme_of(path)
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + path.partition(":")[2].lstrip("/") if scheme else path
    return pafs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


class ListedReader(DataSourceReader):
    def __init__(self, table: str):
        self.table = table

    def partitions(self) -> list[InputPartition]:
        fs, root = place(self.table)
        return [InputPartition(i.path) for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith("part-")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = place(self.table)
        rows, held = [], 0
        with fs.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["path"]):
                for path in batch.column(0).to_pylist():
                    try:
                        own, at = place(path)
                        with own.open_input_stream(at) as content:
                            rows.append((path, content.read(), None))
                    except OSError as e:
                        rows.append((path, None, f"can't be read: {e}"[:400]))
                    held += len(rows[-1][1] or b"")
                    if held >= BATCH:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


class ListedFiles(DataSource):
    """Option `table`: the folder of the path table (column path)."""

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return "path string, content binary, error string"

    def reader(self, schema) -> ListedReader:
        return ListedReader(self.options["table"])


def read_listed(files: DataFrame) -> DataFrame:
    """path, content and error of the files of a listing (path, and size if it is known), each opened once.

    A file that can't be read is a row with an error. The listing is written as the path table, in part
    files of about FILES files and BYTES bytes. Storage that Python can't open is read by Spark's own
    reader, by the paths of a part of the table at a time; there a file that is missing fails the read.
    """
    spark = files.sparkSession
    size = F.sum("size") if "size" in files.columns else F.lit(None)
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(size.cast("long"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "path string, content binary, error string")
    parts = min(n, max(spark.sparkContext.defaultParallelism, -(-n // FILES), -(-total // BYTES)))
    table = f"{scratch_dir(spark)}/paths-{uuid.uuid4().hex}"
    paths = files.select("path").repartition(parts, "path")
    paths.write.parquet(table)
    some = files.select("path").first().path
    if scheme_of(table) in SCHEMES and scheme_of(some) in SCHEMES:
        spark.dataSource.register(ListedFiles)
        return spark.read.format("listed_files").option("table", table).load()
    return _by_paths(spark, table)


def _by_paths(spark: SparkSession, table: str) -> DataFrame:
    from rastermill.sources.images import exact

    out = None
    stored = spark.read.schema("path string").parquet(table).withColumn("part", F.input_file_name())
    for part in sorted(r.part for r in stored.select("part").distinct().collect()):
        own = [r.path for r in stored.where(F.col("part") == part).collect()]
        rows = exact(spark.read.format("binaryFile"), own).select("path", "content", F.lit(None).cast("string").alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out
