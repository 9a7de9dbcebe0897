"""A table of the last record of each key: a snapshot, what was added since, and a pointer to both.

Records stand in folders by shard (the first two signs of the key), so a look-up reads the shards that
it asks for. Generation g has the snapshot `base/gen=g` (none for 0) and the additions `delta/gen=g/part=n`;
`pointer` names the last generation whose snapshot is complete. Nothing that was written is touched, but
for a batch or a snapshot that is written again after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.operators.batch import latest_per_key

#: Keys of a look-up that may be broadcast.
MOST_KEYS = 300_000


class KeyedTable:
    """columns: the schema of the values; a record is key, the values and batch (the larger one counts)."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"key string, {columns}"
        self.names = [c.split()[0] for c in self.schema.split(", ")]

    def generation(self) -> int:
        try:
            return self.spark.read.schema("gen int").json(f"{self.path}/pointer").agg(F.max("gen")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def _part(self, folder: str, partitions: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{self.schema}, batch long, {partitions}").parquet(folder)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def records(self, gen: int, but: int | None = None) -> DataFrame:
        """All records of a generation with their shard: of the snapshot and of the batches since, but for one of these."""
        columns = [*self.names, "batch", "shard"]
        out = self.spark.createDataFrame([], f"{self.schema}, batch long, shard string")
        base = self._part(f"{self.path}/base/gen={gen}", "shard string")
        delta = self._part(f"{self.path}/delta/gen={gen}", "shard string")
        if base is not None:
            out = out.unionByName(base.select(columns))
        if delta is not None:
            out = out.unionByName((delta if but is None else delta.where(F.col("batch") != but)).select(columns))
        return out

    def lookup(self, asked: DataFrame, but: int | None = None) -> DataFrame:
        """The last record of each key in asked (column key). Batch `but` does not count: it is being written again.

        Only the shards that are asked for are read, and of them only these keys are shuffled.
        """
        keys = asked.where("length(key) > 0").select("key").distinct().withColumn("shard", F.substring("key", 1, 2))
        few = keys.count() <= MOST_KEYS
        found = self.records(self.generation(), but).join(F.broadcast(keys) if few else keys, ["shard", "key"], "left_semi")
        return latest_per_key(found.select(*self.names, "batch"), "key", ("batch",)).select(*self.names, "batch")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Adds the records of a batch; the same batch written again replaces them. Rows without a key are left out."""
        rows = rows.where("length(key) > 0").select(self.names).withColumns({"batch": F.lit(batch).cast("long"), "shard": F.substring("key", 1, 2)})
        rows.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/delta/gen={self.generation()}/part={batch}")

    def compact(self, below: int | None = None) -> None:
        """A new generation: the last record of each key, without batches from `below` on."""
        gen = self.generation()
        rows = self.records(gen)
        rows = rows if below is None else rows.where(F.col("batch") < below)
        last = latest_per_key(rows.select(*self.names, "batch"), "key", ("batch",)).withColumn("shard", F.substring("key", 1, 2))
        last.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/base/gen={gen + 1}")
        self.spark.range(1).select(F.lit(gen + 1).alias("gen")).coalesce(1).write.mode("append").json(f"{self.path}/pointer")
