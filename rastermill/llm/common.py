"""What the operators of this subpackage share: inputs, the shared folder, written tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose measured size is at most this many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a new temporary folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        path = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="rastermill-"))
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def pick(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids: by broadcast if the ids' counted size allows it, else by a shuffled join."""
    ids = saved(ids, "ids")
    small = ids.count() * 64 <= BROADCAST_BYTES
    return rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not among ids (one column, id_col); as pick does it."""
    ids = saved(ids.distinct(), "ids")
    small = ids.count() * 64 <= BROADCAST_BYTES
    return rows.join(F.broadcast(ids) if small else ids, id_col, "left_anti")


#: What a Python worker keeps from task to task, one thing at a time.
_resident: dict = {}


def resident(key, make):
    """The worker's own make(), made once; what another operator left there is dropped first."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Drops what other operators left in this worker, and returns what Arrow keeps of it."""
    if _resident:
        _resident.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
