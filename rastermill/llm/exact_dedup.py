"""Exact deduplication by a log-structured merge index of text digests.

Rows fill memtables; each memtable is flushed as a run of digests, sorted, with one head per
digest (the row that would stay) and a bitmap filter. A digest that no other run's filter knows
and that its own run holds once is settled without a look-up. The others are compacted: runs are
merged, each digest keeping its best head and the sum of its rows. Hits are then verified by the
bytes of the normalised texts, and digests shared by different texts are split.

Everything is DataFrame expressions. Runs hold digests and ids only; of the texts, only hits
move, at most one for each digest and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import BROADCAST_BYTES, saved, text_of

#: ASCII white space, which does not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]"
#: Bits of a filter for each digest of a run: a foreign digest passes in about one of 16 cases.
BITS_PER_KEY = 16
#: Bits in one row of bitmap_construct_agg.
BITS_PER_ROW = 32768


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def position(digest: Column, bits: int) -> Column:
    """Where a digest stands in a filter of so many bits, from 1."""
    return F.pmod(F.xxhash64(digest), F.lit(bits)) + 1


def filter_bits(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // BITS_PER_ROW)) * BITS_PER_ROW


def memtables(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One light row per document: id, code points, digest and the memtable it falls in."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.length(text).cast("long").alias("n"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int").alias("run"),
    )


def flush(entries: DataFrame) -> DataFrame:
    """Sorted runs: one row per run and digest with its head (most code points, then smallest id)."""
    return (
        entries.groupBy("run", "digest")
        .agg(F.min(F.struct((-F.col("n")).alias("less"), "id")).alias("head"), F.count(F.lit(1)).alias("rows"))
        .sortWithinPartitions("run", "digest")
    )


def filters(keys: DataFrame, bits: int, by: list[str]) -> DataFrame:
    """Bitmap filters of the digests: one row of 32768 bits per bucket (and per `by`)."""
    p = position(F.col("digest"), bits)
    return (
        keys.select(*by, F.bitmap_bucket_number(p).alias("bucket"), F.bitmap_bit_position(p).alias("bit"))
        .groupBy(*by, "bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2) == 1


def suspects(runs: DataFrame, bits: int) -> DataFrame:
    """Run entries that may have another row: several in their own run, or known to another run's filter."""
    by_bucket = filters(runs, bits, ["run"]).groupBy("bucket").agg(F.collect_list(F.struct("run", "bitmap")).alias("others"))
    p = position(F.col("digest"), bits)
    probe = runs.withColumn("bucket", F.bitmap_bucket_number(p)).withColumn("bit", F.bitmap_bit_position(p))
    known = F.exists("others", lambda o: (o["run"] != F.col("run")) & is_set(o["bitmap"], F.col("bit")))
    return probe.join(by_bucket, "bucket").where((F.col("rows") > 1) | known).select("run", "digest", "head", "rows")


def compact(runs: DataFrame) -> DataFrame:
    """Merges runs: each digest keeps the least head and the sum of its rows."""
    return runs.groupBy("digest").agg(F.min("head").alias("head"), F.sum("rows").alias("rows"))


def verify(docs: DataFrame, hits: DataFrame, n_hits: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Byte check of the hits: (texts of the hits by digest, digests whose texts differ).

    Texts that no hit's filter knows stay where they are if that filter is small enough to be
    broadcast; beyond that the join on the digest sorts it out alone.
    """
    texts = docs.select(normalised(text_of(text_col)).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    bits = filter_bits(n_hits)
    if bits // 8 <= BROADCAST_BYTES:
        p = position(F.col("digest"), bits)
        texts = (
            texts.withColumn("bucket", F.bitmap_bucket_number(p))
            .withColumn("bit", F.bitmap_bit_position(p))
            .join(F.broadcast(filters(hits, bits, [])), "bucket")
            .where(is_set(F.col("bitmap"), F.col("bit")))
            .select("digest", "norm")
        )
    # One text of each digest and map task is shuffled, whatever the size of the group.
    spread = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    differ = spread.where(F.col("low") != F.col("high")).join(hits.select("digest"), "digest", "left_semi").select("digest")
    return texts, differ


def split_collisions(docs: DataFrame, differ: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows whose digest stands for different texts, grouped by the text itself: id, digest, keep_id, rows."""
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.length(text).cast("long").alias("n"), normalised(text).alias("norm")
    ).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    rows = rows.join(differ, "digest", "left_semi")
    heads = rows.groupBy("digest", "norm").agg(
        F.min(F.struct((-F.col("n")).alias("less"), "id")).alias("head"), F.count(F.lit(1)).alias("rows")
    )
    return rows.join(heads, ["digest", "norm"]).select("id", "digest", F.col("head.id").alias("keep_id"), "rows")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 4) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. Of equal texts the row with the most
    code points stays, then the smallest id. A null text counts as empty, so all empty and blank
    texts form one group. A null id sorts first. Rows repeated with the same id share one decision.
    Texts of any length are compared whole. Other columns, also those named like results, are ignored; an
    empty table gives an empty result.
    """
    entries = saved(memtables(docs, id_col, text_col, runs), "lsm-entries")
    runs_table = saved(flush(entries), "lsm-runs")
    keys = runs_table.count()
    merged = compact(suspects(runs_table, filter_bits(-(-keys // runs)))).where(F.col("rows") > 1)
    hits = saved(merged, "lsm-hits")
    n_hits = hits.count()
    _, differ = verify(docs, hits, n_hits, text_col)
    differ = saved(differ, "lsm-differ")
    groups = hits.select("digest", F.col("head.id").alias("keep_id"), "rows", F.lit(True).alias("hit"))
    out = entries.select("id", "digest").join(groups, "digest", "left")
    out = out.select(
        "id", "digest", F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("rows", F.lit(1).cast("long")).alias("rows")
    )
    if not differ.isEmpty():
        out = out.join(F.broadcast(differ) if differ.count() <= 100_000 else differ, "digest", "left_anti").unionByName(
            split_collisions(docs, differ, id_col, text_col)
        )
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: Checks the same rows in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
