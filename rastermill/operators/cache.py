"""Result cache: keys, look-up with expiry, storing, pruning. cache: shard, key, ts, value, bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.scalars import cache_key, cache_shard, fingerprint


#: Keys of a look-up that may be broadcast.
MOST_KEYS = 300_000


def with_cache_key(rows: DataFrame, digest: str = "sha", params: str = "params") -> DataFrame:
    """Adds key and shard from the content hash and a map of everything the result depends on."""
    return rows.withColumn("key", cache_key(F.col(digest), fingerprint(F.col(params)))).withColumn("shard", cache_shard(F.col("key")))


def _age_ms(ts: str, now: Column) -> Column:
    return F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col(ts).cast("timestamp"))


def cache_lookup(requests: DataFrame, cache: DataFrame, ttl_ms: int | None, now: Column, nonpositive: str = "never") -> DataFrame:
    """Adds hit and cached_value. An entry counts if it has a value and is not older than ttl_ms.

    ttl_ms of None, 0 or less: entries never expire, or always with nonpositive="expired".
    Of several entries of one key the newest counts. A null or empty key never hits. Of the cache only
    the entries of keys that are asked for are grouped; where it is stored in folders by shard, only
    the folders of these keys are read.
    """
    if nonpositive not in ("never", "expired"):
        raise ValueError("nonpositive must be never or expired")
    live = cache.where("value IS NOT NULL")
    if ttl_ms and ttl_ms > 0:
        live = live.where(_age_ms("ts", now) <= ttl_ms)
    elif nonpositive == "expired":
        live = live.where(F.lit(False))
    asked = requests.where("length(key) > 0").select("shard", "key").distinct()
    few = asked.count() <= MOST_KEYS
    live = live.join(F.broadcast(asked) if few else asked, ["shard", "key"], "left_semi")
    newest = live.groupBy("shard", "key").agg(F.max_by("value", "ts").alias("cached_value"))
    rows = requests.join(newest, ["shard", "key"], "left")
    return rows.withColumn("hit", F.col("cached_value").isNotNull())


def ocr_cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_ms: int | None = 48 * 3600 * 1000) -> DataFrame:
    """As cache_lookup, but a ttl of 0 or less expires everything, and the value must hold an array `lines`."""
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(value), '$.lines', 'variant'))")
    return cache_lookup(requests, cache.where(kind.startswith("ARRAY")), ttl_ms, now, "expired")


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The entries after storing the successes (`ok`) among results: the newest of each key."""
    rows = cache.unionByName(results.where("ok").select(cache.columns))
    rest = [c for c in cache.columns if c not in ("shard", "key")]
    best = rows.groupBy("shard", "key").agg(F.max_by(F.struct(*rest), "ts").alias("r"))
    return best.select("shard", "key", *(F.col(f"r.{c}").alias(c) for c in rest)).select(cache.columns)


def write_cache(results: DataFrame, path: str) -> None:
    """Rewrites only the shards that get new successes."""
    spark = results.sparkSession
    new = results.where("ok").drop("ok")
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = new.limit(0)
    touched = old.join(new.select("shard").distinct(), "shard", "left_semi").select(new.columns)
    merged = cache_put(touched, new.withColumn("ok", F.lit(True)))
    # Read before overwriting the same folders: the merged shards are written aside first.
    side = f"{path.rstrip('/')}__new"
    merged.write.mode("overwrite").parquet(side)
    spark.read.schema(merged.schema).parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def cache_prune(cache: DataFrame, ttl_ms: int | None, max_bytes: int, now: Column) -> DataFrame:
    """Adds expired and drop to every entry: expired ones go, then the oldest until at most 90 % of the cap is left.

    A cap of 0 or less means none. An entry goes while what is left without the older ones exceeds the
    target; entries of equal time go in order of key, entries without a time come first and never expire.
    Sums are taken by day, within the one day that the cut falls in by minute, and only the minute of
    the cut is ordered entry by entry, so that no task sees more of the cache than that.
    """
    old = F.coalesce(_age_ms("ts", now) > ttl_ms, F.lit(False)) if ttl_ms and ttl_ms > 0 else F.lit(False)
    at = F.coalesce(F.col("ts").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    rows = cache.withColumn("expired", old).withColumn("_at", at).withColumn("_size", F.coalesce("bytes", F.lit(0)))
    rows = rows.withColumn("_day", F.to_date("_at")).withColumn("_minute", F.date_trunc("minute", "_at"))
    columns = [*cache.columns, "expired"]
    if max_bytes <= 0:
        return rows.select(*columns, F.col("expired").alias("drop"))
    target = F.lit(max_bytes) * 0.9
    live = rows.where("NOT expired")

    def left_after(sums: DataFrame, by: str, start: Column | None) -> DataFrame:
        """What is left before (hi) and after (lo) each group, and the total; one row per day, or per minute of one day."""
        w = Window.orderBy(by)
        total = F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        lo = (total if start is None else start) - F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return sums.select(by, (lo + F.col("_size")).alias("hi"), lo.alias("lo"), total.alias("_total"))

    days = left_after(live.groupBy("_day").agg(F.sum("_size").alias("_size")), "_day", None)
    days = days.select("_day", "hi", "lo", (F.col("_total") > max_bytes).alias("over"))
    cut_here = F.col("over") & (F.col("hi") > target) & (F.col("lo") <= target)
    live = live.join(F.broadcast(days), "_day")
    whole = live.where(~cut_here).select(*columns, (F.col("over") & (F.col("lo") > target)).alias("drop"))
    # At most one day, and of it one minute.
    day = live.where(cut_here).drop("lo", "over")
    minutes = day.groupBy("_minute").agg(F.sum("_size").alias("_size"), F.max("hi").alias("_hi"))
    minutes = left_after(minutes, "_minute", F.max("_hi").over(Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_total")
    day = day.drop("hi").join(F.broadcast(minutes), "_minute")
    cut_minute = (F.col("hi") > target) & (F.col("lo") <= target)
    by_minute = day.where(~cut_minute).select(*columns, (F.col("lo") > target).alias("drop"))
    inside = Window.partitionBy("_minute").orderBy("_at", "key").rowsBetween(Window.unboundedPreceding, -1)
    by_entry = day.where(cut_minute).select(*columns, (F.col("hi") - F.coalesce(F.sum("_size").over(inside), F.lit(0)) > target).alias("drop"))
    gone = rows.where("expired").select(*columns, F.lit(True).alias("drop"))
    return whole.unionByName(by_minute).unionByName(by_entry).unionByName(gone)


def expired_paths(listing: DataFrame, now: Column, prefixes: list[str], exclude: list[str] = (), ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Artifacts to delete: base name with a known prefix, older than ttl_ms, not at or below an excluded path.

    listing: path, mtime. Deleting is up to the caller.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    known = F.lit(False)
    for p in prefixes:
        known = known | name.startswith(p)
    out = F.lit(False)
    for p in exclude:
        p = p.rstrip("/")
        out = out | (F.col("path") == p) | F.col("path").startswith(p + "/")
    return listing.where(known & ~out & (_age_ms("mtime", now) > ttl_ms))
