"""Planning, deduplication and state of a resumable batch over a listing of files.

files: rel, size, sha, ... ; log: rel, status, ms, sha, cached, duplicate_of, error, at, seq.
The order of files is that of rel in the collation of scalars.by_name, as in sources.images.scan_images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.lineage import cut_lineage
from rastermill.functions.scalars import by_name, human_ms, preview_text
from rastermill.operators.skew import join_counted


def latest_per_key(log: DataFrame, key: str = "rel", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last record of each key: largest of `order`. Two partial aggregations, no sort of the log."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def in_first(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows by order: each partition keeps its own first n, then they are merged."""
    return rows.orderBy(*order).limit(n)


def with_rank(rows: DataFrame, order: str, name: str = "ord") -> DataFrame:
    """Adds the position (from 1) of each row in the order of a unique column, without one big partition.

    Rows are range-partitioned and sorted once, by collation, and kept so in a checkpoint: range
    bounds are sampled anew by every plan. Each partition then counts on from the rows before it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [by_name(order), F.col(order)]
    numbered = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id"))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = numbered.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    return joined.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_before", "_at")


def plan_batch(files: DataFrame, log: DataFrame, resume: bool = True, limit: int | None = None) -> DataFrame:
    """Adds previous status and label (todo, done, failed or skipped) to every file.

    A file needs work if its last record is not `done`, or always without resume; the first `limit`
    of these are todo, the rest skipped. had_failed marks files whose last record is a failure: they
    are retried. A limit of None, 0 or less means none.
    """
    last = latest_per_key(log).select("rel", F.col("status").alias("previous"))
    rows = files.join(last, "rel", "left").withColumn("had_failed", F.coalesce(F.col("previous") == "failed", F.lit(False)))
    needs = F.lit(True) if not resume else ~F.coalesce(F.col("previous") == "done", F.lit(False))
    if not limit or limit <= 0:
        return rows.withColumn("label", F.when(needs, "todo").otherwise("done"))
    # The first of those that need work: a bounded set, found by a top-n.
    first = in_first(rows.where(needs).select("rel"), limit, [by_name("rel"), F.col("rel")]).withColumn("chosen", F.lit(True))
    rows = rows.join(first, "rel", "left")
    return rows.withColumn("label", F.when(~needs, "done").when(F.col("chosen"), "todo").otherwise("skipped")).drop("chosen")


def pending(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose last record is not `done`."""
    return files.join(latest_per_key(log).where("status = 'done'").select("rel"), "rel", "left_anti")


def split_plan(plan: DataFrame) -> dict[str, DataFrame]:
    """The plan's four views; failed overlaps todo and skipped, whose files are retried."""
    return {k: plan.where(F.col("label") == k) for k in ("todo", "done", "skipped")} | {"failed": plan.where("had_failed")}


def dedupe_content(todo: DataFrame) -> DataFrame:
    """Adds duplicate_of: the first file (by rel) with the same sha, null for that one itself. A null or empty sha matches nothing.

    Files are counted by sha where they are read. Only shas of several files meet the files again, those
    of very many by a broadcast, so that a content that most files have is no task of its own.
    """
    named = todo.where(F.length("sha") > 0)
    first = named.groupBy("sha").agg(F.min_by("rel", F.struct(by_name("rel"), "rel")).alias("first_rel"), F.count(F.lit(1)).alias("_files"))
    several = cut_lineage(first.where("_files > 1")).withColumnRenamed("sha", "_sha")
    rows = join_counted(todo.withColumn("_sha", F.when(F.length("sha") > 0, F.col("sha"))), several, "_sha", "_files")
    return rows.withColumn("duplicate_of", F.when(F.col("first_rel") != F.col("rel"), F.col("first_rel"))).select(*todo.columns, "duplicate_of")


def fan_out_duplicates(todo: DataFrame, results: DataFrame) -> DataFrame:
    """Every file of todo with its own or its representative's result; a failed one fails its copies too.

    todo: rel, duplicate_of; results: rel, status, ms, error. Copies are marked cached and take no time.
    Results that very many copies ask for are broadcast to them.
    """
    got = results.select(F.col("rel").alias("source"), "status", "ms", "error")
    asked = todo.select("rel", "duplicate_of", F.coalesce("duplicate_of", "rel").alias("source"))
    shared = cut_lineage(asked.where("duplicate_of IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("_copies")))
    of_copies = got.join(shared, "source")
    own = asked.where("duplicate_of IS NULL").join(got, "source", "left")
    copies = join_counted(asked.where("duplicate_of IS NOT NULL"), of_copies, "source", "_copies").drop("_copies")
    rows = own.unionByName(copies)
    copy = F.col("duplicate_of").isNotNull()
    return rows.select("rel", "status", F.when(copy, F.lit(0)).otherwise(F.col("ms")).cast("long").alias("ms"), copy.alias("cached"), "duplicate_of", "error")


def known_copies(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of files whose content is known, the other files). files: rel, sha; known: sha, first_rel, one row a sha.

    A copy is done, cached and takes no time; a file that is known by its own name is no duplicate.
    """
    rows = files.join(known.select("sha", "first_rel"), "sha", "left")
    found = rows.where("first_rel IS NOT NULL")
    entries = found.select(
        "rel", F.lit("done").alias("status"), F.lit(0).cast("long").alias("ms"), F.lit(True).alias("cached"), F.when(F.col("first_rel") != F.col("rel"), F.col("first_rel")).alias("duplicate_of"), F.lit(None).cast("string").alias("error"), "sha"
    )
    return entries, rows.where("first_rel IS NULL").select(files.columns)


def merge_status(files: DataFrame, results: DataFrame, log: DataFrame) -> DataFrame:
    """rel, status, ms, error of every file: this run's result, else its last record, else pending."""
    now = results.select("rel", F.col("status").alias("s1"), F.col("ms").alias("m1"), F.col("error").alias("e1"))
    old = latest_per_key(log).where(F.col("status").isin("done", "failed")).select("rel", F.col("status").alias("s0"), F.col("ms").alias("m0"), F.col("error").alias("e0"))
    rows = files.select("rel").join(now, "rel", "left").join(old, "rel", "left")
    run = F.col("s1").isNotNull()
    pick = lambda a, b: F.when(run, F.col(a)).otherwise(F.col(b))
    return rows.select("rel", F.coalesce("s1", "s0", F.lit("pending")).alias("status"), pick("m1", "m0").alias("ms"), pick("e1", "e0").alias("error"))


def status_union(history: DataFrame, run: DataFrame) -> DataFrame:
    """The newest record of each file over the log and this run (whose seq must be larger)."""
    return latest_per_key(history.unionByName(run, allowMissingColumns=True))


def attach_answers(status: DataFrame, answers: DataFrame) -> DataFrame:
    """Fills in the stored answer of done rows that have none. status: rel, status, answer."""
    stored = answers.select("rel", F.col("answer").alias("stored"))
    rows = status.join(stored, "rel", "left")
    return rows.withColumn("answer", F.when(F.col("status") == "done", F.coalesce("answer", "stored")).otherwise(F.col("answer"))).drop("stored")


def batch_stats(status: DataFrame, results: DataFrame) -> DataFrame:
    """One row: counts by state over all files, and count, time, cache hits and copies of this run."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    a = status.agg(F.count(F.lit(1)).alias("total"), *(count(F.col("status") == s).alias(s) for s in ("done", "failed", "pending")))
    b = results.agg(
        F.count(F.lit(1)).alias("run_count"),
        F.coalesce(F.sum(F.expr("try_cast(ms AS bigint)")), F.lit(0)).cast("long").alias("run_ms"),
        count(F.col("cached")).alias("cache_hits"),
        count(F.col("duplicate_of").isNotNull()).alias("duplicates"),
    )
    return a.crossJoin(b)  # one row each


def failure_digest(status: DataFrame, n: int = 10) -> DataFrame:
    """The first n failures by rel, their messages cut to 120 characters."""
    rows = status.where("status = 'failed'").select("rel", F.substring(F.coalesce("error", F.lit("unknown")), 1, 120).alias("error"))
    return in_first(rows, n, [by_name("rel"), F.col("rel")])


def answer_preview(status: DataFrame, n: int = 3, chars: int = 800) -> DataFrame:
    """The first n done rows that have an answer, cut."""
    rows = status.where("status = 'done' AND length(answer) > 0").select("rel", F.substring("answer", 1, chars).alias("answer"))
    return in_first(rows, n, [by_name("rel"), F.col("rel")])


def report_lines(status: DataFrame, results: DataFrame) -> DataFrame:
    """The summary as rows (section, rel, ord, line): head, failures, items.

    Sorted by these columns and joined they are the report; nothing is gathered here, whatever the
    number of files. status: rel, status, ms, sha, cached, duplicate_of, error, answer.
    """
    s = batch_stats(status, results)
    text = lambda *cs: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in cs])
    head = s.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit(0).alias("ord"), text("- Images: ", F.col("total").cast("string"), " (done ", F.col("done").cast("string"), ", failed ", F.col("failed").cast("string"), ", pending ", F.col("pending").cast("string"), ")").alias("line")),
                    F.struct(F.lit(1).alias("ord"), text("- This run: ", F.col("run_count").cast("string"), " in ", human_ms(F.col("run_ms"))).alias("line")),
                    F.when(F.col("cache_hits") > 0, F.struct(F.lit(2).alias("ord"), text("- From cache: ", F.col("cache_hits").cast("string")).alias("line"))),
                    F.when(F.col("duplicates") > 0, F.struct(F.lit(3).alias("ord"), text("- Copies: ", F.col("duplicates").cast("string")).alias("line"))),
                )
            )
        ).alias("x")
    ).select(F.lit(0).alias("section"), F.lit("").alias("rel"), "x.ord", "x.line")
    error = F.coalesce("error", F.lit("unknown"))
    failures = status.where("status = 'failed'").select(
        F.lit(1).alias("section"), "rel", F.lit(0).alias("ord"), text("| `", F.col("rel"), "` | ", F.substring(F.replace(error, F.lit("|"), F.lit("\\|")), 1, 200), " |").alias("line")
    )
    notes = F.concat_ws(
        " · ",
        F.when(F.col("ms") > 0, human_ms(F.col("ms"))),
        F.when(F.col("cached"), F.lit("cached")),
        F.when(F.length("sha") > 0, text("`", F.substring("sha", 1, 12), "`")),
        F.when(F.length("duplicate_of") > 0, text("same as `", F.col("duplicate_of"), "`")),
    )
    body = (
        F.when((F.col("status") == "done") & (F.length("answer") > 0), preview_text(F.col("answer")))
        .when(F.col("status") == "failed", text("> error: ", F.substring(error, 1, 400)))
        .otherwise("> pending")
    )
    items = status.select(
        F.lit(2).alias("section"),
        "rel",
        F.posexplode(F.array(text("### [", F.col("status"), "] ", F.col("rel")), notes, body)).alias("ord", "line"),
    )
    return head.unionByName(failures).unionByName(items.select("section", "rel", "ord", "line"))


def full_report(status: DataFrame) -> DataFrame:
    """The done rows with an answer, numbered from 1 by rel: n, rel, block. No such row, no rows."""
    rows = with_rank(status.where("status = 'done' AND length(answer) > 0").select("rel", "answer"), "rel", "n")
    return rows.select("n", "rel", F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), "rel", F.lit("\n\n"), F.trim("answer"), F.lit("\n\n---\n")).alias("block"))


def report_json(status: DataFrame) -> DataFrame:
    """One JSON object per item."""
    fields = [c for c in ("rel", "status", "ms", "sha", "cached", "duplicate_of", "error") if c in status.columns]
    return status.select("rel", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"))
