from pyspark.sql import functions as F

from rastermill.functions import scalars as S
from rastermill.operators import batch, cache, responses, skew

LOG = "rel string, status string, ms long, sha string, error string, seq int"


def test_plan(spark):
    files = spark.createDataFrame([(r, r) for r in "abcde"], "rel string, sha string")
    log = spark.createDataFrame([("a", "failed", 1, "", None, 0), ("a", "done", 1, "", None, 1), ("b", "failed", 1, "", "x", 1)], LOG)
    label = lambda **k: {r.rel: r.label for r in batch.plan_batch(files, log, **k).collect()}
    assert label() == {"a": "done", "b": "todo", "c": "todo", "d": "todo", "e": "todo"}
    assert label(limit=2) == {"a": "done", "b": "todo", "c": "todo", "d": "skipped", "e": "skipped"}
    assert label(limit=0) == label() and set(label(resume=False).values()) == {"todo"}
    assert label(resume=False, limit=1)["a"] == "todo"
    assert sorted(r.rel for r in batch.pending(files, log).collect()) == list("bcde")
    views = batch.split_plan(batch.plan_batch(files, log, limit=2))
    assert [r.rel for r in views["failed"].collect()] == ["b"]
    assert views["todo"].unionByName(views["skipped"]).unionByName(views["done"]).select("rel").exceptAll(files.select("rel")).isEmpty()


def test_duplicates_share_the_fate_of_their_first(spark):
    files = spark.createDataFrame([("x1", "s"), ("x2", "s"), ("y", "t"), ("e1", ""), ("e2", "")], "rel string, sha string")
    todo = batch.dedupe_content(files)
    assert {r.rel: r.duplicate_of for r in todo.collect()} == {"x1": None, "x2": "x1", "y": None, "e1": None, "e2": None}
    results = spark.createDataFrame([("x1", "failed", 5, "boom"), ("y", "done", 7, None)], "rel string, status string, ms long, error string")
    got = {r.rel: r for r in batch.fan_out_duplicates(todo, results).collect()}
    assert got["x2"].status == "failed" and got["x2"].cached and got["x2"].ms == 0 and got["y"].ms == 7


def test_merge_and_stats(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "rel string")
    results = spark.createDataFrame([("a", "failed", 5, "e", True, None)], "rel string, status string, ms long, error string, cached boolean, duplicate_of string")
    log = spark.createDataFrame([("a", "done", 1, "", None, 1), ("b", "done", 2, "", None, 1)], LOG)
    status = batch.merge_status(files, results, log)
    assert {r.rel: r.status for r in status.collect()} == {"a": "failed", "b": "done", "c": "pending"}
    s = batch.batch_stats(status, results).first()
    assert (s.total, s.done, s.failed, s.pending, s.run_count, s.run_ms, s.cache_hits, s.duplicates) == (3, 1, 1, 1, 1, 5, 1, 0)
    lines = [r.line for r in batch.report_lines(status.withColumn("sha", F.lit("abc")).withColumn("cached", F.lit(False)).withColumn("duplicate_of", F.lit(None).cast("string")).withColumn("answer", F.lit("one\n\n# two")), results).orderBy("section", "rel", "ord").collect()]
    assert lines[0].startswith("- Images: 3") and "two" in lines and "> pending" in lines
    full = batch.full_report(status.withColumn("answer", F.lit(" x "))).collect()
    assert [(r.n, r.rel) for r in full] == [(1, "b")]


def test_rank_over_partitions(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id")).alias("rel")).repartition(7)
    got = [(r.rel, r.ord) for r in batch.with_rank(df, "rel").orderBy("rel").collect()]
    assert [o for _, o in got] == list(range(1, 1001))


def test_scalars(spark):
    cases = [(None, "n/a"), (-1, "n/a"), (640, "640ms"), (1234, "1.2s"), (1650, "1.6s"), (1750, "1.8s"), (1250, "1.3s"), (2250, "2.3s"), (1050, "1.1s"), (1150, "1.1s"), (59949, "59.9s"), (59950, "60.0s"), (999, "999ms"), (119600, "1m60s"), (123000, "2m03s"), (3900000, "1h05m")]
    df = spark.createDataFrame([c[:1] for c in cases], "ms long")
    assert [r[0] for r in df.select(S.human_ms(F.col("ms"))).collect()] == [c[1] for c in cases]
    names = spark.createDataFrame([("a/b c.png",), ("..x.jpg",), ("...",), ("图像-1.png",), ("d/" + "x" * 80 + ".gif",)], "rel string")
    assert [r[0] for r in names.select(S.item_name(F.col("rel"))).collect()] == ["b_c", "x", "image", "图像-1", "x" * 60]
    text = spark.createDataFrame([("# h\n\nbody",), ("only",), ("",), (None,), ("x" * 700,)], "t string")
    assert [r[0] for r in text.select(S.preview_text(F.col("t"))).collect()] == ["body", "only", "", "", "x" * 600 + "…"]
    half = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (2.4,)], "v double")
    assert [r[0] for r in half.select(S.round_half_up(F.col("v"))).collect()] == [1, 2, 0, 2]


def test_fingerprint_ignores_order(spark):
    q = lambda *kv: spark.range(1).select(S.fingerprint(F.create_map(*map(F.lit, kv)))).first()[0]
    assert q("model", "m", "baseURL", "u") == q("baseURL", "u", "model", "m") != q("model", "m", "baseURL", "v")


def test_cache(spark):
    rows = [("aa", "k1", "2024-01-01 00:00:00", "v1", 2000), ("aa", "k2", "2024-01-02 00:00:00", None, 2000), ("bb", "k3", "2024-01-02 12:00:00", '{"lines": [1]}', 2000)]
    c = spark.createDataFrame(rows, "shard string, key string, ts string, value string, bytes long").withColumn("ts", F.to_timestamp("ts"))
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    ask = spark.createDataFrame([("aa", "k1"), ("aa", "k2"), ("bb", "k3"), ("zz", "k4")], "shard string, key string")
    hits = lambda df: sorted(r.key for r in df.where("hit").collect())
    day = 86_400_000
    assert hits(cache.cache_lookup(ask, c, day, now)) == ["k3"]
    assert hits(cache.cache_lookup(ask, c, 0, now)) == hits(cache.cache_lookup(ask, c, -1, now)) == hits(cache.cache_lookup(ask, c, None, now)) == ["k1", "k3"]
    assert hits(cache.ocr_cache_lookup(ask, c, now)) == ["k3"] and hits(cache.ocr_cache_lookup(ask, c, now, 0)) == []
    drop = lambda ttl, cap: {r.key: r["drop"] for r in cache.cache_prune(c, ttl, cap, now).collect()}
    assert drop(None, 10_000) == {"k1": False, "k2": False, "k3": False}
    assert drop(None, 5000) == {"k1": True, "k2": False, "k3": False}
    assert drop(None, 3000) == {"k1": True, "k2": True, "k3": False}
    assert drop(day, 10_000) == {"k1": True, "k2": False, "k3": False}
    new = spark.createDataFrame([("aa", "k1", "2024-02-01 00:00:00", "v9", 1, True), ("cc", "k9", "2024-02-01 00:00:00", "x", 1, False)], "shard string, key string, ts string, value string, bytes long, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    assert {r.key: r.value for r in cache.cache_put(c, new).collect()} == {"k1": "v9", "k2": None, "k3": '{"lines": [1]}'}


def test_error_classes(spark):
    cases = [(404, "", "path"), (405, "", "path"), (429, "", "rate-limit"), (503, "", "server"), (401, "", "auth"), (413, "", "too-large"), (400, "Use Max_Completion_Tokens", "token-field"), (400, "max_tokens is unsupported", "token-field"), (400, "max_tokens", "client"), (400, "bad detail thinking", "field"), (400, None, "client"), (302, "", "unknown")]
    df = spark.createDataFrame([c[:2] for c in cases], "status int, body string")
    got = responses.classify_responses(df).collect()
    assert [r.kind for r in got] == [c[2] for c in cases] and got[9].field == "detail"


def test_assistant_text(spark):
    bodies = ['{"choices":[{"message":{"content":"hi"}}]}', '{"base_resp":{"status_code":1}}', '{"base_resp":{"status_code":0},"choices":[{"message":{"content":"ok"}}]}', '{"choices":[{"finish_reason":"content_filter","message":{}}]}', "{}", None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [(r.content, r.empty_reason) for r in responses.assistant_text(df).collect()]
    assert got == [("hi", None), ("", "business"), ("ok", None), ("", "content_filter"), ("", "unknown"), ("", "unknown")]


def test_retry_plan(spark):
    rows = [("w", 1, 429, "", 7.0, False), ("x", 1, 500, "", None, False), ("x", 2, 503, "", None, False), ("y", 1, 200, "", None, True), ("y", 2, 200, "", None, True), ("z", 1, 0, "", None, False), ("p", 1, 404, "", None, False), ("p", 2, 404, "", None, False), ("d", 1, 200, "x", None, False), ("f", 1, 400, "bad detail", None, False)]
    df = spark.createDataFrame(rows, "request_id string, attempt int, status int, body string, retry_after double, empty boolean")
    got = {r.request_id: r for r in responses.retry_plan(df).collect()}
    assert (got["w"].action, got["w"].wait_s) == ("wait", 7.0) and (got["x"].action, got["x"].wait_s) == ("wait", 3.0)
    assert (got["y"].action, got["y"].max_tokens) == ("more-tokens", 16384) and got["z"].wait_s == 1.5
    assert got["p"].action == "fail" and got["d"].action == "done" and got["f"].drop_field == "detail"


def test_model_errors_are_rows(spark):
    def fn(request):
        if request["k"] == 2:
            raise RuntimeError("no")
        return f"r{request['k']}"

    got = {r.k: (r.body, r.status, r.error) for r in responses.call_model(spark.createDataFrame([(1,), (2,)], "k int"), fn).collect()}
    assert got == {1: ("r1", 200, None), 2: (None, 0, "no")}


def test_expired_paths(spark):
    rows = [("/t/vision-1", 48), ("/t/vision-2", 1), ("/t/other", 48), ("/t/keep/vision-3", 48)]
    df = spark.createDataFrame(rows, "path string, age int").withColumn("mtime", F.expr("timestamp'2024-01-10 00:00:00' - make_interval(0,0,0,0,age)"))
    got = cache.expired_paths(df, F.lit("2024-01-10 00:00:00").cast("timestamp"), ["vision-"], ["/t/keep"]).collect()
    assert [r.path for r in got] == ["/t/vision-1"]


def test_ranks_of_many_rows(spark):
    """More rows than the sampling of range bounds sees, in shuffled order, with another column."""
    n = 400_000
    rows = spark.range(n).select(F.lpad((F.col("id") * 7919 % n).cast("string"), 7, "0").alias("rel"), (F.col("id") * 7919 % n).alias("k"))
    got = batch.with_rank(rows, "rel")
    assert got.columns == ["rel", "k", "ord"]
    assert got.where("ord <> k + 1").count() == 0 and got.agg(F.countDistinct("ord")).first()[0] == n


def test_names_are_ordered_by_collation(spark):
    names = ["b.png", "B.png", "a.png", "Ä.png", "z.png", "中.png", "阿.png"]
    rows = spark.createDataFrame([(n,) for n in names], "rel string")
    by_rank = [r.rel for r in sorted(batch.with_rank(rows, "rel").collect(), key=lambda r: r.ord)]
    assert by_rank == [r.rel for r in batch.in_first(rows, 7, [batch.by_name("rel")]).collect()]
    assert by_rank.index("a.png") < by_rank.index("b.png") < by_rank.index("B.png") < by_rank.index("z.png")
    same = spark.createDataFrame([("B.png", "s"), ("a.png", "s"), ("x.png", "")], "rel string, sha string")
    assert {r.rel: r.duplicate_of for r in batch.dedupe_content(same).collect()} == {"B.png": "a.png", "a.png": None, "x.png": None}


def _pruned(rows, ttl, cap, now):
    """The definition, entry by entry: rows of (key, seconds or None, bytes)."""
    gone = {k for k, t, _ in rows if ttl and ttl > 0 and t is not None and (now - t) * 1000 > ttl}
    left = sum(b for k, _, b in rows if k not in gone)
    if cap > 0 and left > cap:
        for k, _, b in sorted((r for r in rows if r[0] not in gone), key=lambda r: (r[1] if r[1] is not None else -1, r[0])):
            if left <= cap * 0.9:
                break
            gone.add(k)
            left -= b
    return gone


def test_cache_prune_equals_definition(spark):
    import random

    rng = random.Random(3)
    for case in range(4):
        spread = (40, 3600, 86_400, 20 * 86_400)[case]
        rows = [(f"k{i:03d}", None if rng.random() < 0.05 else 1_700_000_000 + rng.randrange(spread), rng.randrange(0, 50)) for i in range(150)]
        df = spark.createDataFrame(rows, "key string, s long, bytes long").select("key", F.timestamp_seconds("s").alias("ts"), "bytes")
        for ttl, cap in ((None, 1000), (10 * 86_400_000, 700), (0, 10**9), (spread * 500, 1), (None, 0), (None, -5)):
            got = cache.cache_prune(df, ttl, cap, F.timestamp_seconds(F.lit(1_700_000_000 + spread))).collect()
            assert len(got) == 150 and {r.key for r in got if r["drop"]} == _pruned(rows, ttl, cap, 1_700_000_000 + spread), (case, ttl, cap)


def test_a_hot_content_is_no_task_of_its_own(spark, monkeypatch):
    """One content in nine of ten files, empty and null ones: broadcast for the hot, a shuffled join for the rest, same rows."""
    rows = [(f"r{i:05d}", "hot" if i % 10 else ["", None, "a", "b", f"u{i}"][i // 10 % 5]) for i in range(5000)]
    files = spark.createDataFrame(rows, "rel string, sha string").repartition(8)
    first = {}
    for r, s in rows:
        if s:
            first.setdefault(s, r)
    want = {r: first[s] if s and first[s] != r else None for r, s in rows}
    for most in (skew.MOST_KEYS, 2):
        monkeypatch.setattr(skew, "MOST_KEYS", most)
        todo = batch.dedupe_content(files)
        got = todo.collect()
        assert {r.rel: r.duplicate_of for r in got} == want and len(got) == 5000 and todo.columns == ["rel", "sha", "duplicate_of"]
        results = todo.where("duplicate_of IS NULL").select("rel", F.lit("done").alias("status"), F.lit(3).cast("long").alias("ms"), F.lit(None).cast("string").alias("error"))
        spread = batch.fan_out_duplicates(todo, results).collect()
        assert len(spread) == 5000 and {r.status for r in spread} == {"done"} and all(r.cached == (want[r.rel] is not None) for r in spread)
        sizes = todo.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 2500


def test_cache_lookup_reads_the_shards_that_are_asked_for(spark, tmp_path):
    entries = spark.range(2000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 2).alias("shard"), F.md5(F.col("id").cast("string")).alias("key"), F.current_timestamp().alias("ts"), F.col("id").cast("string").alias("value"), F.lit(1).cast("long").alias("bytes"))
    entries.write.partitionBy("shard").parquet(str(tmp_path / "cache"))
    stored = spark.read.parquet(str(tmp_path / "cache"))
    asked = entries.where("id IN (3, 5)").select("shard", "key").unionByName(spark.createDataFrame([("zz", "zz"), (None, None), ("", "")], "shard string, key string"))
    got = cache.cache_lookup(asked, stored, None, F.current_timestamp())
    assert sorted(r.cached_value or "" for r in got.collect()) == ["", "", "", "3", "5"]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
