import base64
import json

import numpy as np
from image_fixtures import image_rows, png
from pyspark.sql import functions as F

from rastermill.operators import responses
from rastermill.plans import recognise
from rastermill.plans.recognise import ocr_parts, recognise_images, run_batch
from rastermill.sources import images as sources
from rastermill.sources import listed, logs
from rastermill.sources.keyed import KeyedTable
from rastermill.streaming import arrivals


def _tree(folder):
    for name in ("a.png", "b.jpg", "c.txt", ".hidden.png", "sub/d.webp", "sub/e.PNG", "sub/deep/f.gif"):
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(name))


def test_scan(spark, tmp_path):
    _tree(tmp_path)
    rels = lambda **k: sorted(r.rel for r in sources.scan_images(spark, str(tmp_path), **k).collect())
    assert rels() == ["a.png", "b.jpg"]
    assert sorted(rels(recursive=True)) == ["a.png", "b.jpg", "sub/d.webp", "sub/deep/f.gif", "sub/e.PNG"]
    assert rels(pattern="*.PNG") == ["a.png"] and rels(max_files=1) == ["a.png"]
    assert sources.scan_images(spark, str(tmp_path / "none")).count() == 0
    assert sources.parse_pattern("*.png;*.jpg") == ["png", "jpg"] and len(sources.parse_pattern(";;")) == 6


def test_sizes_and_bad_files(spark, tmp_path):
    (tmp_path / "ok.png").write_bytes(png(np.zeros((7, 13, 3))))
    (tmp_path / "broken.png").write_bytes(b"text")
    rows = {r.rel: r for r in sources.load_images(spark, str(tmp_path)).collect()}
    assert (rows["ok.png"].width, rows["ok.png"].height, rows["ok.png"].error) == (13, 7, None) and rows["broken.png"].error
    files = sources.with_content(sources.scan_images(spark, str(tmp_path)))
    got = {r.rel: (r.width, r.height) for r in sources.image_sizes(files).collect()}
    assert got == {"ok.png": (13, 7), "broken.png": (None, None)}


def test_read_index(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [{"rel": "a", "status": "failed", "seq": 1}, {"rel": "a", "status": "done", "seq": 2}, {"rel": 5, "status": "done"}, {"rel": "b", "status": "done", "seq": 1, "ms": 3}]
    (tmp_path / "log/x.json").write_text("\n".join(json.dumps(x) for x in lines) + "\nbroken {\n")
    got = {r.rel: r.status for r in logs.read_index(spark, str(tmp_path / "log")).collect()}
    assert got == {"a": "done", "b": "done"} and logs.read_index(spark, str(tmp_path / "no")).count() == 0


def _functions():
    """The stand-ins for model and OCR, as closures: they travel to the workers by value."""

    def answer(request):
        return f"seen {len(request.get('image_refs', []))} {request.get('kind')}"

    def precheck(request):
        return json.dumps({"hasText": True, "textRegions": [[0, 0, 0.5, 0.5]], "interestRegions": [{"x0": 0.5, "y0": 0.5, "x1": 1, "y1": 1, "label": "spot"}], "summary": f"{request['width']} wide"})

    return answer, precheck


def test_snapshots_of_the_log(spark, tmp_path):
    path = str(tmp_path / "index")
    log = logs.ProgressLog(spark, path)
    assert log.read().count() == 0 and not log.compact_if_long()
    (tmp_path / "index").mkdir()
    (tmp_path / "index/old.jsonl").write_text('{"rel": "old", "status": "done", "seq": 1}\nnot json\n{"rel": 5}\n{"rel": "a", "status": "failed", "seq": 0}\n')
    write = lambda *rows: log.append(spark.createDataFrame(rows, "rel string, status string, seq long, error string"))
    last = lambda rows: sorted((r.rel, r.status, r.seq, r.error) for r in rows.collect())
    write(("a", "done", 3, None), ("b", "failed", 3, "no"))
    want = [("a", "done", 3, None), ("b", "failed", 3, "no"), ("old", "done", 1, None)]
    assert last(log.read()) == last(logs.read_index(spark, path)) == want
    log.compact()
    assert log.generation() == 1 and last(log.read()) == want
    # An older record that comes late does not win over one in the snapshot; a newer one does.
    write(("a", "failed", 2, "late"), ("b", "done", 4, None), ("c", "done", 4, None))
    want = [("a", "done", 3, None), ("b", "done", 4, None), ("c", "done", 4, None), ("old", "done", 1, None)]
    assert last(log.read()) == last(logs.read_index(spark, path)) == want
    # What was folded is not read again: neither files of generation 0 nor their lines.
    read = log.read().inputFiles()
    assert read and not any("gen=0" in f or "old.jsonl" in f for f in read)
    # A snapshot without a pointer to it does not count and is written again.
    spark.createDataFrame([], logs.LOG).write.parquet(f"{path}_snapshots/gen=2")
    assert log.generation() == 1 and last(log.read()) == want
    log.LEAST_ROWS = 3
    assert log.compact_if_long() and log.generation() == 2 and last(log.read()) == want and not log.compact_if_long()
    log.MOST_FILES = 0
    write(("d", "done", 5, None))
    assert log.compact_if_long() and log.generation() == 3 and len(last(log.read())) == 5


def test_batch_end_to_end_and_resume(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    rng = np.random.default_rng(2)
    one = png(rng.integers(0, 255, (60, 90, 3)))
    for name, data in (("x1.png", one), ("x2.png", one), ("y.png", png(rng.integers(0, 255, (100, 50)))), ("bad.png", b"text")):
        (src / name).write_bytes(data)
    fns = {"precheck": _functions()[1], "ocr": lambda r: "line one", "model": lambda r: f"about {r['kind']}"}
    got = {r.rel: r for r in run_batch(spark, str(src), out, "pipeline", fns).collect()}
    assert {k: r.status for k, r in got.items()} == {"x1.png": "done", "x2.png": "done", "y.png": "done", "bad.png": "failed"}
    assert got["x2.png"].answer == got["x1.png"].answer and "90 wide" in got["x1.png"].answer and "### spot" in got["x1.png"].answer

    def never(request):
        raise AssertionError("called again")

    calls = {k: never for k in fns}
    assert got["bad.png"].error == "not an image that can be decoded" and all(r.ms >= 0 for r in got.values())
    (src / "bad.png").unlink()
    opened, exact, hashed, listed = [], sources.exact, [], sources.read_listed
    monkeypatch.setattr(sources, "exact", lambda reader, places: opened.append(sorted(p.rsplit("/", 1)[1] for p in places)) or exact(reader, places))
    monkeypatch.setattr(sources, "read_listed", lambda files: hashed.append(sorted(r.path.rsplit("/", 1)[1] for r in files.collect())) or listed(files))
    again = {r.rel: r for r in run_batch(spark, str(src), out, "pipeline", calls).collect()}
    assert opened == hashed == []  # with nothing to do no file is opened
    assert {r.status for r in again.values()} == {"done"} and again["y.png"].answer == got["y.png"].answer
    forced = {r.rel: r for r in run_batch(spark, str(src), out, "pipeline", calls, resume=False).collect()}
    assert {r.status for r in forced.values()} == {"done"} and forced["y.png"].cached
    assert hashed == [["x1.png", "x2.png", "y.png"]] and opened == []  # hashed, but not decoded
    (src / "new.png").write_bytes(png(rng.integers(0, 255, (40, 40))))
    more = {r.rel: r for r in run_batch(spark, str(src), out, "pipeline", fns).collect()}
    assert more["new.png"].status == "done" and hashed[1:] == opened == [["new.png"]]
    assert (tmp_path / "out/reports/summary").exists()


def test_run_retries_and_says_what_failed(spark, tmp_path, monkeypatch):
    """Refusals of several kinds, in waves of one image: what can be tried again is, the rest keeps its message."""
    src = tmp_path / "in"
    src.mkdir()
    rng = np.random.default_rng(4)
    for name in ("busy", "path", "field", "auth"):
        (src / f"{name}.png").write_bytes(png(rng.integers(0, 255, (30, 40))))
    monkeypatch.setattr(recognise, "WAVE", 1)

    def model(request):
        from rastermill.operators.responses import ModelError

        name, n = request["image_id"].split(".")[0], request["attempt"]
        if name == "busy" and n < 3:
            raise ModelError(429, "slow down", 0.05)
        if name == "path" and not request["other_path"]:
            raise ModelError(404, "no such path")
        if name == "field" and "thinking" not in request["dropped_fields"]:
            raise ModelError(400, "unknown field thinking")
        if name == "auth":
            raise ModelError(401, "no key")
        return f"{name} read at attempt {n}"

    got = {r.rel: r for r in run_batch(spark, str(src), str(tmp_path / "out"), "full", {"model": model}).collect()}
    assert {k: r.status for k, r in got.items()} == {"busy.png": "done", "path.png": "done", "field.png": "done", "auth.png": "failed"}
    assert "attempt 3" in got["busy.png"].answer and "attempt 2" in got["path.png"].answer and got["auth.png"].error == "HTTP 401: no key"
    log = {r.rel: r for r in logs.read_index(spark, str(tmp_path / "out/index")).collect()}
    assert log["auth.png"].error == "HTTP 401: no key" and log["busy.png"].status == "done"


def test_retries(spark, tmp_path):
    def fn(r):
        import time as clock

        from rastermill.operators.responses import ModelError

        k, n = r["k"], r["attempt"]
        if k == "busy" and n <= 2:
            raise ModelError(429, "slow down", 0.3)
        if k in ("path", "path2") and (k == "path2" or not r["other_path"]):
            raise ModelError(404, "not here")
        if k == "token" and not r["other_token_field"]:
            raise ModelError(400, "use max_completion_tokens")
        if k == "field" and set(r["dropped_fields"]) != {"thinking", "detail"}:
            raise ModelError(400, "unknown " + ("thinking" if n == 1 else "detail"))
        if k == "auth":
            raise ModelError(401, "no key")
        if k == "empty":
            return "long" if (r["max_tokens"] or 0) >= 4096 + 12288 else " "
        if k == "mute":
            return ""
        if k is None:
            raise ValueError("lost")
        return f"{n} {clock.time()}"

    df = spark.createDataFrame([(k,) for k in ("fine", "busy", "path", "path2", "token", "field", "auth", "empty", "mute", None)], "k string")
    path = str(tmp_path / "calls")
    got = {r.k: r for r in responses.call_with_retries(df, fn, path, ["k"]).collect()}
    assert {k: r.n_attempts for k, r in got.items()} == {"fine": 1, "busy": 3, "path": 2, "path2": 2, "token": 2, "field": 3, "auth": 1, "empty": 3, "mute": 3, None: 2}
    assert {k for k, r in got.items() if r.error is None} == {"fine", "busy", "path", "token", "field", "empty"} and got["mute"].error == "the answer stayed empty" and got[None].error == "lost"
    assert float(got["busy"].body.split()[1]) - float(got["fine"].body.split()[1]) > 0.6  # it waited twice
    assert sorted(r.attempt for r in spark.read.parquet(path + "/attempt=*").where("k = 'field'").collect()) == [1, 2, 3]
    assert responses.call_with_retries(df.limit(0), fn, path, ["k"]).count() == 0


def test_exactly_the_listed_files_are_opened(spark, tmp_path):
    """Of many files those that are not listed are gone before the read; it opens the others, in all partitions."""
    src = tmp_path / "in"
    src.mkdir()
    names = [f"f {i}[{i % 7}].png" for i in range(6001)]
    for n in names:
        (src / n).write_bytes(n.encode())
    files = sources.scan_images(spark, str(src)).cache()
    assert files.count() == 6001
    wanted = files.where(F.pmod(F.hash("rel"), F.lit(2)) == 0)
    keep = {r.name for r in wanted.collect()}
    for n in names:
        if n not in keep:
            (src / n).unlink()
    assert listed.read_listed(wanted).rdd.getNumPartitions() == 4
    rows = sources.with_content(wanted).select("name", "content", "sha", "read_error").collect()
    assert {r.name: bytes(r.content) for r in rows} == {n: n.encode() for n in keep} and all(r.sha and not r.read_error for r in rows)
    gone = sources.with_content(files.where(~F.col("name").isin(list(keep))).limit(3)).collect()
    assert len(gone) == 3 and all(r.content is None and r.read_error for r in gone)
    large = sources.with_content(wanted.limit(2), max_bytes=3).collect()
    assert {r.read_error for r in large} == {"file too large"} and sources.with_content(wanted.limit(0)).count() == 0
    files.unpersist()


def test_listed_files_of_other_storage(spark, tmp_path, monkeypatch):
    (tmp_path / "a.png").write_bytes(b"one")
    monkeypatch.setattr(listed, "SCHEMES", ())
    got = sources.with_content(sources.scan_images(spark, str(tmp_path))).collect()
    assert [(r.rel, bytes(r.content)) for r in got] == [("a.png", b"one")]


def test_low_confidence_is_upgraded_and_crops_are_prepared(spark, tmp_path):
    page = np.full((200, 400), 255)
    page[:, :200] = 30
    page[40:160:8, 20:180] = 220
    page[60:62, 240:360] = 0
    # The dark half is inverted and made black and white before OCR; its answer has a low score.
    fns = {
        "precheck": lambda r: json.dumps({"hasText": True, "textRegions": [{"x0": 0, "y0": 0, "x1": 0.5, "y1": 1, "isHandwrite": False}, {"x0": 0.5, "y0": 0, "x1": 1, "y1": 1, "isHandwrite": False}], "summary": "s"}),
        "ocr": lambda r: json.dumps({"lines": [{"text": f"ocr {r['region_idx']}", "score": 0.6 if r["region_idx"] == 0 else 0.95}, {"text": str(sorted(set(base64.b64decode(r["pixels"])))[:3]), "score": 0.7 if r["region_idx"] == 0 else 0.95}]}),
        "model": lambda r: f"{r['kind']} {r['region_idx']}",
    }
    images = image_rows(spark, {"p": page})
    answer = recognise_images(images, fns["precheck"], fns["ocr"], fns["model"], str(tmp_path / "work"), mode="off").first().answer
    assert "### Text 0\nupgrade 0" in answer and "### Text 1\nocr 1" in answer
    said = {r.region_idx: r.text for r in spark.read.parquet(str(tmp_path / "work/ocr")).collect()}
    assert "[0, 255]" in said[0]


def test_plain_and_scored_ocr_answers(spark):
    rows = [("a", 0, "one\n\ntwo", None), ("a", 1, '{"lines": [{"text": "x", "score": 0.5}, {"text": "y"}]}', None), ("a", 2, '{"lines": []}', None), ("a", 3, None, "bad"), ("a", 4, "{not json", None)]
    got = {r.region_idx: (r.text, r.confidence, r.n_lines) for r in ocr_parts(spark.createDataFrame(rows, "image_id string, region_idx int, text string, error string")).collect()}
    assert got == {0: ("one\n\ntwo", 1.0, 2), 1: ("x\ny", 0.5, 2), 2: ("", 1.0, 0), 3: (None, 1.0, 0), 4: ("{not json", 1.0, 1)}


def test_full_grid(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "big.png").write_bytes(png(np.full((900, 1700), 200)))
    got = run_batch(spark, str(src), str(tmp_path / "out"), "full", {"model": _functions()[0]}).first()
    assert got.status == "done" and "seen 6 tiles" in got.answer


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        (src / f"{k}.png").write_bytes(b"same" if k < 2 else b"x%d" % k)
    go = lambda: arrivals.stream_recognise(arrivals.stream_images(spark, str(src), limit=2), lambda df: df.select("path", F.lit("done").alias("status"), F.lit("t").alias("answer"), F.lit(None).cast("string").alias("error")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    log = spark.read.json(str(tmp_path / "out/log"))
    assert log.where("status = 'done'").select("sha").distinct().count() == 3
    n = log.count()
    go()
    assert spark.read.json(str(tmp_path / "out/log")).count() == n
    first = {r.rel.rsplit("/", 1)[1]: r for r in spark.read.json(str(tmp_path / "out/log")).collect()}
    assert n == 4 and {k: bool(r.duplicate_of) for k, r in first.items()} in ({"0.png": a, "1.png": not a, "2.png": False, "3.png": False} for a in (True, False))
    # A copy that comes in a later batch gets its record, from cache.
    (src / "new.png").write_bytes(b"same")
    go()
    log = {r.rel.rsplit("/", 1)[1]: r for r in spark.read.json(str(tmp_path / "out/log")).collect()}
    assert len(log) == 5 and log["new.png"].status == "done" and log["new.png"].cached and log["new.png"].duplicate_of.rsplit("/", 1)[1] in ("0.png", "1.png")


def test_stream_tries_failed_contents_again(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    go = lambda status, **k: arrivals.stream_recognise(arrivals.stream_images(spark, str(src), limit=1), lambda df: df.select("path", F.lit(status).alias("status"), F.lit("t").alias("answer"), F.lit(None).cast("string").alias("error")), out, str(tmp_path / "cp"), **k).awaitTermination()
    for k, (name, status) in enumerate([("a", "failed"), ("b", "done"), ("c", "failed"), ("d", "failed")]):
        (src / f"{name}.png").write_bytes(b"same")
        go(status, compact_every=2)
    log = {r.rel.rsplit("/", 1)[1]: (r.status, r.cached) for r in spark.read.json(f"{out}/log").collect()}
    assert log == {"a.png": ("failed", False), "b.png": ("done", False), "c.png": ("done", True), "d.png": ("done", True)}
    assert KeyedTable(spark, f"{out}/done", "first_rel string").generation() == 1


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "v int")
    asked = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    seen = lambda df: {r.key: r.v for r in df.collect()}
    rows = lambda **kv: spark.createDataFrame([(k, v) for k, v in kv.items()], "key string, v int")
    assert t.lookup(asked("aa1")).count() == 0
    t.put(rows(aa1=1, bb1=2), 0)
    t.put(rows(aa1=3, cc1=4).union(spark.createDataFrame([(None, 1), ("", 2)], "key string, v int")), 1)
    assert seen(t.lookup(asked("aa1", "aa1", "bb1", "zz", None, ""))) == {"aa1": 3, "bb1": 2}
    assert seen(t.lookup(asked("aa1", "cc1"), but=1)) == {"aa1": 1}
    t.put(rows(aa1=5), 1)  # run again
    assert seen(t.lookup(asked("aa1", "cc1"))) == {"aa1": 5}
    t.compact(below=1)
    assert t.generation() == 1 and seen(t.lookup(asked("aa1", "bb1"))) == {"aa1": 1, "bb1": 2}
    t.put(rows(bb1=9), 1)
    t.compact()
    assert t.generation() == 2 and seen(t.lookup(asked("aa1", "bb1"))) == {"aa1": 1, "bb1": 9}
    plan = t.lookup(asked("aa1"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_stream_dedupe_and_counts(spark, tmp_path):
    src = tmp_path / "ev"
    rows = [("a", "done", "2024-01-01 00:00:00"), ("a", "done", "2024-01-01 00:01:00"), ("b", "failed", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "sha string, status string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    read = lambda: spark.readStream.schema("sha string, status string, ts timestamp").parquet(str(src))
    arrivals.stream_dedupe(read(), "ts", "1 hour").writeStream.format("memory").queryName("dd").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sha for r in spark.table("dd").collect()) == ["a", "b"]
    arrivals.stream_status_counts(read()).writeStream.format("memory").queryName("sc").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.status: r.n for r in spark.table("sc").collect()} == {"done": 2, "failed": 1}
