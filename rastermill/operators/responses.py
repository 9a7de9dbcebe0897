"""Model requests and responses: parsing, classification, retry plans, merging of group texts."""

from __future__ import annotations

import gc
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastermill.operators.regions import RECT, RECT_TYPE, valid_rects

# Optional fields that a server may refuse, in the order in which they are looked for.
OPTIONAL_FIELDS = ("detail", "thinking", "reasoning_effort", "stream_options", "response_format")


def json_slice(raw: Column) -> Column:
    """What stands between the first { and the last }."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def _truthy(v: Column, path: str) -> Column:
    """JavaScript truth of a JSON value: null, false, 0 and "" are false."""
    x = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(x)
    text = x.cast("string")
    return F.coalesce(
        F.when(x.isNull() | F.is_variant_null(x), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", F.length(text) > 0)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .otherwise(F.expr("try_cast(0 AS double)") != F.try_variant_get(v, path, "double")),
        F.lit(False),
    )


class _Odd(ValueError):
    """An answer that is read by Spark's JSON functions: not JSON, or with values of kinds that are seldom there."""


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Odd
    return found


def _odd(_: str):
    raise _Odd


_read = json.JSONDecoder(parse_constant=_odd).decode
_read_once = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_odd).decode
_NONE = object()
_KINDS = {dict, list}


def _plain_rects(given) -> tuple[list[tuple], int]:
    """(x0, y0, x1, y1, is_handwrite, label) of each rectangle that valid_rects keeps, and how many keys their objects have."""
    rects, keys = [], 0
    for item in given if type(given) is list else ():
        kind = type(item)
        if kind is dict:
            keys += len(item)
            get = item.get
            four, hand, label = (get("x0", _NONE), get("y0", _NONE), get("x1", _NONE), get("y1", _NONE)), get("isHandwrite"), get("label")
        elif kind is list and len(item) >= 4:
            four, hand, label = item[:4], None, None
        else:
            continue
        out = []
        for v in four:
            kind = type(v)
            if kind is float or kind is int:
                if not -1e15 < v < 1e15:
                    raise _Odd
                out.append(1.0 if v > 1 else 0.0 if v <= 0 else float(v))
            elif v is None:
                out.append(0.0)
            elif v is _NONE or kind in _KINDS or kind is str and not re.search(r"\d", v):
                break
            else:
                raise _Odd
        else:
            if hand is not None and type(hand) is not bool or label is not None and type(label) is not str:
                raise _Odd
            rects.append((*out, hand, label or ""))
    return rects, keys


def _plain_answer(text: str) -> tuple:
    """has_text, text rectangles, interest rectangles and summary of a JSON text."""
    # Within these bounds both readers take the same texts.
    if len(text) > 400 and (len(text) > 1 << 20 or text.count("[") + text.count("{") > 500 or re.search(r"\d{400}", text)) or "\\" in text and re.search(r"\\u[dD]", text):
        raise _Odd
    found = _read(text)
    (ours, n), (others, m) = _plain_rects(found.get("textRegions")), _plain_rects(found.get("interestRegions"))
    if text.count(":") != len(found) + n + m:  # a colon elsewhere, or a key that stands twice in an object
        _read_once(text)
    has, summary = found.get("hasText"), found.get("summary")
    if summary is not None and type(summary) is not str:
        raise _Odd
    return type(has) in _KINDS or bool(has), ours, others, summary or ""


def _rect_lists(lists: list[list[tuple] | None]) -> pa.Array:
    flat = [r for rects in lists if rects for r in rects]
    ends = np.cumsum([0, *(len(rects) if rects else 0 for rects in lists)], dtype=np.int32)
    columns = list(zip(*flat, strict=True)) if flat else [()] * 6
    kinds = [pa.float64()] * 4 + [pa.bool_(), pa.string()]
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*RECT, "is_handwrite", "label"])
    return pa.ListArray.from_arrays(pa.array(ends), rows)


def parse_prechecks(responses: DataFrame) -> DataFrame:
    """image_id, has_text, text_regions, interest_regions, summary, parse_error from the raw answer.

    What can't be parsed is a parse error: no text, no regions, the raw answer as summary. Each answer is
    read once, in Arrow batches; what is odd there (kinds of values that models seldom give, bad JSON) is
    read by Spark's JSON functions, whose many look-ups take some ten times as long, with the same rules.
    """
    kind = responses.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd, out = [], []
            gc.disable()  # nothing here is cyclic, and the collector would walk all answers of the batch
            for raw in batch.column(1).to_pylist():
                first, last = (raw.find("{"), raw.rfind("}")) if raw else (-1, -1)
                unread = None
                if first < 0 or last < first:
                    row = False, None, None, raw or "", True
                else:
                    try:
                        row = *_plain_answer(raw[first : last + 1]), False
                    except (ValueError, RecursionError):
                        unread, row = raw, (False, None, None, "", False)
                odd.append(unread)
                out.append(row)
            gc.enable()
            has, text, interest, summary, bad = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(odd, pa.string()), pa.array(has, pa.bool_()), _rect_lists(text), _rect_lists(interest), pa.array(summary, pa.string()), pa.array(bad, pa.bool_())],
                names=["image_id", "odd", "has_text", "text_regions", "interest_regions", "summary", "parse_error"],
            )

    rows = responses.select("image_id", "raw").mapInArrow(
        run, f"image_id {kind}, odd string, has_text boolean, text_regions {RECT_TYPE}, interest_regions {RECT_TYPE}, summary string, parse_error boolean"
    )
    rows = rows.withColumn("_v", F.when(F.col("odd").isNotNull(), F.try_parse_json(json_slice(F.col("odd")))))
    odd = lambda c, x: F.when(F.col("odd").isNotNull(), x).otherwise(F.col(c)).alias(c)
    bad = F.col("_v").isNull()
    rects = lambda name: valid_rects(F.col("_v"), f"$.{name}")
    return rows.select(
        "image_id",
        odd("has_text", F.when(bad, False).otherwise(_truthy(F.col("_v"), "$.hasText"))),
        odd("text_regions", rects("textRegions")),
        odd("interest_regions", rects("interestRegions")),
        odd("summary", F.when(bad, F.col("odd")).otherwise(F.coalesce(F.try_variant_get(F.col("_v"), "$.summary", "string"), F.lit("")))),
        odd("parse_error", bad),
    )


def parse_tile_results(responses: DataFrame) -> DataFrame:
    """One row per object of a tile answer (a JSON array of id, rect, content, type); bad JSON gives an error row."""
    kind = "array<struct<id:string,rect:array<double>,content:string,type:string>>"
    text = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)\[.*\]", 0)
    rows = responses.select("request_id", F.from_json(text, kind).alias("objects"))
    good = rows.where("objects IS NOT NULL").select("request_id", F.posexplode("objects").alias("pos", "o")).select("request_id", "pos", "o.*", F.lit(None).cast("string").alias("error"))
    bad = rows.where("objects IS NULL").select("request_id", F.lit(0).alias("pos"), *(F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("rect", "array<double>"), ("content", "string"), ("type", "string"))), F.lit("not a JSON array").alias("error"))
    return good.unionByName(bad)


def assistant_text(responses: DataFrame) -> DataFrame:
    """Adds content and empty_reason (business, length, content_filter, reasoning, array, unknown) from the body."""
    v = F.try_parse_json("body")
    rows = responses.withColumn("_v", v)
    get = lambda path, kind="string": F.try_variant_get(F.col("_v"), path, kind)
    is_text = F.coalesce(F.schema_of_variant(get("$.choices[0].message.content", "variant")) == "STRING", F.lit(False))
    content = F.when(is_text, get("$.choices[0].message.content")).otherwise("")
    code = get("$.base_resp.status_code", "double")
    business = get("$.base_resp.status_code", "variant").isNotNull() & ~F.coalesce(code == 0, F.lit(False))
    filled = F.length(F.trim(content)) > 0
    is_array = F.coalesce(F.schema_of_variant(get("$.choices[0].message.content", "variant")).startswith("ARRAY"), F.lit(False))
    finish = get("$.choices[0].finish_reason")
    reason = (
        F.when(business, "business")
        .when(filled, None)
        .when(finish == "length", "length")
        .when(finish == "content_filter", "content_filter")
        .when(F.length(get("$.choices[0].message.reasoning_content")) > 0, "reasoning")
        .when(is_array, "array")
        .otherwise("unknown")
    )
    return rows.withColumn("content", F.when(~business & filled, content).otherwise("")).withColumn("empty_reason", reason).drop("_v")


def error_class(status: Column, body: Column) -> Column:
    """path, rate-limit, server, auth, too-large, token-field, field, client or unknown."""
    body = F.coalesce(body, F.lit(""))
    has = lambda p: body.rlike(f"(?i){p}")
    token = has("max_completion_tokens") | (has("max_tokens") & has("not supported|unsupported|unknown|invalid"))
    return (
        F.when(status.isin(404, 405), "path")
        .when(status == 429, "rate-limit")
        .when(status >= 500, "server")
        .when(status.isin(401, 403), "auth")
        .when(status == 413, "too-large")
        .when((status == 400) & token, "token-field")
        .when((status == 400) & has("|".join(OPTIONAL_FIELDS)), "field")
        .when(status == 400, "client")
        .otherwise("unknown")
    )


def offending_field(status: Column, body: Column) -> Column:
    """The first optional field that a refusal names."""
    cases = F.lit(None).cast("string")
    for f in reversed(OPTIONAL_FIELDS):
        cases = F.when(body.rlike(f"(?i){f}"), f).otherwise(cases)
    return F.when(error_class(status, body) == "field", cases)


def classify_responses(responses: DataFrame) -> DataFrame:
    """Adds kind, retryable and field to failed responses (status, body)."""
    kind = error_class(F.col("status"), F.col("body"))
    return responses.withColumn("kind", kind).withColumn("retryable", F.col("kind").isin("rate-limit", "server")).withColumn("field", offending_field(F.col("status"), F.col("body")))


def retry_plan(attempts: DataFrame, base_tokens: int = 4096) -> DataFrame:
    """What each request does next: done, wait, other-path, switch-token-field, drop-field, more-tokens or fail.

    attempts: request_id, attempt (from 1), status (0: no connection), body, retry_after (seconds),
    empty (the answer had no text). Waits are retry_after if given, else 1, 3 and 9 seconds; a path
    or token field is switched once, up to three fields are dropped, a lost connection is tried
    once more, an empty answer gets base + 4096, then base + 12288 tokens (at most 65536).
    """
    rows = attempts.withColumn("kind", F.when(F.col("status") == 0, "network").when(F.col("status") == 200, F.when(F.col("empty"), "empty").otherwise("ok")).otherwise(error_class(F.col("status"), F.col("body"))))
    count = lambda k: F.count_if(F.col("kind") == k)
    last = lambda c: F.max_by(c, "attempt")
    r = rows.groupBy("request_id").agg(
        last("kind").alias("kind"), last("status").alias("status"), last("body").alias("body"), last("retry_after").alias("retry_after"),
        *(count(k).alias(f"n_{k.replace('-', '_')}") for k in ("path", "token-field", "field", "network", "empty")),
        F.count_if(F.col("status").isin(429, 500, 502, 503, 504)).alias("n_wait"),
    )
    again = F.col("status").isin(429, 500, 502, 503, 504) & (F.col("n_wait") <= 3)
    wait = F.when(F.col("retry_after") > 0, F.col("retry_after").cast("double")).otherwise(F.pow(F.lit(3.0), F.col("n_wait") - 1))
    action = (
        F.when(F.col("kind") == "ok", "done")
        .when(again, "wait")
        .when((F.col("kind") == "path") & (F.col("n_path") == 1), "other-path")
        .when((F.col("kind") == "token-field") & (F.col("n_token_field") == 1), "switch-token-field")
        .when((F.col("kind") == "field") & (F.col("n_field") <= 3), "drop-field")
        .when((F.col("kind") == "network") & (F.col("n_network") == 1), "wait")
        .when((F.col("kind") == "empty") & (F.col("n_empty") <= 2), "more-tokens")
        .otherwise("fail")
    )
    more = F.when(F.col("n_empty") == 1, 4096).otherwise(12288) + base_tokens
    return r.select(
        "request_id",
        "kind",
        action.alias("action"),
        F.when(again, wait).when((F.col("kind") == "network") & (F.col("n_network") == 1), 1.5).alias("wait_s"),
        F.when(action == "more-tokens", F.least(F.lit(65536), more)).cast("int").alias("max_tokens"),
        F.when(action == "drop-field", offending_field(F.col("status"), F.col("body"))).alias("drop_field"),
    )


def group_text(responses: DataFrame, heading: str = "## Group ") -> DataFrame:
    """Batch texts joined by blank lines within a group, groups in order under a heading, per image.

    responses: image_id, group_idx, batch_idx, text.
    """
    groups = responses.groupBy("image_id", "group_idx").agg(F.sort_array(F.collect_list(F.struct("batch_idx", "text"))).alias("bs"))
    block = F.concat(F.lit(heading), (F.col("group_idx") + 1).cast("string"), F.lit("\n"), F.array_join(F.col("bs.text"), "\n\n"))
    rows = groups.select("image_id", "group_idx", block.alias("block")).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("group_idx", "block"))).alias("gs"))
    return rows.select("image_id", F.array_join(F.col("gs.block"), "\n\n").alias("text"))


def build_requests(parts: DataFrame, kind: str, params: dict[str, str] | None = None) -> DataFrame:
    """One row per request: request_id, image_id, kind, group_idx, batch_idx, image_refs in order, detail, params.

    parts: image_id, group_idx, batch_idx, tile_id, ref. A pre-check asks for low detail, all else for the original.
    """
    if kind not in ("precheck", "region", "tiles"):
        raise ValueError("kind must be precheck, region or tiles")
    detail = "low" if kind == "precheck" else "original"
    own = F.create_map(*[F.lit(x) for kv in ({"kind": kind, "detail": detail} | (params or {})).items() for x in kv])
    rows = parts.groupBy("image_id", "group_idx", "batch_idx").agg(F.sort_array(F.collect_list(F.struct("tile_id", "ref"))).alias("rs"))
    return rows.select(
        F.concat_ws("/", F.lit(kind), F.col("image_id").cast("string"), F.col("group_idx").cast("string"), F.col("batch_idx").cast("string")).alias("request_id"),
        "image_id", F.lit(kind).alias("kind"), "group_idx", "batch_idx", F.col("rs.ref").alias("image_refs"), F.lit(detail).alias("detail"), own.alias("params"),
    )


class ModelError(Exception):
    """What a model function raises for a refused or lost request: HTTP status (0: no connection), body, seconds to wait if the server names them."""

    def __init__(self, status: int, body: str = "", retry_after: float | None = None):
        super().__init__(f"HTTP {status}: {body}" if status else body or "no connection")
        self.status, self.body, self.retry_after = status, body, retry_after

    def __reduce__(self):
        return ModelError, (self.status, self.body, self.retry_after)


_ANSWER = (("body", T.StringType()), ("status", T.IntegerType()), ("error", T.StringType()), ("retry_after", T.DoubleType()), ("ms", T.LongType()))


def call_model(requests: DataFrame, fn: Callable[[dict], str], parallel: int | None = None) -> DataFrame:
    """Adds body, status, error, retry_after and ms: fn gets each request as a dict and returns a text.

    A ModelError gives its own status and body, any other exception status 0; both are error rows,
    never a failed task. A request with a number in `due` (seconds of the clock) is not sent before.
    Write the result before using it twice: a recomputed task would call the model again. `parallel`
    caps the calls that run at once.
    """
    schema = T.StructType([*requests.schema.fields, *(T.StructField(n, t) for n, t in _ANSWER)])

    def ask(request: dict) -> tuple:
        for name in ("max_tokens", "due"):  # a column of numbers has NaN where there is none
            if name in request and request[name] != request[name]:
                request[name] = None
        due = request.pop("due", None)
        if due is not None and due > time.time():
            time.sleep(due - time.time())
        start = time.time()
        try:
            out = (str(fn(request)), 200, None, None)
        except ModelError as e:
            out = (e.body, e.status, str(e)[:400], e.retry_after)
        except Exception as e:
            out = (None, 0, str(e)[:400], None)
        return (*out, round((time.time() - start) * 1000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [ask(request) for request in batch.to_dict("records")]
            yield batch.assign(**{n: [r[i] for r in out] for i, (n, _) in enumerate(_ANSWER)})

    rows = requests.repartition(parallel) if parallel else requests
    return rows.mapInPandas(run, schema)


#: What a request may ask for besides its own columns; null or empty at first.
_CHANGES = {"attempt": "int", "other_path": "boolean", "other_token_field": "boolean", "dropped_fields": "array<string>", "max_tokens": "int", "due": "double"}
#: Fixed value: the most attempts that retry_plan's own bounds leave to one request.
ATTEMPTS = 12


def call_with_retries(requests: DataFrame, fn: Callable[[dict], str], path: str, keys: list[str], base_tokens: int = 4096, parallel: int | None = None) -> DataFrame:
    """As call_model, but what retry_plan wants tried again is tried again: requests with body, status, error, ms and n_attempts.

    keys: columns that tell requests apart. Each round asks what is left over, after its wait, and is
    written to `path`/attempt=<n> before the next one is planned, so every attempt is on record and a
    lost executor repeats no call of an earlier round. fn finds in its request how it is to ask this time:
    attempt (from 1), other_path, other_token_field, dropped_fields and max_tokens (null: as at first).
    A round without failures and empty answers costs one look at its rows. ms adds up all attempts. An
    answer that stays empty is an error, and so is the last refusal of a request that is given up.
    """
    path, spark = path.rstrip("/"), requests.sparkSession
    clash = [c for c in requests.columns if c in {*_CHANGES, *(n for n, _ in _ANSWER), "request_id"}]
    if clash:
        raise ValueError(f"columns of the answer: {', '.join(clash)}")
    none = F.array().cast("array<string>")
    # Struct keys keep their types and tell nulls from texts.
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    left = requests.select("*", *((none if n == "dropped_fields" else F.lit(1 if n == "attempt" else False if k == "boolean" else None).cast(k)).alias(n) for n, k in _CHANGES.items()))
    rounds = []
    for n in range(1, ATTEMPTS + 1):
        call_model(left, fn, parallel).write.mode("overwrite").parquet(f"{path}/attempt={n}")
        kinds = T.StructType([*left.schema.fields, *(T.StructField(*x) for x in _ANSWER)])
        rounds.append(spark.read.schema(kinds).parquet(f"{path}/attempt={n}").withColumn("request_id", key))
        asked = rounds[-1]
        empty = F.col("status").eqNullSafe(200) & (F.length(F.trim(F.coalesce("body", F.lit("")))) == 0)
        open_ = asked.where(empty | (F.col("status") != 200))
        if open_.isEmpty():
            break
        # All attempts of the requests that are not settled; those of settled ones stay out.
        log = rounds[0].select("request_id", "attempt", "status", "body", "retry_after", empty.alias("empty"))
        for r in rounds[1:]:
            log = log.unionByName(r.select("request_id", "attempt", "status", "body", "retry_after", empty.alias("empty")))
        log = log.join(open_.select("request_id"), "request_id", "left_semi")
        plan = retry_plan(log, base_tokens).where("action NOT IN ('done', 'fail')").withColumnRenamed("max_tokens", "more_tokens")
        now = F.unix_millis(F.current_timestamp()) / 1000
        again = open_.join(plan.select("request_id", "action", "wait_s", "more_tokens", "drop_field"), "request_id")
        left = again.select(
            *requests.columns,
            F.lit(n + 1).alias("attempt"),
            (F.col("other_path") | (F.col("action") == "other-path")).alias("other_path"),
            (F.col("other_token_field") | (F.col("action") == "switch-token-field")).alias("other_token_field"),
            F.array_union(F.coalesce("dropped_fields", none), F.array_compact(F.array("drop_field"))).alias("dropped_fields"),
            F.coalesce("more_tokens", "max_tokens").alias("max_tokens"),
            (now + F.coalesce("wait_s", F.lit(0.0))).alias("due"),
        )
        # The table of what is asked again is written: the clock in `due` is read once.
        left.write.mode("overwrite").parquet(f"{path}/again={n + 1}")
        left = spark.read.schema(left.schema).parquet(f"{path}/again={n + 1}")
        if left.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    error = F.when(F.col("status") != 200, F.coalesce("error", F.lit("no answer"))).when(F.length(F.trim(F.coalesce("body", F.lit("")))) == 0, F.lit("the answer stayed empty"))
    names = requests.columns
    out = out.select(*names, "request_id", "attempt", "body", "status", error.alias("error"), "ms")
    if len(rounds) == 1:
        return out.drop("request_id", "attempt").withColumn("n_attempts", F.lit(1))
    last = out.groupBy("request_id").agg(F.max_by(F.struct(*names, "body", "status", "error"), "attempt").alias("r"), F.sum("ms").alias("ms"), F.max("attempt").alias("n_attempts"))
    return last.select("r.*", "ms", "n_attempts")
