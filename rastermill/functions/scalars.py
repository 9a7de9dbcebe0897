"""Column functions used by the operators; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions and their media types.
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "bmp")
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif"}
#: Part of every fingerprint; a new version makes old cache entries miss.
PROMPT_VERSION = 1


def round_half_up(value: Column) -> Column:
    """Rounds .5 towards plus infinity, unlike Spark's round."""
    return F.floor(value + F.lit(0.5)).cast("int")


def content_hash(content: Column) -> Column:
    """First 32 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 32)


def fingerprint(params: Column) -> Column:
    """16 hex digits that do not depend on the order of the map's keys."""
    keys = F.array_sort(F.map_keys(params))
    pairs = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(params, k), F.lit(""))))
    text = F.concat_ws("\x01", F.concat(pairs, F.array(F.lit(f"promptVersion={PROMPT_VERSION}"))))
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(digest: Column, print_: Column) -> Column:
    return F.concat_ws("-", digest, print_)


def cache_shard(key: Column) -> Column:
    return F.substring(key, 1, 2)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def media_type(ext: Column, default: str | None = None) -> Column:
    """png, jpeg, webp and gif by extension; anything else is `default` (null: the strict form)."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit(default).cast("string"))


def item_name(rel: Column) -> Column:
    """A name fit for files: letters, digits, CJK, dot and hyphen; at most 60 characters; not unique."""
    base = F.regexp_replace(F.regexp_extract(rel, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(base, r"^\.+", ""), r"[^A-Za-z0-9_一-龥.\-]", "_")
    safe = F.substring(F.regexp_replace(safe, r"^[.\-]+$", ""), 1, 60)
    return F.when(F.length(safe) > 0, safe).otherwise(F.lit("image"))


def safe_label(label: Column) -> Column:
    """A label fit for names: 40 characters, others replaced by _, `region` if nothing is left."""
    safe = F.regexp_replace(F.substring(F.coalesce(label, F.lit("")), 1, 40), r"[^A-Za-z0-9_一-龥]", "_")
    return F.when(F.length(safe) > 0, safe).otherwise(F.lit("region"))


def human_ms(ms: Column) -> Column:
    """Milliseconds for people: 640ms, 1.2s, 2m03s, 1h05m; n/a where negative or unknown.

    Tenths of seconds are those nearest to the binary value of the seconds (1.65 is a little less, and
    reads 1.6s); the only values halfway, .25 and .75, go up. Seconds are rounded after minutes are taken
    off, so 119.6 s reads 1m60s.
    """
    s = ms / F.lit(1000.0)
    # format_number rounds the exact binary value, and halves to even.
    tenths = F.when(ms % 500 == 250, F.format_string("%.1f", (F.floor(s * 10) + 1) / 10)).otherwise(F.format_number(s, 1))
    m = F.floor(s / 60).cast("long")
    rest = F.floor((s - m * 60) + 0.5).cast("long")
    return (
        F.when(ms.isNull() | F.isnan(ms.cast("double")) | (ms < 0), F.lit("n/a"))
        .when(ms < 1000, F.format_string("%dms", F.floor(ms + 0.5).cast("long")))
        .when(s < 60, F.concat(tenths, F.lit("s")))
        .when(m < 60, F.format_string("%dm%02ds", m, rest))
        .otherwise(F.format_string("%dh%02dm", F.floor(m / 60).cast("long"), m % 60))
    )


def preview_text(text: Column, longest: int = 600) -> Column:
    """The second paragraph if there is one, else the first, without heading marks, cut at `longest`."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    body = F.coalesce(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)), whole)
    body = F.regexp_replace(body, r"(?m)^#+\s*", "")
    return F.when(F.length(body) > longest, F.concat(F.substring(body, 1, longest), F.lit("…"))).otherwise(body)


#: Fixed value: the collation of file names.
COLLATION = "zh_Hans_CHN"


def by_name(column: str) -> Column:
    """What files are ordered by."""
    return F.collate(F.col(column), COLLATION)


def batch_id(at: Column) -> Column:
    return F.concat(F.lit("batch-"), F.date_format(at, "yyyyMMdd-HHmmss"))
