"""Image directories as DataFrames: listing, decoding, sizes from headers.

Spark's file index skips names that begin with _ or a dot; such files are never listed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions.scalars import EXTENSIONS, by_name, content_hash, extension
from rastermill.sources.listed import read_listed

#: Larger files are not read.
MAX_BYTES = 512 << 20


def parse_pattern(pattern: str | None) -> list[str]:
    """Extensions from a text such as `*.png;jpg`; nothing in it: the default set."""
    parts = re.split(r"[;,、\s]+", pattern or "")
    found = [p.removeprefix("*").removeprefix(".").lower() for p in parts if p]
    return [p for p in dict.fromkeys(found) if p] or list(EXTENSIONS)


def _binary(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder if recursive else f"{folder.rstrip('/')}/*")


def _relative(path: Column, folder: str) -> Column:
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/*", ""), f"^{re.escape(root)}/", "")


def scan_images(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = False, max_files: int | None = None) -> DataFrame:
    """rel, path, name, ext, size, mtime of the images in a folder: all, or the first max_files by rel in Chinese collation.

    Only metadata is read; nothing is sorted without a limit. An empty or missing folder gives no rows.
    """
    schema = "rel string, path string, name string, ext string, size long, mtime timestamp"
    try:
        rows = _binary(spark, folder, recursive)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    rows = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).withColumn("ext", extension(F.col("path")))
    rows = rows.where(F.col("ext").isin(parse_pattern(pattern))).withColumn("rel", _relative(F.col("path"), folder)).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    rows = rows.where(~F.col("rel").rlike(r"(^|/)\."))
    if not recursive:
        rows = rows.where(~F.col("rel").contains("/"))
    rows = rows.select("rel", "path", "name", "ext", "size", "mtime")
    return rows if max_files is None else rows.orderBy(by_name("rel"), "rel").limit(max_files)


def drop_oversize(files: DataFrame, max_bytes: int = MAX_BYTES, column: str = "length") -> DataFrame:
    """Adds error to files above max_bytes. Filter on error IS NULL before content is read: the bound is pushed to the scan."""
    return files.withColumn("error", F.when(F.col(column) > max_bytes, F.lit("file too large")).cast("string"))


def exact(reader, places: list[str]) -> DataFrame:
    """Reads files by their exact paths: signs that a pattern would be read from are taken as they are."""
    return reader.load([re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in places])


def with_content(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds content, sha and read_error to a listing (path, size): exactly its files are opened, however many there are.

    A file above max_bytes is not opened and has an error; so has one that can't be read.
    """
    marked = drop_oversize(files, max_bytes, "size").withColumnRenamed("error", "_large")
    read = read_listed(marked.where("_large IS NULL").select("path", "size"))
    found = read.select("path", "content", content_hash(F.col("content")).alias("sha"), F.col("error").alias("_unread"))
    return marked.join(found, "path", "left").withColumn("read_error", F.coalesce("_large", "_unread")).drop("_large", "_unread")


#: JPEG markers that begin a frame (and so hold its size), markers without a length, and those after which no frame can begin.
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
BARE, ENDS = (0x01, *range(0xD0, 0xD8)), (0xD9, 0xDA)
#: Segments before the frame of a JPEG that are walked over; a file with more has no size.
SEGMENTS = 400


def _number(start: Column, n: int) -> Column:
    """n bytes of the content from a place (from 1) as a number; null beyond its end."""
    return F.conv(F.when(F.length("content") >= start + (n - 1), F.hex(F.substring("content", start, F.lit(n)))), 16, 10).cast("int")


def _jpeg_size() -> Column:
    """struct(w, h) of JPEG content: from segment to segment by their lengths, so that a picture inside one (a thumbnail) is passed over."""
    none = F.lit(None).cast("int")
    state = lambda at, w, h, over: F.struct(at.cast("int").alias("at"), w.alias("w"), h.alias("h"), over.alias("over"))
    over = lambda at: state(at, none, none, F.lit(True))

    def step(s: Column, _: Column) -> Column:
        # In an array of one, so that the bytes are read once.
        head = F.array(F.struct(s["at"].alias("at"), _number(s["at"], 1).alias("sign"), _number(s["at"] + 1, 1).alias("mark"), _number(s["at"] + 2, 2).alias("size")))

        def next_(x: Column) -> Column:
            at, mark, size = x["at"], x["mark"], x["size"]
            return (
                F.when(mark.isNull() | (x["sign"] != 0xFF) | mark.isin(*ENDS), over(at))
                .when(mark == 0xFF, state(at + 1, none, none, F.lit(False)))
                .when(mark.isin(*BARE), state(at + 2, none, none, F.lit(False)))
                .when(mark.isin(*FRAMES), state(at, _number(at + 7, 2), _number(at + 5, 2), F.lit(True)))
                .when(size.isNull() | (size < 2), over(at))
                .otherwise(state(at + 2 + size, none, none, F.lit(False)))
            )

        return F.when(s["over"], s).otherwise(F.transform(head, next_)[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), state(F.lit(3), none, none, F.lit(False)), step)


def image_sizes(files: DataFrame) -> DataFrame:
    """Adds width and height from the headers of PNG, GIF, BMP and JPEG content; null for anything else.

    Of a JPEG it is the size of its frame (baseline or progressive), not of a thumbnail in its metadata.
    """

    def number(start: int, n: int, little: bool) -> Column:
        digits = F.hex(F.substring("content", start, n))
        if little:
            digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))))
        return F.conv(digits, 16, 10).cast("int")

    magic = F.hex(F.substring("content", 1, 4))
    png, gif, bmp, jpeg = magic == "89504E47", magic.startswith("474946"), magic.startswith("424D"), magic.startswith("FFD8")
    rows = files.withColumn("_jpeg", F.when(jpeg, _jpeg_size()))
    size = lambda p, g, b, j: F.when(png, number(p, 4, False)).when(gif, number(g, 2, True)).when(bmp, number(b, 4, True)).when(jpeg & (F.col(j) > 0), F.col(j))
    return rows.withColumn("width", size(17, 7, 19, "_jpeg.w")).withColumn("height", size(21, 9, 23, "_jpeg.h")).drop("_jpeg")


def load_images(spark: SparkSession, folder: str, recursive: bool = False, paths: list[str] | None = None) -> DataFrame:
    """rel, width, height, n_channels, data (rows of BGR or BGRA bytes) and error; undecodable files are error rows.

    Of the whole folder, or of the given paths in it (none of them: no rows, and no file is opened).
    """
    if paths == []:
        return spark.createDataFrame([], "rel string, width int, height int, n_channels int, data binary, error string")
    reader = spark.read.format("image").option("dropInvalid", False)
    rows = (reader.option("recursiveFileLookup", str(recursive).lower()).load(folder) if paths is None else exact(reader, paths)).select("image.*")
    bad = F.col("width") < 1
    null = lambda c, t: F.when(~bad, F.col(c)).cast(t)
    return rows.select(
        _relative(F.col("origin"), folder).alias("rel"), null("width", "int").alias("width"), null("height", "int").alias("height"), null("nChannels", "int").alias("n_channels"), F.when(~bad, F.col("data")).alias("data"), F.when(bad, F.lit("not an image that can be decoded")).alias("error")
    )
