"""Line deduplication: lines that stand in many documents are dropped from all of them.

Lines are exploded with their position and normalised to keys; keys are counted by 128 bits of
hash, each document giving a key once, so that a line in a third of all documents is summed where
it is read and shuffled once a task. Keys over the threshold meet the exploded lines again; what
comes back to a document are the positions to drop, and the other lines are put together in order
of position. Texts move at most once, beside the positions; lines never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import BROADCAST_BYTES, saved, text_of

#: ASCII white space, which does not count at the ends of a line.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes that a key, or a document's entry without its positions, takes in a broadcast table.
ENTRY_BYTES = 64


def keys_of(text: Column) -> Column:
    """The keys of a text's lines, in order: the lines without white space at their ends, A-Z in lower case.

    The bytes are read as Latin-1 and lower-cased there. This also maps the lead bytes C3 to DE of other
    characters to E3 to FE, always in the same way; as the bytes that follow a lead byte are kept, their
    number tells the two apart, so that keys are equal only where the lines are.
    """
    folded = F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))
    return F.transform(F.split(folded, "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def counts(key: Column, min_chars: int) -> Column:
    """Whether a key has min_chars code points or more: its bytes but for those that follow a lead byte."""
    if min_chars < 2:
        return F.length(key) >= min_chars
    return F.length(F.translate(key, "".join(map(chr, range(0x80, 0xC0))), "")) >= min_chars


def hashed(*parts: Column) -> list[Column]:
    """Two columns of 64 bits, which no two of 10^12 different values share but by a chance of 1 in 10^14."""
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the key of a row: rows that share it are the same in both."""
    text = text_of(text_col)
    k1, k2 = hashed(F.col(id_col), text)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))


def common_keys(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """h1, h2, n_docs of the keys that stand in min_docs documents or more."""
    keys = rows.select(F.explode(F.array_distinct(keys_of(F.col("text")))).alias("key")).where(counts(F.col("key"), min_chars))
    return keys.select(*hashed(F.col("key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dropped_positions(rows: DataFrame, common: DataFrame, min_chars: int) -> DataFrame:
    """k1, k2, dropped: the positions (from 0) of each row's common lines; rows without one are left out."""
    lines = rows.select("k1", "k2", F.posexplode(keys_of(F.col("text"))).alias("pos", "key")).where(counts(F.col("key"), min_chars))
    keyed = lines.select("k1", "k2", "pos", *hashed(F.col("key")))
    small = common.count() * ENTRY_BYTES <= BROADCAST_BYTES
    # A hot line makes one side of the join skewed; the other has one row a key, so that side can be split.
    found = keyed.join(F.broadcast(common) if small else common, ["h1", "h2"], "left_semi")
    return found.groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row per document: id, text (what is left of it), n_lines (before), n_dropped.

    A text is split at line feeds. A line's key is the line without ASCII white space at its ends, A-Z in
    lower case. Lines whose key has min_chars code points or more and stands in min_docs documents or more
    go, all of them, in every document; the others stay as they are, joined by line feeds. A line that is
    repeated in one document counts once for it. A null text counts as empty and has one empty line; a
    blank line has the empty key and stays unless min_chars is 0. Every row is a document of its own:
    repeated rows, and rows without an id, count each and give a row each. Texts of any length are read
    whole. Other columns, also those named like results, are ignored; an empty table gives none.
    """
    if min_docs < 1 or min_chars < 0:
        raise ValueError("min_docs must be 1 or more, min_chars 0 or more")
    rows = _documents(docs, id_col, text_col)
    common = saved(common_keys(rows, min_docs, min_chars).select("h1", "h2"), "common-lines")
    dropped = saved(dropped_positions(rows, common, min_chars), "dropped-lines")
    n, positions = dropped.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()
    small = n * ENTRY_BYTES + positions * 8 <= BROADCAST_BYTES
    # Split before the join, so that the lines are a column there and not an expression that a lambda repeats.
    split = rows.select("id", "k1", "k2", F.split("text", "\n").alias("lines"))
    both = split.join(F.broadcast(dropped) if small else dropped, ["k1", "k2"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return both.select(
        F.col("id").alias(id_col),
        text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


#: Checks the digests of the kept texts in DuckDB.
SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c USING (key) GROUP BY doc_id
"""
