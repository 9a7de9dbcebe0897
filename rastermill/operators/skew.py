"""Joins with a table of one row a key, when a few keys have very many rows on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be broadcast.
MOST_KEYS = 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: str, n: str, how: str = "left") -> DataFrame:
    """rows joined with keyed, which has one row for each key and in `n` how many rows ask for it at most.

    Keys that ask for more than a share of all rows are few, whatever the data: those are broadcast, and
    their rows stay where they are. All other rows are joined by a shuffle in which no key is hot. Rows
    without a key keep out of the join. how: left, or inner, which drops them.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    count, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).first()
    if count <= MOST_KEYS:
        return rows.join(F.broadcast(keyed), on, how)
    # At most MOST_KEYS keys can have more rows than this.
    hot = F.col(n) > total // MOST_KEYS
    first = F.broadcast(keyed.where(hot))
    out = rows.join(first, on, "inner").unionByName(rows.where(F.col(on).isNotNull()).join(first.select(on), on, "left_anti").join(keyed.where(~hot), on, how))
    if how == "left":
        bare = rows.where(F.col(on).isNull())
        for c in out.columns:
            if c not in bare.columns:
                bare = bare.withColumn(c, F.lit(None).cast(out.schema[c].dataType))
        out = out.unionByName(bare)
    return out
