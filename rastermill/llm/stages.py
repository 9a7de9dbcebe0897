"""The operators as filters over documents: each keeps rows whole, with all their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm import exact_dedup, near_dedup
from rastermill.llm.common import without


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of equal texts the row that exact_dedup keeps; of rows repeated whole, one.

    Ids name documents: rows that share an id share the decision. Rows without an id are kept. Null, empty
    and blank texts are one text; texts of any length are compared whole. All columns are kept, whatever
    their names; an empty table stays one.
    """
    found = exact_dedup.exact_dedup(docs, id_col, text_col)
    kept = without(docs, found.where(~F.col("kept")).select(id_col), id_col)
    again = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
    if again.isEmpty():
        return kept
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]).select(kept.columns)
    return kept.join(again, id_col, "left_anti").select(kept.columns).unionByName(once)


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every near-duplicate class, the one of smallest id, with all its columns.

    Rows that share an id share the decision; rows without an id are kept. Null, empty and very long
    texts, repeated rows and empty tables are treated as near_classes does.
    """
    classes = near_dedup.near_classes(docs, id_col, text_col)
    return without(docs, classes.where(F.col(id_col) != F.col("class_id")).select(id_col), id_col)
