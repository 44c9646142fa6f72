"""Which documents may be learnt from, and bounded samples of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text.  Fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y, fold) of all labelled ids that aren't held out.

    Null ids and labels are left out; of an id labelled twice the larger label counts.
    """
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    some = some.withColumn("fold", fold(F.col("id"))).where(F.col("fold") != 0)
    return some.groupBy("id", "fold").agg(F.max("y").alias("y")).select("id", "y", "fold")


def sampled_labels(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """``known_labels``: all of them, or the ``most`` with the smallest hashes."""
    return known_labels(labels, label_col, id_col).orderBy(F.xxhash64("id"), "id").limit(most)
