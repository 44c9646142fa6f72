"""A corpus from documents: five stages, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table;
columns are told by name only as far as a stage reads them (``text``, ``n_chars``, and ``doc_id`` in
the near-duplicate stage), and all but the last stage return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.decontaminate import drop_contaminated
from rasterloom.llm.line_dedup import line_dedup
from rasterloom.llm.near_dedup import near_duplicates
from rasterloom.llm.packing import best_fit_pack
from rasterloom.llm.quality_rules import keep_good
from rasterloom.llm.queries import tokenizer_path
from rasterloom.llm.textbytes import modest_batches
from rasterloom.shared import remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the rules and go; repeated rows and null ids are judged each alone.
    """
    modest_batches(spark)
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars is counted anew.

    Every row counts as a document, repeated ones too.  Rows stay even if no line does; a null text comes out empty.
    """
    modest_batches(spark)
    left = line_dedup(docs, least=10, counts=("_n_lines", "_n_dropped")).drop("_n_lines", "_n_dropped")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (null ids last); texts left empty stay too.

    Of repeated rows one stays.  Rows that share an id but not their text are told apart by the text.
    """
    modest_batches(spark)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("doc_id").isNull() | (F.col("n") > 1))
    if again.isEmpty():
        found = near_duplicates(docs, 85).where("kept").select("doc_id")
        return docs.join(found, "doc_id", "left_semi").select(docs.columns)
    # ids don't tell rows apart: id and text together do, but for exact copies
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    rows = docs.withColumn("_row", row)
    kept = near_duplicates(rows, 85, "_row").where("kept")
    full = rows.join(kept.where("n_shingles > 0").select("_row").distinct(), "_row", "left_semi")
    empty = rows.join(kept.where("n_shingles = 0").select("_row").distinct(), "_row", "left_semi")
    one = full.groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return one.unionAll(empty.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a ten-word window of the benchmark occurs go.

    Null and wordless texts stay, repeated rows share their fate; with an empty benchmark all stay.
    """
    modest_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024.

    A null or empty text is its end token alone; repeated rows and null ids give pieces each. No documents, no pieces.
    """
    modest_batches(spark)
    return best_fit_pack(docs, tokenizer_path(), 1024)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", decontaminate), ("packing", pack)]

#: Neither the tokenizer nor best-fit packing can be told in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's table is deleted as soon as the next one's is written; the last one's stays, as the result reads it."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = shared_dir(spark)
            out.write.parquet(at)
            if read:
                remove(spark, read)
            out, read = spark.read.parquet(at), at
        docs = out
    return docs
