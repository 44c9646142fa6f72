"""The queries over whole tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import quality_model, toxicity
from rasterloom.llm.decontaminate import search_benchmark
from rasterloom.llm.line_dedup import line_dedup
from rasterloom.llm.near_dedup import near_duplicates
from rasterloom.llm.oracles import ORACLE_SQL  # noqa: F401
from rasterloom.llm.packing import best_fit_pack
from rasterloom.llm.quality_rules import quality_rules
from rasterloom.shared import shared_dir
from rasterloom.llm.substring_dedup import substring_dedup
from rasterloom.llm.textbytes import modest_batches
from rasterloom.llm.url_filter import rules_frame, url_filter
from rasterloom.llm.warc import round_trip

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality_model.quality_scores(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC capture, then read back and assembled."""
    return digests_of(round_trip(spark, table(spark, sf_dir, "pages"), shared_dir(spark)))


def digests_of(captures: DataFrame) -> DataFrame:
    """The digest columns of nested captures: from the response, its metadata record, and the first line of its request."""
    digest = F.regexp_extract("response.payload_digest", "^sha256:(.*)$", 1)
    stated = F.when(F.col("response.type") == "revisit", F.regexp_extract(F.col("metadata.block").cast("string"), "payload-bytes: ([0-9]+)", 1).try_cast("long"))
    number = lambda c: F.regexp_extract(c, "^urn:capture:(-?[0-9]+):response$", 1).try_cast("long")
    return captures.select(
        number("record_id").alias("page_id"),
        F.coalesce(stated, "response.payload_length").alias("payload_bytes"),
        F.when(F.col("response.type") == "revisit", digest).otherwise(F.col("response.payload_sha256")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number("response.refers_to").alias("refers_to"),
        F.regexp_extract(F.col("request.block").cast("string"), "^GET (.*) HTTP/1.1\r\n", 1).alias("requested"),
        F.col("n_requests").cast("long").alias("n_requests"),
        F.col("n_metadata").cast("long").alias("n_metadata"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's ten-word windows in every document."""
    found = search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty-byte strings found in an earlier document are removed from all later ones."""
    return substring_dedup(table(spark, sf_dir, "documents"), with_kept=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages under the five rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 1024."""
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path(), 1024, with_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules' figures and verdict for every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more are dropped from all of them."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_quality_model, op3_warc, op4_decontaminate, op5_suffix_array_dedup, op6_url_filter, op7_best_fit_packing, op8_quality_rules, op9_line_dedup, op10_near_dedup)}
