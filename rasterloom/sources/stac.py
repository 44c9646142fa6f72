"""STAC items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMON_NAMES = ("coastal", "blue", "green", "red", "rededge", "yellow", "pan", "nir", "nir08", "nir09", "cirrus", "swir16", "swir22", "lwir", "lwir11", "lwir12")
ITEM = "struct<id:string,assets:map<string,struct<href:string,`eo:bands`:array<struct<common_name:string>>>>>"


def items(spark: SparkSession, path: str) -> DataFrame:
    """One row (``json``) per item file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def assets(items: DataFrame, accepted: Sequence[str] = COMMON_NAMES) -> DataFrame:
    """(item, common_name, asset, href): assets with exactly one band that has an accepted common name; the last of a name counts."""
    parsed = items.select(F.from_json("json", ITEM).alias("i"))
    each = parsed.select(F.col("i.id").alias("item"), F.posexplode(F.map_entries("i.assets")).alias("place", "e"))
    band = F.col("e.value.`eo:bands`")
    one = each.where(F.size(band) == 1).select("item", "place", F.lower(F.get(band, F.lit(0))["common_name"]).alias("common_name"), F.col("e.key").alias("asset"), F.col("e.value.href").alias("href"))
    last = one.where(F.col("common_name").isin(*accepted)).groupBy("item", "common_name").agg(F.max_by(F.struct("asset", "href"), "place").alias("a"))
    return last.select("item", "common_name", "a.*")


def select_bands(found: DataFrame, requested: Sequence[str]) -> DataFrame:
    """The requested assets, ``band`` counting from 1 in the order asked for; names are compared in lower case."""
    names = [n.lower() for n in requested]
    places = F.create_map(*(x for n in dict.fromkeys(names) for x in (F.lit(n), F.array(*(F.lit(k + 1) for k, m in enumerate(names) if m == n)))))
    return found.where(F.col("common_name").isin(*names)).withColumn("band", F.explode(places[F.col("common_name")]))


def checked_bands(found: DataFrame, requested: Sequence[str]) -> DataFrame:
    """``select_bands``, with ValueError for a name that no COMMON_NAMES has and KeyError for one that an item lacks."""
    if not requested:
        raise ValueError("no bands were requested")
    if unknown := [n for n in requested if n.lower() not in COMMON_NAMES]:
        raise ValueError(f"no common names: {unknown}")
    out = select_bands(found, requested)
    short = out.groupBy("item").agg(F.count_distinct("common_name").alias("n")).where(F.col("n") < len({n.lower() for n in requested})).limit(1).collect()
    if short or out.isEmpty():
        raise KeyError(f"not all of {list(requested)} are assets" + (f" of {short[0]['item']}" if short else ""))
    return out
