"""Rasters, masks and polygons read out of ordinary tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.geometry import box
from rasterloom.operators.infer import LinearSoftmax

MODEL = LinearSoftmax(((1.0, -0.5), (-0.7, 0.9), (0.2, 0.3)), (0.1, 0.0, -0.1), centred=True)
#: The same with weights for all bands of ``bands16``.
MODEL4 = LinearSoftmax(((1.0, -0.5, 0.4, 0.3), (-0.7, 0.9, -0.2, 0.6), (0.2, 0.3, 0.8, -0.4)), (0.1, 0.0, -0.1), centred=True)
#: Half the patch size of the registered queries.
S = 8
IMAGE = (1000, 800)
TRANSFORM = (0.5, 0.0, 733601.0, 0.0, -0.5, 3725139.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bands16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixels of a four-band raster, 16 wide: (raster_id, y, x, band, v)."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("pos", "v"))
    return emb.select(F.lit("emb").alias("raster_id"), "y", (F.col("pos") % 16).alias("x"), (F.expr("pos div 16") + 1).cast("int").alias("band"), F.col("v").cast("double").alias("v"))


def height(spark: SparkSession, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]) + 1


def cube64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-band cube, 64 wide, of values to one decimal: each vector and its reverse."""
    emb = table(spark, sf_dir, "embeddings")
    pair = F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
    rows = emb.select(F.col("vec_id").cast("int").alias("y"), F.posexplode(pair).alias("x", "p"))
    one = lambda c: F.round(c.cast("double"), 1)
    size = {"height": F.lit(height(spark, sf_dir)), "width": F.lit(64)}
    return rows.select(F.lit("emb").alias("raster_id"), *(v.alias(k) for k, v in size.items()), "y", "x", F.array(one(F.col("p.a")), one(F.col("p.b"))).alias("bands"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class mask (raster_id, y, x, cls) from lineitem, classes 0 to 4, 64 wide."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"), "l_linenumber")
    return li.groupBy("y", "x").agg((F.sum("l_linenumber") % 5).cast("short").alias("cls")).select(F.lit("li").alias("raster_id"), "y", "x", "cls")


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in pixel coordinates (feature_id, status, price, x0, y0, x1, y1, rings) from orders."""
    o = table(spark, sf_dir, "orders")
    x0, y0 = (F.col("o_orderkey") % 1100 - 50).cast("double"), (F.col("o_custkey") % 900 - 40).cast("double")
    w, h = (F.col("o_orderkey") % 37 + 10).cast("double"), (F.col("o_custkey") % 23 + 5).cast("double")
    out = o.select(F.col("o_orderkey").alias("feature_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"))
    return out.withColumn("rings", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right triangles with a rectangular hole's worth of variety: (feature_id, rings) from orders."""
    r = rectangles(spark, sf_dir)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return r.select("feature_id", "x0", "y0", "x1", "y1", F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x0", "y1"), p("x0", "y0"))).alias("rings"))
