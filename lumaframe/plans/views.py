"""Image, frame, point, box and polygon inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(e):
    return F.least(F.greatest(e.cast("double") * 0.5 + 0.5, F.lit(0.0)), F.lit(1.0))


def img8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a gray 8x8 image."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", _unit).alias("data"))


def img8rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three embeddings in a row as one RGB 8x8 image; an incomplete last group is left out."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 3).cast("long").alias("image_id"), (F.col("vec_id") % 3).cast("int").alias("ch"), F.transform("embedding", _unit).alias("plane"))
    rows = e.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ch", "plane"))).alias("p")).filter(F.size("p") == 3)
    return rows.select("image_id", F.lit(3).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.flatten(F.transform("p", lambda p: p["plane"])).alias("data"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as the rows of one image as high as the table is long, as pixels; a missing row is black."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode(F.transform("embedding", _unit)).alias("x", "v"))
    return e.select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("ch"), F.col("y").cast("int").alias("y"), "x", "v")


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours (r, g, b) from line items, distinct."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    li = table(spark, sf_dir, "lineitem")
    return li.select(clamp(F.col("l_quantity") / 50).alias("r"), clamp(F.col("l_discount") * 10).alias("g"), clamp(F.col("l_tax") * 12.5).alias("b")).distinct()


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes (group_id, seq, x, y, width, height, score) of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order))
    return li.select(F.col("l_orderkey").alias("group_id"), "seq", (F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 100).alias("y"), F.col("l_quantity").cast("long").alias("width"), (F.col("l_linenumber") * 5).cast("long").alias("height"), (F.col("l_discount") * 10).alias("score"))


def polys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon points (group_id, seq, x, y) of orders with three lines or more."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    every = Window.partitionBy("l_orderkey")
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order)).withColumn("k", F.count("*").over(every)).filter("k >= 3")
    return li.select(F.col("l_orderkey").alias("group_id"), "seq", F.col("l_quantity").alias("x"), F.round(F.col("l_extendedprice") / 1000).alias("y"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`polys` with the points of a polygon as one array (one shuffle)."""
    p = polys(spark, sf_dir).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return p.select("group_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video of a 24x32 frame per day: events by hour and user, as a share of the largest count."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    cells = e.groupBy(day.alias("day"), F.hour("ts").alias("y"), (F.col("user_id") % 32).cast("int").alias("x")).agg(F.count("*").alias("n"))
    top = cells.agg(F.max("n").alias("top"), F.min("day").alias("first"))
    dense = cells.crossJoin(F.broadcast(top)).groupBy("day", "first").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * 32 + F.col("x")).alias("i"), (F.col("n") / F.col("top")).alias("v")))).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(24 * 32 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    index = (F.col("day") - F.col("first")).cast("long")
    return dense.select(F.lit(0).cast("long").alias("video_id"), index.alias("index"), (index * 40_000).alias("pts_us"), F.lit(40_000).cast("long").alias("duration_us"), (index % 30 == 0).alias("is_keyframe"), F.lit(1).alias("c"), F.lit(24).alias("h"), F.lit(32).alias("w"), data.alias("data"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements (track_id, seq, z) of a user's events in time order."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.col("value").alias("z"))
