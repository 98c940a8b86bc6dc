"""Tables of a data folder, and the rasters, layers, graphs and trajectories that the queries derive from them.

Every derivation uses whole numbers only and grows with its table: one raster a supplier, tiles of rectangles a
block of parts, one road graph a block of orders. Small tables, of which a row becomes or costs much, are dealt to every core first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.sources.shared import spread

SIDE = 16
NODATA = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster_id, band (1-3), r, c, value; sparse; ``NODATA`` marks cells without a measurement."""
    at = [F.col("l_suppkey").alias("raster_id"), (F.col("l_linenumber") % 3 + 1).alias("band"), (F.col("l_orderkey") % SIDE).cast("int").alias("r"), (F.col("l_partkey") % SIDE).cast("int").alias("c")]
    return table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.max("l_quantity").alias("value"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class ids 0-3 of band 1."""
    return cells(spark, sf_dir).where("band = 1").select("raster_id", "r", "c", (F.col("value").cast("int") % 4).alias("value"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense elevations, one raster a supplier."""
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("raster_id")), "raster_id").select("raster_id", F.explode(side).alias("r")).select("raster_id", "r", F.explode(side).alias("c"))
    return grid.withColumn("value", ((F.col("raster_id") * 7 + F.col("r") * F.col("r") * 3 + F.col("c") * 5 + F.col("r") * F.col("c")) % 97).cast("double"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-parallel rectangles in pixels: id, class, x0, y0, x1, y1."""
    key = F.col("p_partkey")
    x0 = key * 31 % 97 + 100 * F.floor(key / 500)
    y0 = key * 7 % 89
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey").select(key.alias("id"), (F.col("p_size") % 3).alias("class"), F.col("p_brand").alias("brand"), x0.alias("x0"), y0.alias("y0"), (x0 + 1 + F.col("p_size") % 9).alias("x1"), (y0 + 1 + F.col("p_size") % 5).alias("y1"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey").select(
        key.alias("id"), F.col("c_name").alias("name"), F.concat(F.col("c_mktsegment"), F.when(key % 3 == 0, ", Shelter").otherwise(", school")).alias("types"),
        ((key * 37 % 1800).cast("double") / 10 - 90).alias("lat"), ((key * 91 % 3600).cast("double") / 10 - 180).alias("lon"),
        (key * 13 % 97 + 100 * F.floor(key / 375)).alias("px"), (key * 29 % 89).alias("py"), F.col("c_acctbal").alias("population"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), "s_suppkey").select(key.alias("id"), F.col("s_name").alias("name"), (key * 17 % 97 + 100 * F.floor(key / 25)).alias("px"), (key * 41 % 89).alias("py"), F.abs(F.floor("s_acctbal")).alias("need"), F.col("s_nationkey").alias("region"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph, u < v, length (whole), damaged; the shortest of parallel edges, damaged if any is."""
    u, v = F.col("o_custkey") % 40, (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 40
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 400).alias("graph"), F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.floor("o_totalprice").alias("length"), (F.col("o_orderstatus") == "F").alias("damaged"))
    return rows.where("u <> v").groupBy("graph", "u", "v").agg(F.min("length").alias("length"), F.bool_or("damaged").alias("damaged"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-call steps: user_id, step (from 1), call, value."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).cast("long").alias("step"), F.col("event_type").alias("call"), "value", "props", "event_id")


#: The same derivations for DuckDB, as named queries.
SQL = {
    "cells": f"SELECT l_suppkey AS raster_id, l_linenumber % 3 + 1 AS band, CAST(l_orderkey % {SIDE} AS INT) AS r, CAST(l_partkey % {SIDE} AS INT) AS c, max(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "mask": "SELECT raster_id, r, c, CAST(trunc(value) AS INT) % 4 AS value FROM cells WHERE band = 1",
    "dem": f"SELECT s_suppkey AS raster_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST((s_suppkey * 7 + r * r * 3 + c * 5 + r * c) % 97 AS DOUBLE) AS value FROM supplier, range({SIDE}) a(r), range({SIDE}) b(c)",
    "rects": "SELECT *, x0 + 1 + p_size % 9 AS x1, y0 + 1 + p_size % 5 AS y1 FROM (SELECT p_partkey AS id, p_size % 3 AS class, p_brand AS brand, p_size, p_partkey * 31 % 97 + 100 * (p_partkey // 500) AS x0, p_partkey * 7 % 89 AS y0 FROM part)",
    "pois": "SELECT c_custkey AS id, c_name AS name, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ', Shelter' ELSE ', school' END AS types, CAST(c_custkey * 37 % 1800 AS DOUBLE) / 10 - 90 AS lat, CAST(c_custkey * 91 % 3600 AS DOUBLE) / 10 - 180 AS lon, c_custkey * 13 % 97 + 100 * (c_custkey // 375) AS px, c_custkey * 29 % 89 AS py, c_acctbal AS population FROM customer",
    "sites": "SELECT s_suppkey AS id, s_name AS name, s_suppkey * 17 % 97 + 100 * (s_suppkey // 25) AS px, s_suppkey * 41 % 89 AS py, abs(CAST(floor(s_acctbal) AS BIGINT)) AS need, s_nationkey AS region FROM supplier",
    "edges": "SELECT graph, u, v, min(length) AS length, bool_or(damaged) AS damaged FROM (SELECT o_orderkey // 400 AS graph, least(o_custkey % 40, (o_custkey * 7 + o_orderkey) % 40) AS u, greatest(o_custkey % 40, (o_custkey * 7 + o_orderkey) % 40) AS v, CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderstatus = 'F' AS damaged FROM orders) WHERE u <> v GROUP BY ALL",
    "steps": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS call, value, props, event_id FROM events",
}
NEEDS = {"mask": ["cells"]}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named derivations in front of it."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    recursive = "RECURSIVE " if "WITH RECURSIVE" in sql else ""
    body = sql.replace("WITH RECURSIVE", "WITH", 1).strip()
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    return f"WITH {recursive}{views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {recursive}{views} {body}"
