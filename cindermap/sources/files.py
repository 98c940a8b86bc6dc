"""Readers and writers of layers, graphs, task files and run records; all by Spark's own readers and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "struct<type:string,coordinates:string,geometries:array<string>>"
GEOJSON = "type string, features array<struct<geometry:string>>, geometry string"
FEATURE = "geometry string, properties map<string,string>"
GRAPH = "nodes array<struct<id:string>>, edges array<struct<source:string,target:string,length_m:double,length:double,weight:double,damaged:boolean>>"
TASKS = "sample_id string, input_data string, tasks array<struct<task_category:string,task_category_code:string,question:string,final_answer:string>>"
RUN = "question_id string, sample_id string, task_idx long, task_category_code string, predicted_answer string, error string, elapsed_time double, timestamp string"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """type, coordinates (JSON), props of each feature of whole GeoJSON files (one object a file)."""
    rows = spark.read.schema(f"features array<struct<{FEATURE.replace(' ', ':').replace(',:', ', ')}>>").json(path, multiLine=True)
    return _features(rows.select(F.explode("features").alias("f")).select("f.*"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one feature a line, which Spark reads in splits."""
    return _features(spark.read.schema(FEATURE).json(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features for a loop, of JSON files that hold an object with ``features`` or a bare list: pos and feature (JSON text).

    Files without features, and an empty list, give one row of nulls each.
    """
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.coalesce(F.get_json_object("value", "$.features"), F.col("value")), "array<string>")
    return whole.select(F.posexplode_outer(listed).alias("pos", "feature"))


def _features(rows: DataFrame) -> DataFrame:
    return rows.select(F.get_json_object("geometry", "$.type").alias("type"), F.get_json_object("geometry", "$.coordinates").alias("coordinates"), F.col("properties").alias("props"))


def points(layer: DataFrame) -> DataFrame:
    """px and py of point features."""
    at = F.from_json("coordinates", "array<double>")
    return layer.where("type = 'Point'").withColumn("px", at[0]).withColumn("py", at[1])


def rings_of_geometry(geometry: Column) -> Column:
    """Polygons of a geometry (JSON text): an array of polygons, each an array of rings of x, y structs; empty for points and lines. Of a
    collection its members count, but not collections in it."""

    def of(text: Column, inside: bool) -> Column:
        g = F.from_json(text, GEOMETRY)
        one = F.array(F.from_json(g["coordinates"], "array<array<array<double>>>"))
        many = F.from_json(g["coordinates"], "array<array<array<array<double>>>>")
        found = F.when(g["type"] == "Polygon", one).when(g["type"] == "MultiPolygon", many)
        if not inside:
            found = found.when(g["type"] == "GeometryCollection", F.flatten(F.transform(F.coalesce(g["geometries"], F.array().cast("array<string>")), lambda x: of(x, True))))
        return F.coalesce(found, F.array().cast("array<array<array<array<double>>>>"))

    polygons = F.filter(of(geometry, False), lambda rings: (F.size(rings) > 0) & (F.size(F.get(rings, F.lit(0))) > 0))
    return F.transform(polygons, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def geojson_polygons(text: Column) -> Column:
    """All polygons of a GeoJSON text (a collection of features, a feature or a geometry); null if the text is no JSON object."""
    o = F.from_json(text, GEOJSON)
    features = F.transform(F.coalesce(o["features"], F.array().cast("array<struct<geometry:string>>")), lambda f: f["geometry"])
    geometries = F.when(o["type"] == "FeatureCollection", features).when(o["type"] == "Feature", F.array(o["geometry"])).otherwise(F.array(text))
    return F.when(o["type"].isNotNull(), F.flatten(F.transform(geometries, rings_of_geometry)))


def polygons(layer: DataFrame) -> DataFrame:
    """``rings`` of polygon features: a multipolygon's rings together, as overlays take them."""
    text = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","coordinates":'), F.col("coordinates"), F.lit("}"))
    return layer.where("type IN ('Polygon', 'MultiPolygon')").withColumn("rings", F.flatten(rings_of_geometry(text)))


def layer_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """``read_geojson``; a path that is not there gives an empty layer."""
    try:
        return read_geojson(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "type string, coordinates string, props map<string,string>")


def write_polygons(rows: DataFrame, path: str, props: list[str]) -> None:
    """Polygon features of ``rings`` (the first ring outside, the others holes), one a line; rings are closed."""
    closed = lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    coordinates = F.transform("rings", lambda r: F.transform(closed(r), lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))
    rows.where(F.size("rings") > 0).select(F.to_json(feature).alias("value")).write.text(path)


def write_geojson_lines(rows: DataFrame, path: str, x: str, y: str, props: list[str]) -> None:
    """Point features, one a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))
    rows.select(F.to_json(feature).alias("value")).write.text(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of JSON graphs: u, v, length (of length_m, length or weight, else 1), damaged."""
    edges = spark.read.schema(GRAPH).json(path, multiLine=True).select(F.explode("edges").alias("e"))
    return edges.select(F.col("e.source").alias("u"), F.col("e.target").alias("v"), F.coalesce("e.length_m", "e.length", "e.weight", F.lit(1.0)).alias("length"), F.coalesce("e.damaged", F.lit(False)).alias("damaged"))


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """Edges of GraphML files: u, v, length and damaged as in ``read_graph``; attributes by the names that the file's keys declare.

    Spark's XML reader splits the files by edge; the keys are one short table.
    """
    data = "data array<struct<_key:string,_VALUE:string>>"
    names = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path).select(F.col("_id").alias("id"), F.col("`_attr.name`").alias("name"))
    names = names.agg(F.map_from_entries(F.collect_set(F.struct("id", "name"))).alias("names"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path).withColumn("names", names.scalar())
    facts = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda e: F.struct(F.coalesce(F.try_element_at(F.col("names"), e["_key"]), e["_key"]), e["_VALUE"])))
    edges = edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), facts.alias("facts"))
    number = lambda k: F.try_element_at("facts", F.lit(k)).try_cast("double")
    return edges.select("u", "v", F.coalesce(number("length_m"), number("length"), number("weight"), F.lit(1.0)).alias("length"), F.lower(F.trim(F.coalesce(F.try_element_at("facts", F.lit("damaged")), F.lit("")))).isin("true", "1", "yes").alias("damaged"))


def write_graphml(edges: DataFrame, path: str) -> None:
    """Edges (u, v, length, damaged, further columns) as GraphML parts that ``read_graphml`` reads: a part a partition, with the keys in
    each. Arrays and structs are written as JSON."""
    kinds = {"double": "double", "float": "double", "bigint": "long", "int": "int", "boolean": "boolean"}
    facts = [c for c in edges.columns if c not in ("u", "v")]
    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    text = lambda c: F.to_json(c) if types[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), escape(text(c)), F.lit("</data>"))).otherwise("") for c in facts]
    ends = [F.concat(F.lit(f'{k}="'), escape(F.col(c).cast("string")), F.lit('"')) for k, c in (("source", "u"), ("target", "v"))]
    lines = edges.select(F.concat(F.lit("<edge "), ends[0], F.lit(" "), ends[1], F.lit(">"), *data, F.lit("</edge>")).alias("value"))
    head = "".join(f'<key id="{c}" for="edge" attr.name="{c}" attr.type="{kinds.get(types[c], "string")}"/>' for c in facts)

    def framed(batches):
        yield pd.DataFrame({"value": [f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{head}<graph edgedefault="undirected">']})
        yield from batches
        yield pd.DataFrame({"value": ["</graph></graphml>"]})

    lines.mapInPandas(framed, "value string").write.text(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """One row a task, with question_id ``<sample>_task<position>``."""
    rows = spark.read.schema(TASKS).json(path, multiLine=True).select("sample_id", F.posexplode("tasks").alias("pos", "task"))
    return rows.select(F.concat("sample_id", F.lit("_task"), "pos").alias("question_id"), "sample_id", "pos", "task.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def run_stats(runs: DataFrame) -> DataFrame:
    """Total, answered without error, failed, mean seconds."""
    good = F.col("predicted_answer").isNotNull() & F.col("error").isNull()
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), F.avg("elapsed_time").alias("avg_time"))


def unanswered(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks to run again: those without an answer that has no error."""
    return tasks.join(runs.where("predicted_answer IS NOT NULL AND error IS NULL").select("question_id"), "question_id", "left_anti")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (name, size, sha256) with status ok, missing, size or digest."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("has"), F.sha2("content", 256).alias("digest"))
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("has") != F.col("size"), "size").when(F.col("digest") != F.col("sha256"), "digest").otherwise("ok")
    return manifest.join(found, "name", "left").select("name", status.alias("status"))


def write_results(rows: DataFrame, path: str) -> None:
    """An evaluation's rows as JSON lines (``path``/json) and as a table of text with two blanks between columns (``path``/text)."""
    rows.write.json(f"{path}/json")
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), 14, " ") for c in rows.columns]
    rows.select(F.rtrim(F.concat_ws("  ", *cells)).alias("value")).write.text(f"{path}/text")
