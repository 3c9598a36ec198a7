"""GeoJSON collections in and out, waypoint shapes, and the feature table that all builds start from.

features: feature_idx BIGINT (order is semantic), id STRING tagged n: or s:, geom_type, parts
ARRAY<ARRAY<STRUCT<x, y, z>>> (null unless a line), props (any type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = "struct<x:double,y:double,z:double>"


def read_features(spark: SparkSession, path: str, props_schema: T.StructType | None = None) -> DataFrame:
    """The features of GeoJSON FeatureCollections, one collection a file, in file and list order.

    A document without a ``features`` array raises. props are a struct of ``props_schema``, else the JSON text.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    listed = whole.select("file", F.get_json_object("json", "$.features").alias("features"))
    checked = listed.withColumn("features", F.when(F.col("features").startswith("["), F.col("features")).otherwise(F.raise_error(F.lit("not a feature collection")).cast("string")))
    rows = checked.select("file", F.posexplode(F.from_json("features", "array<string>")).alias("at", "json"))
    parsed = rows.select("file", "at", *(F.get_json_object("json", f"$.{k}").alias(n) for k, n in (("id", "raw_id"), ("properties.id", "prop_id"), ("geometry.type", "geom_type"), ("geometry.coordinates", "coordinates"), ("properties", "props"))), "json")
    line, lines = (F.from_json("coordinates", t) for t in ("array<array<double>>", "array<array<array<double>>>"))
    parts = F.when(F.col("geom_type") == "LineString", F.array(line)).when(F.col("geom_type") == "MultiLineString", lines)
    # the type of the feature's own id, else of its property: a string is quoted in the JSON text of the object's field
    key = F.coalesce("raw_id", "prop_id")
    where = F.when(F.col("raw_id").isNotNull(), F.col("json")).otherwise(F.col("props"))
    kinds = F.from_json(where, "map<string,variant>")
    numeric = F.schema_of_variant(F.element_at(kinds, "id")).rlike("BIGINT|DOUBLE|DECIMAL|FLOAT")
    props = F.from_json("props", props_schema) if props_schema is not None else F.col("props")
    point = F.when(F.col("geom_type") == "Point", position(F.from_json("coordinates", "array<double>")))
    out = parsed.select("file", "at", F.concat(F.when(numeric, "n:").otherwise("s:"), key).alias("id"), "geom_type", F.transform(parts, lambda part: F.transform(part, position)).alias("parts"), point.alias("point"), props.alias("props"))
    from spanwright.plans.materialise import with_rank

    return with_rank(out, ["file", "at"], "feature_idx").drop("file", "at")


def position(xyz: Column) -> Column:
    """A struct of an array of two or more numbers; missing ones are null."""
    return F.struct(F.get(xyz, F.lit(0)).alias("x"), F.get(xyz, F.lit(1)).alias("y"), F.get(xyz, F.lit(2)).alias("z"))


def waypoint(json: Column) -> tuple[Column, Column]:
    """x and y of a waypoint given as a position, Point geometry, Point feature or {coordinates}; null for anything else."""
    bare = F.from_json(json, "array<double>")
    kind, inner = F.get_json_object(json, "$.type"), F.get_json_object(json, "$.geometry.type")
    nested = F.when(inner == "Point", F.get_json_object(json, "$.geometry.coordinates")).when(kind.isNull() | (kind == "Point"), F.get_json_object(json, "$.coordinates"))
    xy = F.when(json.startswith("["), bare).otherwise(F.from_json(nested, "array<double>"))
    good = (F.size(xy) >= 2) & ~F.isnan(F.get(xy, F.lit(0))) & ~F.isnan(F.get(xy, F.lit(1)))
    return F.when(good, F.get(xy, F.lit(0))), F.when(good, F.get(xy, F.lit(1)))


def line_string(path: Column, **summary: Column) -> Column:
    """A route's path (ARRAY of positions) as a GeoJSON LineString feature; a single point is written twice, null stays null."""
    xyz = F.transform(path, lambda p: F.when(p["z"].isNull(), F.array(p["x"], p["y"])).otherwise(F.array(p["x"], p["y"], p["z"])))
    whole = F.when(F.size(xyz) == 1, F.concat(xyz, xyz)).otherwise(xyz)
    geometry = F.struct(F.lit("LineString").alias("type"), whole.alias("coordinates"))
    props = F.struct(*(v.alias(k) for k, v in summary.items())) if summary else F.struct(F.lit(None).cast("string").alias("none"))
    return F.when(F.size(path) > 0, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))))


def features_from_segments(rows: DataFrame) -> DataFrame:
    """The feature table of rows(feature_idx, id, ax, ay, bx, by, props): one two-point line each."""
    end = [F.struct(F.col(f"{k}x").cast("double").alias("x"), F.col(f"{k}y").cast("double").alias("y"), F.lit(None).cast("double").alias("z")) for k in "ab"]
    return rows.select("feature_idx", "id", F.lit("LineString").alias("geom_type"), F.array(F.array(*end)).alias("parts"), "props")
