"""GeoJSON in, waypoint shapes, measures of broken parts, and the streaming extension."""

import json

from pyspark.sql import functions as F

from spanwright.functions.geometry import Metric
from spanwright.operators import diagnostics, topology
from spanwright.plans.graph import build
from spanwright.sources.geojson import read_features, waypoint
from spanwright.streaming.enrich import snapped_stream


def line(*points):
    return {"type": "LineString", "coordinates": [list(p) for p in points]}


def test_features_of_a_collection(spark, tmp_path):
    found = [
        {"type": "Feature", "id": "7", "properties": {"id": 3}, "geometry": line((0, 0), (1, 0, 5))},
        {"type": "Feature", "id": 8, "properties": None, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [0, 1]], [[0, 2], [0, 3]]]}},
        {"type": "Feature", "properties": {"id": 9, "name": "x"}, "geometry": line((5, 5), (6, 6))},
        {"type": "Feature", "properties": {"id": "9"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"deep": {"id": 4}}, "geometry": None},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    rows = read_features(spark, str(tmp_path / "a.json")).orderBy("feature_idx").collect()
    assert [r["id"] for r in rows] == ["s:7", "n:8", "n:9", "s:9", None]
    assert [None if r["parts"] is None else [len(p) for p in r["parts"]] for r in rows] == [[2], [2, 2], [2], None, None]
    assert rows[0]["parts"][0][1]["z"] == 5 and tuple(rows[3]["point"]) == (1, 2, None)
    stats = topology.build_stats(features := read_features(spark, str(tmp_path / "a.json")), c := topology.coordinates(features), topology.segments(topology.exact_vertices(c), Metric())).first()
    assert stats.asDict() == {"features": 5, "line_features": 3, "skipped_features": 2, "invalid_coordinates": 0, "segments": 4}


def test_waypoint_shapes(spark):
    shapes = ["[1, 2]", '{"type":"Point","coordinates":[1,2,3]}', '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}', '{"coordinates":[1,2]}', '{"type":"LineString","coordinates":[[1,2]]}', "null", "[1]"]
    x, y = waypoint(F.col("value"))
    got = spark.createDataFrame([(s,) for s in shapes], "value string").select(x.alias("x"), y.alias("y")).collect()
    assert [tuple(r) for r in got] == [(1, 2)] * 4 + [(None, None)] * 3


def test_measure_gaps(spark):
    rows = [(0, 0, 0, 1, 2), (0, 0, 1, 2, 3), (1, 0, 0, 1, 2), (1, 0, 1, 5, 6)]
    segs = spark.createDataFrame(rows, "feature_idx long, part int, seg_idx int, a long, b long")
    assert [tuple(r) for r in diagnostics.measure_gaps(segs).collect()] == [(1, 0, 2)]


def test_a_stream_of_points(spark, tmp_path):
    point = "struct<x:double,y:double,z:double>"
    lines = spark.createDataFrame([(0, "s:0", "LineString", [[(0.0, 0.0, None), (10.0, 0.0, None)]], None)], f"feature_idx long, id string, geom_type string, parts array<array<{point}>>, props string")
    spark.createDataFrame([(1, 4.0, 3.0), (2, 7.0, -1.0)], "point_id long, x double, y double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_id long, x double, y double").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    snapped_stream(build(lines), stream, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"), str(tmp_path / "mark")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["point_id"], r["x"], r["distance"]) for r in got) == [(1, 4, 3), (2, 7, 1)]
