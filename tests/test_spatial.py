import json
import math
import random

import pytest
from pyspark.sql import functions as F

from arealens.operators import spatial as SP
from arealens.sources import features, geojson

SHAPE = "cd string, rings array<struct<hole:boolean,points:array<struct<x:double,y:double>>>>"


def star(rng, cx, cy, size):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 12)))
    return [(cx + rng.uniform(size / 7, size) * math.cos(a), cy + rng.uniform(size / 7, size) * math.sin(a)) for a in angles]


def brute(polygons, x, y):
    inside, best = [], None
    for key, rings in polygons:
        odd, on = False, False
        for _, ring in rings:
            for i, (x1, y1) in enumerate(ring):
                x2, y2 = ring[(i + 1) % len(ring)]
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
                if (x2 - x1) * (y - y1) == (x - x1) * (y2 - y1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    on = True
                dx, dy = x2 - x1, y2 - y1
                if dx or dy:
                    u = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
                    d = (x - x1 - u * dx) ** 2 + (y - y1 - u * dy) ** 2
                    best = min(best, (d, key)) if best else (d, key)
        if odd and not on:
            inside.append(key)
    return (min(inside) if inside else None), (min(inside) if inside else best[1])


@pytest.fixture(scope="module")
def scene():
    rng = random.Random(3)
    polygons = [(f"a{i:02d}", [(False, star(rng, rng.uniform(0, 100), rng.uniform(0, 60), 7))]) for i in range(40)]
    # One shape far larger, many far smaller than the others, and one ring with a hole.
    polygons.append(("big", [(False, [(-50.0, 70.0), (150.0, 70.0), (150.0, 95.0), (-50.0, 95.0)])]))
    polygons += [(f"t{i:02d}", [(False, star(rng, rng.uniform(50, 51), rng.uniform(80, 81), 0.1))]) for i in range(15)]
    polygons.append(("ring", [(False, [(0.0, -20.0), (20.0, -20.0), (20.0, -5.0), (0.0, -5.0)]), (True, [(5.0, -15.0), (5.0, -10.0), (15.0, -10.0), (15.0, -15.0)])]))
    points = [(i, rng.uniform(-60, 160), rng.uniform(-40, 120)) for i in range(500)]
    points += [(500 + i, rng.uniform(50, 51), rng.uniform(80, 81)) for i in range(100)]
    points += [(600 + i, rng.uniform(0, 100), rng.uniform(0, 60)) for i in range(300)]
    corners = [ring[0] for _, rings in polygons for _, ring in rings]
    points += [(900 + i, x, y) for i, (x, y) in enumerate(corners)]
    points += [(2000, 1e6, -1e6), (2001, 10.0, -12.0), (2002, 10.0, -5.0)]
    return polygons, points


@pytest.mark.parametrize("broadcast_edges", [1_000_000, 0])
def test_areas_match_brute_force(spark, scene, broadcast_edges):
    polygons, points = scene
    shapes = spark.createDataFrame(polygons, SHAPE)
    df = spark.createDataFrame(points, "id long, longitude double, latitude double")
    within = {r.id: r.cd for r in SP.spatial_join_within(df, shapes, attributes=["cd"], valid_only=False, broadcast_edges=broadcast_edges).collect()}
    nearest = {r.id: r.cd for r in SP.assign_area(df, shapes, attributes=["cd"], valid_only=False, broadcast_edges=broadcast_edges).collect()}
    assert len(within) == len(nearest) == len(points)
    assert {i: (within[i], nearest[i]) for i, _, _ in points} == {i: brute(polygons, x, y) for i, x, y in points}


def test_nearest_search_walks_once_per_group_of_points(spark, scene, monkeypatch):
    polygons, _ = scene
    rng = random.Random(5)
    points = [(i, rng.uniform(70, 72), rng.uniform(64, 66)) for i in range(400)] + [(400 + i, -900.0, 5e4) for i in range(400)]
    walked, candidates = [], getattr(SP, "_candidates", None)
    monkeypatch.setattr(SP, "_candidates", lambda groups, tree: walked.append(groups.count()) or candidates(groups, tree), raising=False)
    df = spark.createDataFrame(points, "id long, longitude double, latitude double")
    shapes = spark.createDataFrame(polygons, SHAPE)
    got = {r.id: r.cd for r in SP.nearest_area(df, shapes, attributes=["cd"], valid_only=False, broadcast_edges=0).collect()}
    assert got == {i: brute(polygons, x, y)[1] for i, x, y in points}
    assert walked and walked[0] <= 10


def test_points_without_valid_coordinates_are_left_out(spark, scene):
    shapes = spark.createDataFrame(scene[0], SHAPE)
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 5.0, None), (3, 5.0, 80.0)], "id long, longitude double, latitude double")
    assert [r.id for r in SP.assign_area(df, shapes, attributes=["cd"]).collect()] == [3]


def test_polygon_attributes_win(spark, scene):
    shapes = spark.createDataFrame(scene[0], SHAPE).withColumn("borough", F.lit("area"))
    df = spark.createDataFrame([(1, "point", 5.0, 80.0)], "id long, Borough string, longitude double, latitude double")
    row = SP.assign_area(df, shapes, attributes=["cd", "borough"]).first()
    assert (row["cd"], row["borough"]) == ("big", "area")


def test_area_and_bounds(spark, scene):
    shapes = spark.createDataFrame(scene[0], SHAPE).filter("cd in ('big', 'ring')")
    sizes = {r.cd: r.area_km2 for r in SP.polygon_area(shapes, "cd").collect()}
    assert sizes == {"big": 200 * 25, "ring": 20 * 15 - 10 * 5}
    assert tuple(SP.total_bounds(shapes).first()) == (-50.0, -20.0, 150.0, 95.0, 50.0, 37.5)


def test_feature_collection_round_trip(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]
    island = [[10, 0], [12, 0], [12, 2], [10, 2], [10, 0]]
    names = {"CDTAName": " Mill ", "CDTA2020": "BX01", "BoroName": "bronx"}
    features = [
        {"type": "Feature", "properties": names, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {**names, "CDTA2020": "BX02"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square, hole], [island]]}},
    ]
    path = tmp_path / "areas.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    read = geojson.scan_polygons(spark, str(path))
    rows = {r.cd: r for r in read.collect()}
    assert rows["BX01"].neighborhood == "Mill" and rows["BX01"].borough == "BRONX"
    assert [r.hole for r in rows["BX02"].rings] == [False, True, False]
    sizes = {r.cd: r.area_km2 for r in SP.polygon_area(read, "cd").collect()}
    assert sizes == {"BX01": 15.0, "BX02": 19.0}
    text = read.select("cd", geojson.geometry_json("rings").alias("g")).filter("cd = 'BX02'").first().g
    assert json.loads(text)["coordinates"] == features[1]["geometry"]["coordinates"]
    lines = geojson.export_scored_polygons(read.withColumn("score", F.lit(None).cast("double")), ["cd", "score"]).collect()
    assert json.loads(lines[0].value)["properties"] == {"cd": "BX01", "score": None}


def collection(n):
    """Features with brackets, quotes and backslashes in strings, nested properties of the same name, and lists that are no features."""
    names = ['a}{"é', "b\\", 'c\\"features":[{', "]]]", "d"]
    ring = [[0, 0], [4.50, 0], [4, 4], [0, 0]]
    features = [
        {"type": "Feature", "id": i, "properties": {"CDTAName": names[i % 5], "CDTA2020": f"BX{i}", "BoroName": "x", "features": [{"no": i}]},
         "geometry": {"type": "Polygon", "coordinates": [ring] * (1 + i % 3)}}
        for i in range(n)
    ]
    other = {"crs": {"features": [{"properties": {"CDTA2020": "no"}}]}, "type": "FeatureCollection", "bbox": [[{"a": 1}], 2]}
    return {**other, "features": features, "more": [{"properties": {"CDTA2020": "no"}}]}


@pytest.mark.parametrize("indent, block, end", [(None, 200, ""), (1, 300, "\n"), (None, 1000, " \n"), (1, 1 << 20, "")])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, indent, block, end):
    whole = collection(23)
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=k == 0) + end)
    (tmp_path / "cut.json").write_text(json.dumps(whole)[:-200])
    bound = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        texts = [r.value for r in features.feature_texts(spark, str(tmp_path)).collect()]
        read = geojson.scan_polygons(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bound)
    place = lambda f: f["id"]
    assert sorted(map(json.loads, texts), key=place) == sorted(whole["features"] * 2, key=place)
    got = sorted((int(r.cd[2:]), r.neighborhood, len(r.rings), json.loads(r.geometry)) for r in read.collect() if r.cd == r.cd)
    want = sorted((f["id"], f["properties"]["CDTAName"], len(f["geometry"]["coordinates"]), f["geometry"]) for f in whole["features"] * 2)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == [w[3] for w in want]


def test_no_task_reads_a_whole_document(spark, tmp_path):
    path = tmp_path / "areas.json"
    path.write_text(json.dumps(collection(400)))
    bound = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        read = geojson.scan_polygons(spark, str(path))
        tasks = read.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bound)
    assert sum(r["count"] for r in tasks) == 400 and max(r["count"] for r in tasks) < 100


@pytest.mark.parametrize("n", [0, 1, 30])
def test_one_document_in_parts(spark, tmp_path, n):
    whole = collection(n)
    lines = json.dumps(whole, indent=1).split("\n")
    for k in range(0, len(lines), 7):
        (tmp_path / f"part-{k:05}.txt").write_text("\n".join(lines[k : k + 7]) + "\n" * (k % 2))
    texts = [r.value for r in features.feature_texts(spark, str(tmp_path), whole=True).collect()]
    assert sorted(json.loads(t)["id"] for t in texts) == list(range(n))
