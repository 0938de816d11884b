"""Slab index against walking every ring, its size, and rings from WKT and GeoJSON."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F

from obsweave.operators import cells, environment, polygons
from obsweave.operators.flags import add_place_flags
from obsweave.columns import Columns
from obsweave.plans import skew
from obsweave.sources.reference import rings_from_geojson, rings_from_wkt, ring_table


def star(rng, x, y, size, corners):
    return [
        (x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / corners), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / corners))
        for k in range(corners)
    ]


def shapes(seed=2):
    """A detailed land with a lake and an island in it, a land of two parts, many towns, a thin strip."""
    rng = random.Random(seed)
    out = {
        "land": [star(rng, 0, 0, 8, 900), star(rng, 0, 0, 2, 60), star(rng, 0, 0, 0.5, 9)],
        "parts": [star(rng, 20, 5, 3, 40), star(rng, 27, 5, 2, 30), [(26.0, 4.0), (28.0, 4.0), (28.0, 6.0), (26.0, 6.0), (26.0, 4.0)]],
        "strip": [[(-170.0, 10.0), (170.0, 10.001), (170.0, 10.002), (-170.0, 10.003)]],
        "steep": [[(50.0, -80.0), (50.001, 80.0), (50.5, 80.0), (50.4, -80.0)]],
        "line": [[(1.0, 1.0), (2.0, 2.0)]],
    }
    for k in range(60):
        out[f"town{k}"] = [star(rng, rng.uniform(-30, 30), rng.uniform(-20, 20), 0.7, 7)]
    return out


def holds(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def points(found, n=1500):
    rng = random.Random(7)
    corners = [p for rings in found.values() for ring in rings for p in ring]
    at = [rng.choice(corners) for _ in range(n // 5)]
    at += [(x, rng.uniform(-20, 20)) for x, _ in at[:100]] + [(rng.uniform(-30, 30), y) for _, y in at[:100]]
    return at + [(rng.uniform(-40, 60), rng.uniform(-25, 25)) for _ in range(n)] + [(None, 1.0), (1.0, None), (None, None)] * 200 + [(0.1, 0.1)] * 800


def check(spark, index_of):
    found = shapes()
    df = spark.createDataFrame(points(found), "lon double, lat double").repartition(6)
    rows = polygons.with_polygons(df, index_of(ring_table(spark, found)), "names").collect()
    assert len(rows) == df.count()
    known = {}
    for r in rows:
        key = (r["lon"], r["lat"])
        if key not in known:
            known[key] = set() if None in key else {k for k, v in found.items() if holds(v, *key)}
        assert set(r["names"]) == known[key], key
    assert any(len(v) > 1 for v in known.values())


def test_slab_index_equals_every_ring(spark):
    check(spark, polygons.slab_index)


def test_slab_index_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(polygons, "BROADCAST_ROWS", 10)
    check(spark, polygons.slab_index)


def test_slab_index_holds_a_few_entries_per_edge(spark):
    rings = ring_table(spark, shapes())
    index = polygons.slab_index(rings)
    filed = index.table.select(F.explode("_parts").alias("p")).select(F.sum(F.size("p.edges"))).first()[0]
    assert filed <= 5 * polygons.edges(rings).count()
    assert polygons.slab_index(rings.where("false")).table.count() == 0


def test_plan_has_no_ring(spark):
    plan = polygons.add_inside(spark.range(5).select(F.rand(1).alias("lon"), F.rand(2).alias("lat")), ring_table(spark, shapes()), "f")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in text.split("Join")[0]  # records meet the edges of their slab only


def test_clipped_grid_and_background_take_tables(spark):
    rings = ring_table(spark, {"a": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]})
    area = {"a": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]}["a"]
    got = cells.hex_cells(spark, (0, 0, 4, 4), 0.5, rings).collect()
    every = cells.hex_cells(spark, (0, 0, 4, 4), 0.5).collect()
    assert {(r["cell_q"], r["cell_r"]) for r in got} == {(r["cell_q"], r["cell_r"]) for r in every if holds(area, r["lon_c"], r["lat_c"])}
    pts = environment.background_points(spark, rings, 500).collect()
    assert len(pts) == 500 and all(holds(area, r["lon"], r["lat"]) for r in pts)


def test_place_flags_without_broadcast_split_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr("obsweave.operators.flags.is_small", lambda df, rows=0: False)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.01)
    places = spark.createDataFrame([("capital", "c", 10.0, 10.0), ("hq", "h", 10.0, 10.05)], "kind string, name string, lon double, lat double")
    pts = [(10.0, 10.0)] * 500 + [(None, None)] * 300 + [(50.0, 5.0)] * 300 + [(10.0, 10.04), (10.0, 10.2), (179.99, 1.0)]
    df = spark.createDataFrame(pts, "lon double, lat double").withColumn("id", F.monotonically_increasing_id())
    out = add_place_flags(df, places, Columns(), {"capital": 10_000, "hq": 1_000}, {"capital": "cap", "hq": "hq"})
    got = out.groupBy("lon", "lat").agg(F.count("*").alias("n"), F.first("cap").alias("c"), F.first("hq").alias("h")).collect()
    assert {(r["lon"], r["lat"], r["n"], r["c"], r["h"]) for r in got} == {
        (10.0, 10.0, 500, True, False), (None, None, 300, False, False), (50.0, 5.0, 300, False, False),
        (10.0, 10.04, 1, True, False), (10.0, 10.2, 1, False, False), (179.99, 1.0, 1, False, False)}


def test_rings_from_text(spark):
    outer, hole, part = [(0.0, 0.0), (4.0, 0.5), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, -1.5e-1), (1.0, 1.0)], [(9.0, 9.0), (10.0, 9.0), (9.5, 12.0), (9.0, 9.0)]
    say = lambda ring: "(" + ", ".join(f"{x} {y}" for x, y in ring) + ")"
    wkt = [("one", f"POLYGON ({say(outer)}, {say(hole)})"), ("two", f"MULTIPOLYGON (({say(outer)}, {say(hole)}), ({say(part)}))"),
           ("z", "POLYGON Z ((0 0 7, 1 0 7, 1 1 7))"), ("none", "POLYGON EMPTY"), ("null", None)]
    got = rings_from_wkt(spark.createDataFrame(wkt, "name string, wkt string")).collect()
    read = lambda rows, k: sorted([tuple(p) for p in r["ring"]] for r in rows if r["name"] == k)
    assert read(got, "one") == sorted([outer, hole]) and read(got, "two") == sorted([outer, hole, part])
    assert read(got, "z") == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]] and len(got) == 6
    shape = {"type": "MultiPolygon", "coordinates": [[outer, hole], [part]]}
    geo = [("one", json.dumps({"type": "Polygon", "coordinates": [outer, hole]})), ("two", json.dumps({"type": "Feature", "properties": {}, "geometry": shape})),
           ("point", '{"type": "Point", "coordinates": [1, 2]}'), ("null", None)]
    got = rings_from_geojson(spark.createDataFrame(geo, "name string, geojson string")).collect()
    assert read(got, "one") == sorted([outer, hole]) and read(got, "two") == sorted([outer, hole, part]) and len(got) == 5
