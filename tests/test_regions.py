"""Points in shapes with holes, nested shapes and borders, by a grid, against the plain ray cast."""

import json
import random
from fractions import Fraction

import pytest

from rippleflow.sources import tables


def write(path, shapes):
    """shapes: (name, pieces), a piece a list of rings."""
    features = [{"type": "Feature", "properties": {"nam": n}, "geometry": {"type": "Polygon", "coordinates": p[0]} if len(p) == 1 else {"type": "MultiPolygon", "coordinates": p}} for n, p in shapes]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def holds(piece, x, y):
    """In exact numbers: on a border, no; else by crossings of all rings."""
    x, y, odd = Fraction(x), Fraction(y), False
    for ring in piece:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            x1, y1, x2, y2 = map(Fraction, (x1, y1, x2, y2))
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def box(a, b, c, d):
    return [[a, b], [c, b], [c, d], [a, d], [a, b]]


SHAPES = [
    ("holed", [[box(0, 0, 10, 10), box(3, 3, 6, 6)]]),
    ("lake island", [[box(4, 4, 5, 5)]]),
    ("around", [[box(-2, -2, 12, 12), box(11, 11, 11.5, 11.5)]]),
    ("two pieces", [[[[20, 0], [24, 2], [21, 5], [20, 0]]], [box(30, 0, 33, 1), [[31, 0.25], [32, 0.25], [31.5, 0.75], [31, 0.25]]]]),
    ("notched", [[[[22, 2], [26, 2], [26, 6], [24, 3], [22, 6], [22, 2]]]]),
    ("far", [[[[-100.5, -50], [-90, -41], [-99.25, -45.125], [-100.5, -50]]]]),
]


def first(x, y):
    return next((n for n, pieces in SHAPES if any(holds(p, x, y) for p in pieces)), None)


@pytest.mark.parametrize("size", [0.7, 4.0, 1000.0])
def test_equals_plain_ray_cast(spark, tmp_path, size):
    write(tmp_path / "g.json", SHAPES)
    rng = random.Random(int(size * 10))
    points = [(rng.uniform(-3, 35), rng.uniform(-3, 13)) for _ in range(500)] + [(rng.uniform(-101, -89), rng.uniform(-51, -40)) for _ in range(100)]
    points += [(float(x), float(y)) for x in range(-2, 14) for y in range(-2, 13)] + [(x / 4, y / 4) for x in range(80, 136) for y in range(0, 25, 3)]  + [(4.5, 4.5)]  # corners and borders
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, longitude double, latitude double")
    got = {r.id: r.name for r in tables.locate(df, tables.polygons(spark, str(tmp_path / "g.json"), "nam"), size=size).collect()}
    assert got == {i: first(x, y) for i, (x, y) in enumerate(points)}
    assert got[points.index((4.0, 8.0))] == "holed" and {"lake island", "around", "two pieces", "notched", "far", None} <= set(got.values())


def test_odd_points_and_shapes(spark, tmp_path):
    write(tmp_path / "g.json", SHAPES)
    shapes = tables.polygons(spark, str(tmp_path / "g.json"), "nam")
    rows = [(1.0, 1.0, "a")] * 3 + [(None, 1.0, "b"), (1.0, None, "c"), (float("nan"), 1.0, "d"), (4.5, 4.5, "e"), (3.5, 3.5, "f")]
    got = tables.locate(spark.createDataFrame(rows, "longitude double, latitude double, k string"), shapes)
    assert sorted((r.k, r.name) for r in got.collect() if r.name) == [("a", "holed")] * 3 + [("e", "lake island"), ("f", "around")]
    assert got.count() == len(rows)
    none = shapes.limit(0)
    assert {r.name for r in tables.locate(spark.createDataFrame(rows, "longitude double, latitude double, k string"), none).collect()} == {None}


def test_hole_of_a_hole_needs_a_shape_of_its_own(spark, tmp_path):
    """Cells wholly in a hole aren't kept at all."""
    write(tmp_path / "g.json", [("ring", [[box(0, 0, 9, 9), box(1, 1, 8, 8)]])])
    cells = tables.cells(tables.polygons(spark, str(tmp_path / "g.json"), "nam"), 1.0).collect()
    assert not any(2 <= c.cx <= 6 and 2 <= c.cy <= 6 for c in cells)
