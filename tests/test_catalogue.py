"""Every registered query against its SQL on the smallest tables, and rows or invariants for those without."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue, grown, more, outlines, wider, answers  # noqa: F401  the others register their queries in the catalogue

SF = "/root/testdata/sf0.001"
#: Queries that rightly find nothing in the smallest tables.
EMPTY = {"circle_contacts", "contact_degrees"}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list:
    names = sorted(df.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    found = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = db.sql(sql).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert _rows(found) == _rows(want)
        assert len(found) or name in EMPTY
    else:
        assert len(found)


def test_labels_do_not_depend_on_tiles(spark):
    from tessera.operators import regions

    cells = [(y, x) for y in range(40) for x in range(40) if (y * 7 + x * 13 + y * x) % 5 < 2]
    mask = spark.createDataFrame([("a", y, x) for y, x in cells], "image_id string, y long, x long")
    small, large = ({(r.y, r.x): r.label for r in regions.label(mask, tile=t).collect()} for t in (7, 64))
    assert small == large


def test_opening_and_closing_are_idempotent(spark):
    from tessera.operators import raster
    from tessera.sources import rasters

    r = rasters.quantity_raster(spark, SF)
    for f in (raster.opened, raster.closed):
        once = f(r)
        assert _rows(f(once).toPandas()) == _rows(once.toPandas())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def _sets(spark, rows):
    return spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "set string, seq long, px double, py double")


def test_concave_hull_is_simple_and_holds_all_points(spark):
    from tessera.functions import outlines

    # an L of points: its ring leaves out the missing corner that the convex hull would fill
    rows = [(x, y) for x in range(11) for y in range(11) if x <= 4 or y <= 4]
    ring = outlines.concave_hull(_sets(spark, rows + rows[:5]), 1.5).orderBy("place").toPandas()[["px", "py"]].to_numpy()
    nxt = [*ring[1:], ring[0]]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, nxt, strict=True))) / 2
    assert 64 <= area < 75  # the hull has 82, the L itself 64 and some
    assert len({tuple(r) for r in ring}) == len(ring)
    for x, y in rows:  # inside the ring or on it
        on = any(abs((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])) < 1e-9 and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for a, b in zip(ring, nxt, strict=True))
        odd = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, nxt, strict=True)) % 2
        assert on or odd


def test_moved_circles_stay_apart_and_inside_and_never_lose_area(spark):
    from tessera.functions import outlines

    cells = [(y, x) for y in range(40) for x in range(60) if (y - 20) ** 2 / 400 + (x - 30) ** 2 / 900 <= 1 and not (10 < y < 16 and 20 < x < 30)]
    c = outlines.moved_circles(spark.createDataFrame([("a", y, x) for y, x in cells], "image_id string, y long, x long"), 2.0, 8).toPandas()
    held = set(cells)
    for k in c.itertuples():
        assert all((y, x) in held for y in range(-2, 44) for x in range(-2, 64) if (y - k.cy) ** 2 + (x - k.cx) ** 2 < k.r**2 - 1e-9)
        assert all(((k.cy - j.cy) ** 2 + (k.cx - j.cx) ** 2) ** 0.5 >= k.r + j.r - 1e-9 for j in c.itertuples() if j.circle != k.circle)
    assert (c.area >= c.first_area).all() and abs(c.area[0] - (c.r**2).sum() * 3.141592653589793) < 1e-6


def test_packed_circles_leave_no_room(spark):
    from tessera.functions import kernels

    cells = [(y, x) for y in range(16) for x in range(16)]
    mask = spark.createDataFrame([("a", 4 * y, 4 * x) for y, x in cells], "image_id string, y long, x long")
    found = kernels.packed_circles(mask, 1.0).collect()  # lone pixels: each holds one circle of radius 1
    assert sorted((r.cy, r.cx) for r in found) == [(4 * y, 4 * x) for y, x in cells]
    assert [r.circle for r in found] == list(range(256))


def test_control_points_of_a_square(spark):
    from tessera.functions import outlines
    from tessera.operators import points, register

    ring = [(x, 0) for x in range(100)] + [(100, y) for y in range(100)] + [(x, 100) for x in range(100, 0, -1)] + [(0, y) for y in range(100, 0, -1)]
    rings = _sets(spark, ring)
    parts = register.sides(rings, points.corners(rings))
    assert sorted((r.side, r["count"]) for r in parts.groupBy("side").count().collect()) == [(k, 101) for k in range(4)]
    found = register.control_points(parts, 20).toPandas()
    assert found.kind.value_counts().to_dict() == {"side": 80, "grid": 9}
    assert sorted(zip(found[found.kind == "grid"].px, found[found.kind == "grid"].py, strict=True)) == [(x, y) for x in (25.0, 50.0, 75.0) for y in (25.0, 50.0, 75.0)]
    fitted = outlines.fitted_nodes(parts, 20).toPandas()
    assert len(fitted) == 84 and all(min(abs(r.px), abs(r.px - 100), abs(r.py), abs(r.py - 100)) < 1e-6 for r in fitted.itertuples())


def test_rotation_by_a_whole_turn_and_a_quarter(spark):
    from tessera.operators import raster, register

    r = spark.createDataFrame([("a", y, x, float(y * 7 + x * x)) for y in range(9) for x in range(9)], "image_id string, y long, x long, v double")
    want = {(p.y, p.x): p.v for p in r.collect()}
    assert {(p.y, p.x): round(p.v, 6) for p in register.rotated_cubic(r, 360).collect()} == want
    turned = {(p.y, p.x): round(p.v, 6) for p in register.rotated_cubic(r, 90).collect()}
    assert turned in [{(p.y, p.x): p.v for p in raster.rotated90(r, k).collect()} for k in (1, 3)]
