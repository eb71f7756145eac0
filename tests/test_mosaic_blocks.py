"""Mosaics are laid block by block: the first tile with data wins in every pixel, and no line becomes a row."""

import itertools

import pytest
from pyspark.sql import functions as F

from trackloom.operators import raster, terrain
from trackloom.operators.raster import pack_blocks

SIZE = 4
GRID = "track_id string, lod int, top double, left double, dx double, dy double, r0 bigint, c0 bigint, step_row int, step_col int, m_rows int, m_cols int"
TILES = "tile_id bigint, priority bigint, tile_left double, tile_top double, tile_dx double, tile_dy double, tile_rows int, tile_cols int"
KEY = ("track_id", "lod")


def elev(tile, r, c):
    return None if (r * 3 + c + tile) % 4 == 0 else float(1000 * tile + 20 * r + c)


@pytest.fixture
def laid(spark):
    """Grids of several blocks, one with every second row and one of no tile, under tiles of which the last is the coarser."""
    grids = [("a", 0, 10.0, 0.0, 1.0, 1.0, 0, 0, 1, 1, 10, 11), ("a", 1, 10.0, 0.0, 1.0, 1.0, 0, 0, 2, 1, 5, 11), (None, 0, 10.0, 50.0, 1.0, 1.0, 0, 0, 1, 1, 5, 2)]
    tiles = [(1, 5, 0.0, 10.0, 1.0, 1.0, 6, 7), (2, None, 3.0, 8.0, 1.0, 1.0, 6, 7), (3, 9, 0.0, 10.0, 2.0, 2.0, 4, 5)]
    px = [(t[0], r, c, elev(t[0], r, c)) for t in tiles for r, c in itertools.product(range(t[6]), range(t[7]))]
    dims = spark.createDataFrame([(t[0], t[6], t[7]) for t in tiles], "tile_id bigint, n_rows int, n_cols int")
    blocks = pack_blocks(spark.createDataFrame(px, "tile_id bigint, row int, col int, elev double"), dims, size=SIZE)
    g = spark.createDataFrame(grids, GRID)
    sources = g.where("track_id = 'a'").crossJoin(spark.createDataFrame(tiles, TILES))
    return grids, tiles, raster.mosaic_blocks(g, sources, blocks, KEY, SIZE)


def test_first_tile_with_data_wins(laid):
    grids, tiles, mosaic = laid
    got = {(r["track_id"], r["lod"], r["row"], r["col"]): r["elev"] for r in raster.unpack_blocks(mosaic, KEY).collect()}
    want = {}
    for g in grids:
        for r, c in itertools.product(range(g[10]), range(g[11])):
            lat, lon = g[2] - (r * g[8] + 0.5) * g[5], g[3] + (c * g[9] + 0.5) * g[4]
            # a tile without a priority comes first
            for t in sorted(tiles, key=lambda t: t[1] or 0) if g[0] else []:
                i, j = int((t[3] - lat) // t[5]), int((lon - t[2]) // t[4])
                value = elev(t[0], i, j) if 0 <= i < t[6] and 0 <= j < t[7] else None
                if value is not None:
                    break
            else:
                value = None
            want[g[0], g[1], r, c] = value
    assert got == want and len({v for v in want.values() if v and v >= 3000}) > 3
    blocks = mosaic.where("track_id = 'a' AND lod = 0").select("brow", "bcol", "height", "width", F.size("values").alias("n")).collect()
    assert len(blocks) == 9 and all(b["n"] == b["height"] * b["width"] for b in blocks)


def test_no_line_is_a_row_of_its_own(laid):
    plan = laid[2]._jdf.queryExecution().optimizedPlan().toString()
    mosaic = plan.split("FlatMapGroupsInArrow")[1].split("Join")[0]
    assert "collect_list" not in mosaic and "posexplode" not in mosaic


def test_windows_are_found_once(spark, monkeypatch):
    """Grids and sources start from one table of windows."""
    calls = []
    real = terrain.settle
    monkeypatch.setattr(terrain, "settle", lambda df, label="table": calls.append(label) or real(df, label))
    bounds = spark.createDataFrame([("a", 8.1, 47.1, 8.3, 47.3)], "track_id string, lon_min double, lat_min double, lon_max double, lat_max double")
    tiles = spark.createDataFrame(
        [(1, 1, 8.0, 47.0, 9.0, 48.0, 0.1, 0.1, 10, 10)],
        "tile_id bigint, priority bigint, left double, bottom double, right double, top double, dx double, dy double, n_rows int, n_cols int",
    )
    grids, sources = terrain.mosaic_windows(bounds, tiles)
    assert grids.count() == sources.count() == 3 and calls == ["windows", "level-grids"]
