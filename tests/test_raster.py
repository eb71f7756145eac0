"""Blocks of elevation grids: borders between blocks, mosaics of several tiles, documents in bands."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import raster, terrain
from trackloom.sinks import document
from trackloom.sources.dem import read_ascii_blocks, read_ascii_grid

PIXELS = "tile_id bigint, row int, col int, elev double"
TILES = "tile_id bigint, priority bigint, left double, bottom double, right double, top double, dx double, dy double, n_rows int, n_cols int"


def grid(rng, rows, cols, gaps=0.1):
    return [[None if rng.random() < gaps else float(rng.randrange(1000)) for _ in range(cols)] for _ in range(rows)]


def cells(tile, values):
    return [(tile, r, c, v) for r, line in enumerate(values) for c, v in enumerate(line)]


def blurred(values, sigma=1.0):
    """Plain Gaussian blur, columns first, mirrored at the ends; unknown pixels take the mean and stay unknown."""
    weights = terrain.gaussian_weights(sigma)
    reach = len(weights) // 2
    known = [v for line in values for v in line if v is not None]
    mean = math.nan if not known else sum(known) / len(known)
    work = [[mean if v is None else v for v in line] for line in values]

    def mirrored(i, n):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    n, m = len(work), len(work[0])
    work = [[sum(w * work[mirrored(r + k - reach, n)][c] for k, w in enumerate(weights)) for c in range(m)] for r in range(n)]
    work = [[sum(w * work[r][mirrored(c + k - reach, m)] for k, w in enumerate(weights)) for c in range(m)] for r in range(n)]
    return [[None if v is None else work[r][c] for c, v in enumerate(line)] for r, line in enumerate(values)]


@pytest.mark.parametrize("size", [4, 5, 256])
def test_blur_across_blocks(spark, size):
    rng = random.Random(size)
    shapes = [(1, 1), (3, 2), (7, 13), (12, 5), (9, 9), (16, 4)]
    grids = {i: grid(rng, *shape) for i, shape in enumerate(shapes)}
    grids[99] = [[None, None], [None, None]]
    px = spark.createDataFrame([x for i, g in grids.items() for x in cells(i, g)], PIXELS)
    blocks = raster.smooth_blocks(raster.pack_blocks(px, size=size, kind="double"), size=size)
    got = {(r["tile_id"], r["row"], r["col"]): r["elev"] for r in raster.unpack_blocks(blocks).collect()}
    want = {x[:3]: x[3] for i, g in grids.items() for x in cells(i, blurred(g))}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-9)


def test_absent_pixels_and_lines_are_unknown(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 3, 2.0), (1, 5, 1, 3.0)]
    dims = spark.createDataFrame([(1, 7, 5)], "tile_id bigint, n_rows int, n_cols int")
    got = raster.unpack_blocks(raster.pack_blocks(spark.createDataFrame(rows, PIXELS), dims, size=3, kind="double"))
    found = {(r["row"], r["col"]): r["elev"] for r in got.where("elev is not null").collect()}
    assert found == {(r, c): v for _, r, c, v in rows}
    # blocks without any pixel are not kept; a lookup there finds nothing
    at = spark.createDataFrame([(1, 0, 3), (1, 6, 4), (1, 5, 1), (2, 0, 0)], "tile_id bigint, row int, col int")
    looked = raster.block_lookup(at, raster.pack_blocks(spark.createDataFrame(rows, PIXELS), dims, size=3), size=3)
    assert sorted((r["tile_id"], r["row"], r["terrain_elev"]) for r in looked.collect()) == [(1, 0, 2.0), (1, 5, 3.0), (1, 6, None), (2, 0, None)]


def test_sampling_across_the_border_of_blocks(spark):
    """A tile of 260 x 300 pixels takes four blocks; values are linear, so bilinear sampling is exact."""
    n, m = 260, 300
    px = spark.range(n * m).select(
        F.lit(1).cast("bigint").alias("tile_id"), F.floor(F.col("id") / m).cast("int").alias("row"), (F.col("id") % m).cast("int").alias("col")
    ).withColumn("elev", (F.col("row") * 2 + F.col("col")).cast("double"))
    tiles = spark.createDataFrame([(1, 1, 8.0, 47.0, 8.0 + m / 1000, 47.0 + n / 1000, 0.001, 0.001, n, m)], TILES)
    spots = [(r, c) for r in (0.4, 254.7, 255.45, 256.2, 258.9) for c in (1.25, 254.9, 255.1, 256.0, 298.4)]
    points = spark.createDataFrame(
        [("t", i, 47.0 + n / 1000 - (r + 0.5) / 1000, 8.0 + (c + 0.5) / 1000) for i, (r, c) in enumerate(spots)], "track_id string, idx bigint, lat double, lon double"
    )
    lerp = {r["idx"]: r["terrain_elev"] for r in terrain.sample_dem_bilinear(points, tiles, px).collect()}
    near = {r["idx"]: r["terrain_elev"] for r in terrain.sample_dem_nearest(points, tiles, px).collect()}
    for i, (r, c) in enumerate(spots):
        assert lerp[i] == pytest.approx(2 * r + c, abs=1e-6)
        assert near[i] == 2 * math.floor(r + 0.5) + math.floor(c + 0.5)


def mosaic_of(tiles, pixels, base, window, step):
    """{(i, j): first value by priority} of a window on the raster of ``base``; tiles as dicts, pixels by (tile, row, col)."""
    out = {}
    r0, c0, n, m = window
    for i in range(-(-n // step)):
        for j in range(-(-m // step)):
            lat = base["top"] - (r0 + i * step + 0.5) * base["dy"]
            lon = base["left"] + (c0 + j * step + 0.5) * base["dx"]
            out[i, j] = None
            for t in sorted(tiles, key=lambda t: t["priority"]):
                r, c = math.floor((t["top"] - lat) / t["dy"] + 1e-6), math.floor((lon - t["left"]) / t["dx"] + 1e-6)
                if pixels.get((t["tile_id"], r, c)) is not None:
                    out[i, j] = pixels[t["tile_id"], r, c]
                    break
    return out


@pytest.mark.parametrize(("size", "step"), [(4, 1), (4, 3), (7, 2), (256, 1)])
def test_mosaic_of_neighbours_overlaps_and_other_resolutions(spark, size, step):
    rng = random.Random(size * 10 + step)
    shapes = [(1, 3, 8.0, 47.1, 0.01, 10, 12), (2, 1, 8.1, 47.1, 0.01, 10, 11), (3, 2, 8.0, 47.0, 0.02, 8, 9), (4, 9, 9.0, 47.0, 0.01, 3, 3)]
    tiles, pixels, rows = [], {}, []
    for tile, priority, left, top, d, n, m in shapes:
        tiles.append(dict(tile_id=tile, priority=priority, left=left, bottom=top - n * d, right=left + m * d, top=top, dx=d, dy=d, n_rows=n, n_cols=m))
        values = cells(tile, grid(rng, n, m, 0.2))
        rows += values
        pixels |= {(t, r, c): v for t, r, c, v in values}
    window = (-2, -3, 25, 31)
    base = tiles[0]
    own = [(t["tile_id"], t["priority"], t["left"], t["top"], t["dx"], t["dy"], t["n_rows"], t["n_cols"]) for t in tiles]
    grids = spark.createDataFrame(
        [("a", base["top"], base["left"], base["dx"], base["dy"], *window[:2], step, step, -(-window[2] // step), -(-window[3] // step))],
        "track_id string, top double, left double, dx double, dy double, r0 bigint, c0 bigint, step_row int, step_col int, m_rows int, m_cols int",
    )
    names = "tile_id bigint, priority bigint, tile_left double, tile_top double, tile_dx double, tile_dy double, tile_rows int, tile_cols int"
    sources = grids.join(spark.createDataFrame(own, names))
    blocks = raster.pack_blocks(spark.createDataFrame(rows, PIXELS), size=size)
    made = raster.mosaic_blocks(grids, sources, blocks, ("track_id",), size)
    got = {(r["row"], r["col"]): r["elev"] for r in raster.unpack_blocks(made, ("track_id",)).collect()}
    assert got == mosaic_of(tiles, pixels, base, window, step)


def test_levels_show_all_tiles_under_a_track(spark):
    """A track over two tiles side by side: both are in the level, and in its documents; the flag takes the larger one."""
    tiles = spark.createDataFrame([(1, 1, 8.0, 47.0, 8.1, 47.1, 0.001, 0.001, 100, 100), (2, 2, 8.1, 47.0, 8.3, 47.1, 0.001, 0.001, 100, 200)], TILES)
    px = tiles.select("tile_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"), "n_cols").select(
        "tile_id", "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"), (F.col("tile_id") * 100).cast("double").alias("elev")
    )
    bounds = spark.createDataFrame([("t", 8.05, 8.2, 47.03, 47.07)], "track_id string, lon_min double, lon_max double, lat_min double, lat_max double")
    levels = terrain.dem_lods(bounds, tiles, px).cache()
    shown = terrain.level_pixels(levels).where("lod = 0")
    west, east = shown.where("lon < 8.095"), shown.where("lon > 8.105")
    assert {round(r[0], 6) for r in west.select("elev").distinct().collect()} == {100.0}
    assert {round(r[0], 6) for r in east.select("elev").distinct().collect()} == {200.0}
    one = terrain.dem_lods(bounds, tiles, px, largest=True)
    assert {r["tile_id"] for r in one.select("tile_id").collect()} == {2}
    docs = [json.loads(r["document"]) for r in document.dem_documents(levels, bounds).orderBy("lod", "part").collect()]
    assert [d["lod"] for d in docs] == [0, 1, 2]
    first = docs[0]["grid"]
    assert len(first["elevations"]) == first["n_rows"] * first["n_cols"] == shown.count() and {100.0, 200.0} <= set(first["elevations"])


def test_documents_in_bands(spark, monkeypatch):
    monkeypatch.setattr(document, "BAND_ROWS", 3)
    values = [[float(r * 10 + c) for c in range(6)] for r in range(8)]
    rows = [("t", 0, r, c, v) for r, line in enumerate(values) for c, v in enumerate(line)]
    blocks = raster.pack_blocks(spark.createDataFrame(rows, "track_id string, lod int, row int, col int, elev double"), None, ("track_id", "lod"), 4, "double")
    placed = blocks.withColumns({"lat0": F.lit(47.0), "lon0": F.lit(8.0), "dlat": F.lit(0.1), "dlon": F.lit(0.2)})
    bounds = spark.createDataFrame([("t", 8.0)], "track_id string, lon_min double")
    grids = [json.loads(r["document"])["grid"] for r in document.dem_documents(placed, bounds).orderBy("part").collect()]
    assert [g["first_row"] for g in grids] == [0, 3, 6]
    assert [v for g in grids for v in g["elevations"]] == [v for line in reversed(values) for v in line]
    assert all((g["lat_min"], g["lat_max"], g["lon_max"]) == (46.3, 47.0, 9.0) for g in grids)


def test_ascii_grids_as_blocks(spark, tmp_path):
    rng = random.Random(4)
    for name, n, m in (("a", 5, 7), ("b", 3, 2)):
        body = "\n".join(" ".join(str(rng.choice([-9999, rng.randrange(900)])) for _ in range(m)) for _ in range(n))
        (tmp_path / f"{name}.asc").write_text(f"ncols {m}\nnrows {n}\nxllcorner 8\nyllcorner 47\ncellsize 0.5\nNODATA_value -9999\n{body}\n")
    tiles, px = read_ascii_grid(spark, str(tmp_path))
    same, blocks = read_ascii_blocks(spark, str(tmp_path), size=3)
    assert sorted(map(str, tiles.collect())) == sorted(map(str, same.collect()))
    key = lambda df: sorted((r["tile_id"], r["row"], r["col"], r["elev"]) for r in df.collect())
    assert str(key(raster.unpack_blocks(blocks))) == str(key(px))
