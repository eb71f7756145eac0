"""Elevation grids: which tile, which pixel, and grid operations.

``tiles`` has ``(tile_id, priority, left, bottom, right, top, dx, dy, n_rows, n_cols)``; ``pixels`` is a table of blocks (see
``raster``) or has ``(tile_id, row, col, elev)`` with row 0 in the north and NULL for no data, and is packed then. A spatial
range join becomes an equi-join on degree cells, and the pixel lookup one on blocks; both salt hot places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import raster
from trackloom.operators.raster import as_blocks, gaussian_weights
from trackloom.plans.session import settle
from trackloom.plans.skew import Keys, skew_join

# Detail levels as (level, metres per pixel, pixels per axis).
LODS = ((0, 10.0, 2000), (1, 50.0, 1000), (2, 200.0, 500))
PADDING_DEG = 0.005
PADDING_SHARE = 0.15
BYTES_PER_VERTEX = 3
BYTES_FIXED = 200_000
POINT: Keys = ("track_id", "idx")


def pixel_centre(row, col_) -> tuple[Column, Column]:
    """(lat, lon) of a pixel's centre from its tile's origin and step."""
    lat = F.col("top") - (S.col(row) + S.number(0.5)) * F.col("dy")
    lon = F.col("left") + (S.col(col_) + S.number(0.5)) * F.col("dx")
    return lat, lon


def _cells(lo: str, hi: str, cell_deg: float) -> Column:
    return F.sequence(F.floor(F.col(lo) / S.number(cell_deg)), F.floor(F.col(hi) / S.number(cell_deg)))


def _boxes_by_cell(df: DataFrame, west: str, south: str, east: str, north: str, cell_deg: float) -> DataFrame:
    return df.withColumn("_cx", F.explode(_cells(west, east, cell_deg))).withColumn(
        "_cy", F.explode(_cells(south, north, cell_deg))
    )


def point_in_tile(points: DataFrame, tiles: DataFrame, cell_deg: float = 1.0, key: Keys = POINT) -> DataFrame:
    """The first tile by priority that holds each point, and the pixel in it; points outside are absent."""
    key = list(key)
    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        *key,
        "lat",
        "lon",
        F.floor(F.col("lon") / S.number(cell_deg)).alias("_cx"),
        F.floor(F.col("lat") / S.number(cell_deg)).alias("_cy"),
    )
    near = skew_join(placed, _boxes_by_cell(tiles, "left", "bottom", "right", "top", cell_deg), ["_cx", "_cy"], "inner")
    inside = near.where(F.col("lon").between(F.col("left"), F.col("right")) & F.col("lat").between(F.col("bottom"), F.col("top")))
    row = F.least(F.floor((F.col("top") - F.col("lat")) / F.col("dy")), F.col("n_rows") - 1)
    col_ = F.least(F.floor((F.col("lon") - F.col("left")) / F.col("dx")), F.col("n_cols") - 1)
    pixel = F.struct("tile_id", row.cast("int").alias("row"), col_.cast("int").alias("col"))
    return inside.groupBy(*key).agg(F.min_by(pixel, "priority").alias("_p")).select(*key, "_p.*")


def pixel_lookup(located: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add ``terrain_elev`` of the pixel; a pixel without data gives NULL and no other tile is tried."""
    return raster.block_lookup(located, as_blocks(pixels))


def sample_dem_nearest(points: DataFrame, tiles: DataFrame, pixels: DataFrame, cell_deg: float = 1.0, key: Keys = POINT) -> DataFrame:
    """Every point with the raw elevation of the pixel that contains it."""
    found = pixel_lookup(point_in_tile(points, tiles, cell_deg, key), as_blocks(pixels, tiles)).select(*key, "terrain_elev")
    return points.join(found, list(key), "left")


def enrich_terrain(
    points: DataFrame, tiles: DataFrame, pixels: DataFrame, z_offset: float = 0.0, cell_deg: float = 1.0
) -> DataFrame:
    """Terrain elevation and height above terrain."""
    sampled = sample_dem_nearest(points, tiles, pixels, cell_deg)
    return sampled.withColumn("above_terrain", F.col("alt") + S.number(z_offset) - F.col("terrain_elev"))


def above_neutral(df: DataFrame) -> DataFrame:
    """Height above terrain without any offset, as exported."""
    return df.withColumn("above_terrain", F.col("alt") - F.col("terrain_elev"))


def sample_dem_bilinear(points: DataFrame, tiles: DataFrame, pixels: DataFrame, cell_deg: float = 1.0, key: Keys = POINT) -> DataFrame:
    """Elevation between the four pixel centres around a point; unknown neighbours count as 0, outside is NULL.

    The four pixels are taken from one block, from more only where it ends between them.
    """
    key = list(key)
    half_x, half_y = F.col("dx") / 2, F.col("dy") / 2
    nodes = tiles.withColumns(
        {"_w": F.col("left") + half_x, "_e": F.col("left") + (F.col("n_cols") - 0.5) * F.col("dx"),
         "_nn": F.col("top") - half_y, "_s": F.col("top") - (F.col("n_rows") - 0.5) * F.col("dy")}
    ).where((F.col("n_rows") > 1) & (F.col("n_cols") > 1))
    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        *key, "lat", "lon",
        F.floor(F.col("lon") / S.number(cell_deg)).alias("_cx"),
        F.floor(F.col("lat") / S.number(cell_deg)).alias("_cy"),
    )
    near = skew_join(placed, _boxes_by_cell(nodes, "_w", "_s", "_e", "_nn", cell_deg), ["_cx", "_cy"], "inner")
    inside = near.where(F.col("lon").between(F.col("_w"), F.col("_e")) & F.col("lat").between(F.col("_s"), F.col("_nn")))
    fc = (F.col("lon") - F.col("_w")) / (F.col("_e") - F.col("_w")) * (F.col("n_cols") - 1)
    fr = (F.col("lat") - F.col("_s")) / (F.col("_nn") - F.col("_s")) * (F.col("n_rows") - 1)
    spot = F.struct("tile_id", "n_rows", "n_cols", fc.alias("fc"), fr.alias("fr"))
    best = inside.groupBy(*key).agg(F.min_by(spot, "priority").alias("p")).select(*key, "p.*")
    best = best.withColumns(
        {"c0": F.least(F.floor("fc"), F.col("n_cols") - 2).cast("int"), "r0": F.least(F.floor("fr"), F.col("n_rows") - 2).cast("int")}
    ).withColumns({"tc": F.col("fc") - F.col("c0"), "tr": F.col("fr") - F.col("r0")})
    corners = F.array(
        *[
            F.struct(
                # r0 counts from the south, pixel rows from the north
                (F.col("n_rows") - 1 - (F.col("r0") + dr)).cast("int").alias("row"),
                (F.col("c0") + dc).alias("col"),
                ((F.col("tc") if dc else 1 - F.col("tc")) * (F.col("tr") if dr else 1 - F.col("tr"))).alias("weight"),
            )
            for dr in (0, 1)
            for dc in (0, 1)
        ]
    )
    wanted = best.select(*key, "tile_id", corners.alias("corners"))
    return points.join(raster.weighted_lookup(wanted, as_blocks(pixels, tiles), key), key, "left")


# --- grids ----------------------------------------------------------------------------------


def padded_box(bounds: DataFrame) -> DataFrame:
    """Track bounds widened by a fixed margin and a share of the smaller span."""
    pad = S.number(PADDING_DEG) + F.least(
        S.number(PADDING_SHARE) * (F.col("lon_max") - F.col("lon_min")),
        S.number(PADDING_SHARE) * (F.col("lat_max") - F.col("lat_min")),
    )
    return bounds.select(
        "track_id",
        (F.col("lon_min") - pad).alias("box_w"),
        (F.col("lat_min") - pad).alias("box_s"),
        (F.col("lon_max") + pad).alias("box_e"),
        (F.col("lat_max") + pad).alias("box_n"),
    )


def prune_tiles(bounds: DataFrame, tiles: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Tiles that truly overlap the padded bounds of each track."""
    boxes = _boxes_by_cell(padded_box(bounds), "box_w", "box_s", "box_e", "box_n", cell_deg)
    grid = _boxes_by_cell(tiles, "left", "bottom", "right", "top", cell_deg)
    return (
        skew_join(boxes, grid, ["_cx", "_cy"], "inner")
        .where(
            (F.col("left") < F.col("box_e")) & (F.col("right") > F.col("box_w"))
            & (F.col("bottom") < F.col("box_n")) & (F.col("top") > F.col("box_s"))
        )
        .drop("_cx", "_cy")
        .distinct()
    )


def _covered(bounds: DataFrame, tiles: DataFrame, cell_deg: float) -> DataFrame:
    """Per track and overlapping tile the rows and columns whose pixel centres lie in the padded bounds, if there are any."""
    west, east = F.greatest("box_w", "left"), F.least("box_e", "right")
    south, north = F.greatest("box_s", "bottom"), F.least("box_n", "top")
    # a centre lies at origin + (i + 0.5) * step
    windows = prune_tiles(bounds, tiles, cell_deg).withColumns(
        {
            "c0": F.greatest(F.lit(0), F.ceil((west - F.col("left")) / F.col("dx") - S.number(0.5))),
            "c1": F.least(F.col("n_cols") - 1, F.floor((east - F.col("left")) / F.col("dx") - S.number(0.5))),
            "r0": F.greatest(F.lit(0), F.ceil((F.col("top") - north) / F.col("dy") - S.number(0.5))),
            "r1": F.least(F.col("n_rows") - 1, F.floor((F.col("top") - south) / F.col("dy") - S.number(0.5))),
        }
    )
    return windows.where((F.col("c0") <= F.col("c1")) & (F.col("r0") <= F.col("r1")))


def _sized(windows: DataFrame) -> list[Column]:
    """Number of rows and columns of a window, and its middle latitude."""
    lat0, lat1 = pixel_centre("r0", "c0")[0], pixel_centre("r1", "c0")[0]
    return [
        (F.col("r1") - F.col("r0") + 1).cast("int").alias("n_rows"),
        (F.col("c1") - F.col("c0") + 1).cast("int").alias("n_cols"),
        ((lat0 + lat1) / 2).alias("mid_lat"),
    ]


def clip_windows(bounds: DataFrame, tiles: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Per track and overlapping tile the rows and columns whose pixel centres lie in the padded bounds."""
    windows = _covered(bounds, tiles, cell_deg)
    return windows.select("track_id", "tile_id", "priority", "left", "top", "dx", "dy", "c0", "c1", "r0", "r1", *_sized(windows))


def clip_pixels(windows: DataFrame, pixels: DataFrame) -> DataFrame:
    """The pixels inside each window, renumbered from its first row and column; a window meets the blocks that it touches."""
    held = ("track_id", "n_rows", "n_cols", "left", "top", "dx", "dy", "r0", "c0")
    cells = raster.clip_blocks(windows, as_blocks(pixels), held)
    lat, lon = pixel_centre(F.col("row") + F.col("r0"), F.col("col") + F.col("c0"))
    return cells.select(
        "track_id", "tile_id", "priority", "row", "col", "n_rows", "n_cols", "dx", "dy", lat.alias("lat"), lon.alias("lon"), "elev"
    )


def clip_dem(bounds: DataFrame, tiles: DataFrame, pixels: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """The part of each overlapping tile around each track; grids are keyed ``(track_id, tile_id)``."""
    return clip_pixels(clip_windows(bounds, tiles, cell_deg), as_blocks(pixels, tiles))


def downsample_steps(n_rows, n_cols, dx, dy, ref_lat, target_m: float | None, max_px: int | None) -> tuple[Column, Column]:
    """(row step, column step): the coarser of the wanted pixel size and the axis limit, at least 1."""
    one = F.lit(1)
    row_steps, col_steps = [one], [one]
    if target_m:
        k = S.number(S.METRES_PER_DEGREE)
        row_steps.append(F.floor(S.number(target_m) / (S.col(dy) * k)).cast("int"))
        col_steps.append(F.floor(S.number(target_m) / (S.col(dx) * (k * F.cos(F.radians(S.col(ref_lat)))))).cast("int"))
    if max_px:
        row_steps.append(F.ceil(S.col(n_rows) / F.lit(max_px)).cast("int"))
        col_steps.append(F.ceil(S.col(n_cols) / F.lit(max_px)).cast("int"))
    return F.greatest(one, *row_steps), F.greatest(one, *col_steps)


def decimate_dem(grid: DataFrame, step_row: Column, step_col: Column) -> DataFrame:
    """Every step-th row and column from the first, renumbered."""
    df = grid.withColumns({"_sr": step_row, "_sc": step_col}).where(
        (F.col("row") % F.col("_sr") == 0) & (F.col("col") % F.col("_sc") == 0)
    )
    out = {
        "row": F.floor(F.col("row") / F.col("_sr")).cast("int"),
        "col": F.floor(F.col("col") / F.col("_sc")).cast("int"),
    }
    if "n_rows" in grid.columns:
        out["n_rows"] = F.ceil(F.col("n_rows") / F.col("_sr")).cast("int")
        out["n_cols"] = F.ceil(F.col("n_cols") / F.col("_sc")).cast("int")
    return df.withColumns(out).drop("_sr", "_sc")


def smooth_dem(grid: DataFrame, sigma: float = 1.0, key: Keys = ("track_id", "tile_id")) -> DataFrame:
    """Gaussian blur of grids of pixels, first along columns, then along rows, block by block with a halo.

    Unknown pixels take the grid's mean while blurring and are unknown again afterwards. Further columns stay.
    """
    key = list(key)
    blocks = raster.pack_blocks(grid.select(*key, "row", "col", "elev"), None, key, kind="double")
    blurred = raster.unpack_blocks(raster.smooth_blocks(blocks, sigma, key), key)
    rest = [c for c in grid.columns if c not in (*key, "row", "col", "elev")]
    return blurred.join(grid.drop("elev"), [*key, "row", "col"]).select(*grid.columns) if rest else blurred


def mosaic_dem(pixels: DataFrame, tiles: DataFrame, key: Keys = ()) -> DataFrame:
    """Tiles of one resolution as one grid on a common raster; the first tile with data wins.

    The result has global ``(row, col)`` counted from latitude 90 and longitude -180. With ``key`` the pixels
    carry a grouping such as ``track_id`` and each group becomes its own mosaic.
    """
    placed = pixels.select(*key, "tile_id", "row", "col", "elev").join(
        tiles.select("tile_id", "priority", "left", "top", "dx", "dy"), "tile_id"
    )
    lat, lon = pixel_centre("row", "col")
    return (
        placed.withColumns({"lat": lat, "lon": lon})
        .withColumns(
            {
                "grow": F.round((S.number(90) - F.col("lat")) / F.col("dy") - S.number(0.5)).cast("bigint"),
                "gcol": F.round((F.col("lon") + S.number(180)) / F.col("dx") - S.number(0.5)).cast("bigint"),
            }
        )
        .groupBy(*key, F.col("grow").alias("row"), F.col("gcol").alias("col"))
        .agg(
            F.min_by("elev", F.when(F.col("elev").isNotNull(), F.col("priority"))).alias("elev"),
            F.min("lat").alias("lat"),
            F.min("lon").alias("lon"),
        )
    )


def _level_steps(windows: DataFrame, levels=LODS) -> DataFrame:
    """A row for each window and level, with the steps between the rows and columns that stay."""
    table = F.array(
        *[F.struct(F.lit(i).alias("lod"), S.number(m).alias("m"), F.lit(px).alias("px")) for i, m, px in levels]
    )
    sized = windows.select("*", F.inline(table))
    k = S.number(S.METRES_PER_DEGREE)

    def step(n: str, size: Column) -> Column:
        return F.greatest(
            F.lit(1), F.floor(F.col("m") / size).cast("int"), F.ceil(F.col(n) / F.col("px")).cast("int")
        )

    sized = sized.withColumns(
        {
            "step_row": step("n_rows", F.col("dy") * k),
            "step_col": step("n_cols", F.col("dx") * (k * F.cos(F.radians("mid_lat")))),
        }
    )
    kept = {"m_rows": F.ceil(F.col("n_rows") / F.col("step_row")), "m_cols": F.ceil(F.col("n_cols") / F.col("step_col"))}
    return sized.withColumns({n: c.cast("int") for n, c in kept.items()})


def lod_windows(windows: DataFrame, levels=LODS) -> DataFrame:
    """Per track and level the window with the most pixels after decimation, with its steps."""
    sized = _level_steps(windows, levels)
    return largest_tile(sized.withColumn("n_pixels", F.col("m_rows").cast("bigint") * F.col("m_cols")))


_GRID = ("top", "left", "dx", "dy", "r0", "c0", "step_row", "step_col", "m_rows", "m_cols")


def mosaic_windows(bounds: DataFrame, tiles: DataFrame, levels=LODS, cell_deg: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(grids, sources): per track and level a window on the raster of its first tile, over all of its tiles; and these tiles."""
    # written once: the grids and their sources both start from them
    covered = settle(_covered(bounds, tiles, cell_deg), "windows")
    base = covered.groupBy("track_id").agg(
        F.min_by(F.struct("left", "top", "dx", "dy"), "priority").alias("_b"),
        F.greatest(F.max("box_w"), F.min("left")).alias("_w"), F.least(F.min("box_e"), F.max("right")).alias("_e"),
        F.greatest(F.max("box_s"), F.min("bottom")).alias("_s"), F.least(F.min("box_n"), F.max("top")).alias("_n"),
    ).select("track_id", "_b.*", "_w", "_e", "_s", "_n")
    half = S.number(0.5)
    base = base.withColumns(
        {
            "c0": F.ceil((F.col("_w") - F.col("left")) / F.col("dx") - half), "c1": F.floor((F.col("_e") - F.col("left")) / F.col("dx") - half),
            "r0": F.ceil((F.col("top") - F.col("_n")) / F.col("dy") - half), "r1": F.floor((F.col("top") - F.col("_s")) / F.col("dy") - half),
        }
    ).where("c0 <= c1 and r0 <= r1")
    sized = _level_steps(base.select("track_id", "left", "top", "dx", "dy", "r0", "c0", *_sized(base)), levels)
    grids = settle(sized.select("track_id", "lod", *_GRID), "level-grids")
    return grids, grids.join(_tiles_of(covered).select("track_id", *_TILE), "track_id")


_TILE = ("tile_id", "priority", "tile_left", "tile_top", "tile_dx", "tile_dy", "tile_rows", "tile_cols")


def _tiles_of(windows: DataFrame) -> DataFrame:
    own = {"tile_left": "left", "tile_top": "top", "tile_dx": "dx", "tile_dy": "dy", "tile_rows": "n_rows", "tile_cols": "n_cols"}
    return windows.withColumns({n: F.col(c) for n, c in own.items()})


def dem_lods(
    bounds: DataFrame, tiles: DataFrame, pixels: DataFrame, levels=LODS, sigma: float = 1.0, cell_deg: float = 1.0, largest: bool = False
) -> DataFrame:
    """Detail levels around each track as blocks ``(track_id, lod, brow, bcol, ..., values)``, decimated and blurred.

    A level is the mosaic of all tiles under the track, on the raster of the first of them by priority: each of its pixels takes
    the first tile that has data there. With ``largest`` it is the clip of one tile, that with the most pixels, whose
    ``tile_id`` is given. lat0, lon0 are the centre of the first pixel, dlat and dlon the steps to the south and east.
    """
    if largest:
        grids = lod_windows(clip_windows(bounds, tiles, cell_deg), levels)
        dims = tiles.select("tile_id", F.col("n_rows").alias("tile_rows"), F.col("n_cols").alias("tile_cols"))
        own = {f"tile_{c}": F.col(c) for c in ("left", "top", "dx", "dy")}
        sources = grids.withColumns(own).join(dims, "tile_id").select("track_id", "lod", *_GRID, *_TILE)
    else:
        grids, sources = mosaic_windows(bounds, tiles, levels, cell_deg)
    key = ("track_id", "lod")
    blocks = raster.mosaic_blocks(grids, sources, as_blocks(pixels, tiles), key)
    lat0, lon0 = pixel_centre("r0", "c0")
    place = grids.select(
        *key, *(["tile_id"] if largest else []), lat0.alias("lat0"), lon0.alias("lon0"),
        (F.col("step_row") * F.col("dy")).alias("dlat"), (F.col("step_col") * F.col("dx")).alias("dlon"),
    )
    return raster.smooth_blocks(blocks, sigma, key).join(place, list(key))


def level_pixels(levels: DataFrame) -> DataFrame:
    """The pixels of detail levels: row, col, elev, lat and lon, and ``tile_id`` where the levels have it."""
    keep = ["lat0", "lon0", "dlat", "dlon", *[c for c in ("tile_id",) if c in levels.columns]]
    cells = raster.unpack_blocks(levels, ("track_id", "lod"), keep)
    lat, lon = F.col("lat0") - F.col("row") * F.col("dlat"), F.col("lon0") + F.col("col") * F.col("dlon")
    return cells.withColumns({"lat": lat, "lon": lon}).drop("lat0", "lon0", "dlat", "dlon")


def largest_tile(sized: DataFrame, key: Keys = ("track_id", "lod")) -> DataFrame:
    """The tile with the most pixels; of equals the first by priority."""
    rest = [c for c in sized.columns if c not in key]
    order = F.struct(F.col("n_pixels"), -F.col("priority"))
    return sized.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_t")).select(*key, "_t.*")


def estimated_mb(vertices) -> Column:
    return (S.col(vertices) * BYTES_PER_VERTEX + BYTES_FIXED) / S.number(1024.0**2)


def budget_step(n_rows, n_cols, max_mb: float) -> Column:
    """1 if the grid fits, else the smallest step 2..10 that makes it fit, else 1."""
    rows, cols = S.col(n_rows), S.col(n_cols)
    fits = F.filter(
        F.sequence(F.lit(2), F.lit(10)),
        lambda s: estimated_mb(F.floor(rows / s) * F.floor(cols / s)) <= max_mb,
    )
    whole = estimated_mb(rows * cols) <= max_mb
    return F.when(whole, F.lit(1)).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(1)))


def reduce_to_budget(grid: DataFrame, max_mb: float = 100.0) -> DataFrame:
    """Thin grids whose estimated document would be too large."""
    step = budget_step("n_rows", "n_cols", max_mb)
    return decimate_dem(grid, step, step)
