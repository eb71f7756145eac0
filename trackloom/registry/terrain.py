"""Elevation grids. Two tiles per user, a fine one over the southern half of its area and a coarse one over all
of it; the pixel values come from the events that fall into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import summary, terrain
from trackloom.plans.sequence import row_index
from trackloom.registry import query
from trackloom.registry.fixtures import Q_IDX, Q_TRACK, track, with_
from trackloom.registry.points import rounded
from trackloom.sinks.document import dem_documents
from trackloom.sources.dem import with_centres

CELL = 0.02
_LEFT = "8 + (track_id - track_id % 10) / CAST(500 AS DOUBLE)"
_BOTTOM = "47 + (track_id % 10) / CAST(10 AS DOUBLE)"
_KINDS = (  # id offset, height, width, step, rows, columns
    (0, 50, 105, 5, 10, 21),
    (1_000_000, 100, 110, 10, 10, 11),
)
TILES = "\nUNION ALL\n".join(
    f"""SELECT track_id + {off} AS tile_id, track_id + {off} AS priority, w AS tl, s AS tb, w + {wide} / CAST(10000 AS DOUBLE) AS tr, s + {high} / CAST(10000 AS DOUBLE) AS tt,
  {step} / CAST(10000 AS DOUBLE) AS dx, {step} / CAST(10000 AS DOUBLE) AS dy, {rows} AS n_rows, {cols} AS n_cols
FROM (SELECT DISTINCT track_id, {_LEFT} AS w, {_BOTTOM} AS s FROM track)"""
    for off, high, wide, step, rows, cols in _KINDS
)
Q_TILES = f"tiles AS ({TILES})"
_ROW = "CAST(least(floor((tt - lat) / dy), n_rows - 1) AS INT)"
_COL = "CAST(least(floor((lon - tl) / dx), n_cols - 1) AS INT)"
Q_PIXELS = f"""filled_px AS (SELECT tile_id, {_ROW} AS r, {_COL} AS c, CAST(300 + sum(seq) % 200 AS DOUBLE) AS v
  FROM (SELECT t.*, p.lat, p.lon, p.seq FROM track p JOIN tiles t ON t.tile_id % 1000000 = p.track_id AND p.lat BETWEEN tb AND tt AND p.lon BETWEEN tl AND tr) GROUP BY 1, 2, 3),
pixels AS (SELECT g.tile_id, g.r, g.c, CASE WHEN (g.r + g.c) % 23 <> 0 THEN v END AS elev
  FROM (SELECT tile_id, r, CAST(unnest(range(n_cols)) AS INT) AS c FROM (SELECT tile_id, n_cols, CAST(unnest(range(n_rows)) AS INT) AS r FROM tiles)) g LEFT JOIN filled_px f ON f.tile_id = g.tile_id AND f.r = g.r AND f.c = g.c)"""
G_SQL = with_(Q_TRACK, Q_TILES, Q_PIXELS)
GI_SQL = with_(Q_TRACK, Q_IDX, Q_TILES, Q_PIXELS)


def tiles(spark, sf) -> DataFrame:
    names = {"tl": "left", "tb": "bottom", "tr": "right", "tt": "top"}
    return spark.sql(TILES.replace("FROM track)", "FROM {track})"), track=track(spark, sf)).withColumnsRenamed(names)


def pixels(spark, sf) -> DataFrame:
    t = tiles(spark, sf)
    p = track(spark, sf).select(F.col("track_id").alias("owner"), "lat", "lon", "seq")
    here = p.join(t.withColumn("owner", F.col("tile_id") % 1_000_000), "owner").where(
        F.col("lat").between(F.col("bottom"), F.col("top")) & F.col("lon").between(F.col("left"), F.col("right"))
    )
    row = F.least(F.floor((F.col("top") - F.col("lat")) / F.col("dy")), F.col("n_rows") - 1).cast("int")
    col = F.least(F.floor((F.col("lon") - F.col("left")) / F.col("dx")), F.col("n_cols") - 1).cast("int")
    known = here.groupBy("tile_id", row.alias("row"), col.alias("col")).agg((F.lit(300) + F.sum("seq") % 200).cast("double").alias("v"))
    grid = t.select("tile_id", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")).select(
        "tile_id", "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col")
    )
    elev = F.when((F.col("row") + F.col("col")) % 23 != 0, F.col("v"))
    return grid.join(known, ["tile_id", "row", "col"], "left").select("tile_id", "row", "col", elev.alias("elev"))


def _points(spark, sf) -> DataFrame:
    # some points lie outside every tile
    far = F.when(F.col("seq") % 21 == 0, F.col("lat") + 5).otherwise(F.col("lat"))
    return row_index(track(spark, sf)).withColumn("lat", far)


Q_FAR = "spots AS (SELECT * REPLACE (CASE WHEN seq % 21 = 0 THEN lat + 5 ELSE lat END AS lat) FROM pts)"
Q_LOCATED = f"""located AS (SELECT track_id, idx, arg_min({{'t': tile_id, 'r': {_ROW}, 'c': {_COL}}}, priority) AS p FROM spots JOIN tiles ON lon BETWEEN tl AND tr AND lat BETWEEN tb AND tt GROUP BY track_id, idx),
sampled AS (SELECT s.*, x.elev AS terrain_elev FROM spots s LEFT JOIN located l ON l.track_id = s.track_id AND l.idx = s.idx LEFT JOIN pixels x ON x.tile_id = l.p.t AND x.r = l.p.r AND x.c = l.p.c)"""
D_SQL = with_(Q_TRACK, Q_IDX, Q_TILES, Q_PIXELS, Q_FAR, Q_LOCATED)


@query("read_dem", G_SQL + "SELECT tile_id, r AS row_no, n_rows - 1 - r AS row_from_south, c AS col_no, round(tt - (r + 0.5::DOUBLE) * dy, 8) AS lat, round(tl + (c + 0.5::DOUBLE) * dx, 8) AS lon, elev FROM pixels JOIN tiles USING (tile_id)")
def read_dem(spark, sf):
    df = with_centres(pixels(spark, sf), tiles(spark, sf))
    return df.select("tile_id", F.col("row").alias("row_no"), "row_from_south", F.col("col").alias("col_no"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "elev")


@query("point_in_tile", D_SQL + "SELECT track_id, idx, p.t AS tile_id, p.r AS row_no, p.c AS col_no FROM located")
def point_in_tile(spark, sf):
    df = terrain.point_in_tile(_points(spark, sf), tiles(spark, sf), CELL)
    return df.select("track_id", "idx", "tile_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"))


@query("pixel_lookup", D_SQL + "SELECT l.track_id, l.idx, x.elev AS terrain_elev FROM located l LEFT JOIN pixels x ON x.tile_id = l.p.t AND x.r = l.p.r AND x.c = l.p.c")
def pixel_lookup(spark, sf):
    found = terrain.point_in_tile(_points(spark, sf), tiles(spark, sf), CELL)
    return terrain.pixel_lookup(found, pixels(spark, sf)).select("track_id", "idx", "terrain_elev")


@query("sample_dem_nearest", D_SQL + "SELECT track_id, idx, terrain_elev FROM sampled")
def sample_dem_nearest(spark, sf):
    return terrain.sample_dem_nearest(_points(spark, sf), tiles(spark, sf), pixels(spark, sf), CELL).select("track_id", "idx", "terrain_elev")


@query("enrich_terrain", D_SQL + "SELECT track_id, idx, terrain_elev, round(alt + 2.5 - terrain_elev, 6) AS above_terrain FROM sampled")
def enrich_terrain(spark, sf):
    df = terrain.enrich_terrain(_points(spark, sf), tiles(spark, sf), pixels(spark, sf), 2.5, CELL)
    return rounded(df, ["track_id", "idx", "terrain_elev"], above_terrain=6)


@query("above_neutral", D_SQL + "SELECT track_id, idx, round(alt - terrain_elev, 6) AS above_terrain FROM sampled")
def above_neutral(spark, sf):
    df = terrain.enrich_terrain(_points(spark, sf), tiles(spark, sf), pixels(spark, sf), 2.5, CELL)
    return rounded(terrain.above_neutral(df), ["track_id", "idx"], above_terrain=6)


Q_BILINEAR = """nodes AS (SELECT *, tl + dx / 2 AS w, tl + (n_cols - 0.5::DOUBLE) * dx AS e, tt - dy / 2 AS n, tt - (n_rows - 0.5::DOUBLE) * dy AS s FROM tiles),
spotted AS (SELECT track_id, idx, arg_min({'t': tile_id, 'nr': n_rows, 'nc': n_cols, 'fc': (lon - w) / (e - w) * (n_cols - 1), 'fr': (lat - s) / (n - s) * (n_rows - 1)}, priority) AS p
  FROM spots JOIN nodes ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY track_id, idx),
based AS (SELECT track_id, idx, p.t AS t, p.nr AS nr, p.fc AS fc, p.fr AS fr, CAST(least(floor(p.fc), p.nc - 2) AS INT) AS c0, CAST(least(floor(p.fr), p.nr - 2) AS INT) AS r0 FROM spotted),
mixed AS (SELECT b.track_id, b.idx, coalesce(a00.elev, 0) * (1 - (fc - c0)) * (1 - (fr - r0)) + coalesce(a10.elev, 0) * (fc - c0) * (1 - (fr - r0)) + coalesce(a01.elev, 0) * (1 - (fc - c0)) * (fr - r0) + coalesce(a11.elev, 0) * (fc - c0) * (fr - r0) AS h
  FROM based b LEFT JOIN pixels a00 ON a00.tile_id = t AND a00.r = nr - 1 - r0 AND a00.c = c0 LEFT JOIN pixels a10 ON a10.tile_id = t AND a10.r = nr - 1 - r0 AND a10.c = c0 + 1
  LEFT JOIN pixels a01 ON a01.tile_id = t AND a01.r = nr - 2 - r0 AND a01.c = c0 LEFT JOIN pixels a11 ON a11.tile_id = t AND a11.r = nr - 2 - r0 AND a11.c = c0 + 1)"""


@query(
    "sample_dem_bilinear",
    with_(Q_TRACK, Q_IDX, Q_TILES, Q_PIXELS, Q_FAR, Q_BILINEAR) + "SELECT s.track_id, s.idx, round(h, 5) AS terrain_elev FROM spots s LEFT JOIN mixed m ON m.track_id = s.track_id AND m.idx = s.idx",
)
def sample_dem_bilinear(spark, sf):
    df = terrain.sample_dem_bilinear(_points(spark, sf), tiles(spark, sf), pixels(spark, sf), CELL)
    return rounded(df, ["track_id", "idx"], terrain_elev=5)


Q_BOX = """bounds AS (SELECT track_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM track GROUP BY track_id),
box AS (SELECT track_id, w - pad AS w, s - pad AS s, e + pad AS e, n + pad AS n FROM (SELECT *, 0.005::DOUBLE + least(0.15::DOUBLE * (e - w), 0.15::DOUBLE * (n - s)) AS pad FROM bounds)),
pruned AS (SELECT b.*, t.* FROM box b JOIN tiles t ON tl < e AND tr > w AND tb < n AND tt > s)"""
Q_CLIP = """windows AS (SELECT *, greatest(0, ceil((greatest(w, tl) - tl) / dx - 0.5::DOUBLE)) AS c0, least(n_cols - 1, floor((least(e, tr) - tl) / dx - 0.5::DOUBLE)) AS c1,
  greatest(0, ceil((tt - least(n, tt)) / dy - 0.5::DOUBLE)) AS r0, least(n_rows - 1, floor((tt - greatest(s, tb)) / dy - 0.5::DOUBLE)) AS r1 FROM pruned),
clip AS (SELECT track_id, tile_id, priority, CAST(r - r0 AS INT) AS r, CAST(c - c0 AS INT) AS c, CAST(r1 - r0 + 1 AS INT) AS nr, CAST(c1 - c0 + 1 AS INT) AS nc, dx, dy, tt - (r + 0.5::DOUBLE) * dy AS lat, tl + (c + 0.5::DOUBLE) * dx AS lon, elev
  FROM windows JOIN pixels USING (tile_id) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)"""
C_SQL = with_(Q_TRACK, Q_TILES, Q_PIXELS, Q_BOX, Q_CLIP)


def _windows(spark, sf) -> DataFrame:
    return terrain.clip_windows(summary.track_bounds(track(spark, sf)), tiles(spark, sf), CELL)


def _clipped(spark, sf) -> DataFrame:
    return terrain.clip_dem(summary.track_bounds(track(spark, sf)), tiles(spark, sf), pixels(spark, sf), CELL)


def _lods(spark, sf, largest: bool) -> DataFrame:
    return terrain.dem_lods(summary.track_bounds(track(spark, sf)), tiles(spark, sf), pixels(spark, sf), cell_deg=CELL, largest=largest)


@query("prune_tiles", with_(Q_TRACK, Q_TILES, Q_BOX) + "SELECT track_id, tile_id FROM pruned")
def prune_tiles(spark, sf):
    return terrain.prune_tiles(summary.track_bounds(track(spark, sf)), tiles(spark, sf), CELL).select("track_id", "tile_id")


@query("clip_dem", C_SQL + "SELECT track_id, tile_id, r AS row_no, c AS col_no, nr AS n_rows, nc AS n_cols, round(lat, 8) AS lat, elev FROM clip")
def clip_dem(spark, sf):
    df = _clipped(spark, sf).withColumnsRenamed({"row": "row_no", "col": "col_no"})
    return rounded(df, ["track_id", "tile_id", "row_no", "col_no", "n_rows", "n_cols", "elev"], lat=8)


@query(
    "downsample_steps",
    with_(Q_TRACK, Q_TILES) + """SELECT tile_id, CAST(greatest(1, floor(200 / (dy * 111320::DOUBLE)), ceil(n_rows / 4)) AS INT) AS step_row,
  CAST(greatest(1, floor(200 / (dx * (111320::DOUBLE * cos(radians((tb + tt) / 2))))), ceil(n_cols / 4)) AS INT) AS step_col FROM tiles""",
)
def downsample_steps(spark, sf):
    t = tiles(spark, sf).withColumn("mid", (F.col("bottom") + F.col("top")) / 2)
    row, col = terrain.downsample_steps("n_rows", "n_cols", "dx", "dy", "mid", 200.0, 4)
    return t.select("tile_id", row.alias("step_row"), col.alias("step_col"))


@query("decimate_dem", G_SQL + "SELECT tile_id, CAST(floor(r / 2) AS INT) AS row_no, CAST(floor(c / 3) AS INT) AS col_no, elev FROM pixels WHERE r % 2 = 0 AND c % 3 = 0")
def decimate_dem(spark, sf):
    df = terrain.decimate_dem(pixels(spark, sf), F.lit(2), F.lit(3))
    return df.select("tile_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"), "elev")


_KERNEL = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-4, 5), terrain.gaussian_weights(1.0)))


def sql_smooth(source: str, key: str, out: str) -> str:
    """WITH items: ``source`` (key, r, c, elev) blurred along r, then along c."""
    using = ", ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(",")).replace(", ", " AND ")
    keys_a = ", ".join("a." + k.strip() for k in key.split(","))

    def axis(src: str, name: str, along: str, across: str) -> str:
        wanted = f"(((a.{along} + k) % (2 * n) + 2 * n) % (2 * n))"
        return f"""{name} AS (SELECT {keys_a}, a.r, a.c, sum(w * b.v) AS v FROM (SELECT *, max({along}) OVER (PARTITION BY {key}) + 1 AS n FROM {src}) a CROSS JOIN (VALUES {_KERNEL}) t(k, w)
  JOIN {src} b ON {using} AND b.{across} = a.{across} AND b.{along} = CASE WHEN {wanted} < n THEN {wanted} ELSE 2 * n - 1 - {wanted} END GROUP BY {keys_a}, a.r, a.c)"""

    return f"""{out}_f AS (SELECT {key}, r, c, coalesce(elev, avg(elev) OVER (PARTITION BY {key})) AS v FROM {source}),
{axis(out + '_f', out + '_1', 'r', 'c')},
{axis(out + '_1', out + '_2', 'c', 'r')},
{out} AS (SELECT {keys_a}, a.r, a.c, CASE WHEN a.elev IS NOT NULL THEN b.v END AS elev FROM {source} a LEFT JOIN {out}_2 b ON {using} AND a.r = b.r AND a.c = b.c)"""


@query("smooth_dem", with_(Q_TRACK, Q_TILES, Q_PIXELS, sql_smooth("pixels", "tile_id", "smooth")) + "SELECT tile_id, r AS row_no, c AS col_no, round(elev, 6) AS elev FROM smooth")
def smooth_dem(spark, sf):
    df = terrain.smooth_dem(pixels(spark, sf), 1.0, ("tile_id",))
    return df.select("tile_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.round("elev", 6).alias("elev"))


@query(
    "mosaic_dem",
    G_SQL + """SELECT track_id, step, CAST(round((90 - lat) / dy - 0.5::DOUBLE) AS BIGINT) AS row_no, CAST(round((lon + 180) / dx - 0.5::DOUBLE) AS BIGINT) AS col_no, arg_min(elev, p) FILTER (elev IS NOT NULL) AS elev
FROM (SELECT tile_id % 1000000 AS track_id, CAST(round(dx * 10000) AS INT) AS step, dx, dy, tt - (r + 0.5::DOUBLE) * dy AS lat, tl + (c + 0.5::DOUBLE) * dx AS lon, elev, 1 AS p FROM pixels JOIN tiles USING (tile_id)
  UNION ALL SELECT tile_id % 1000000, CAST(round(dx * 10000) AS INT), dx, dy, tt - (r + 0.5::DOUBLE) * dy, tl + (c + 0.5::DOUBLE) * dx, 500 + r, 2 FROM pixels JOIN tiles USING (tile_id) WHERE r % 2 = 0) GROUP BY ALL""",
)
def mosaic_dem(spark, sf):
    """The fine and the coarse tiles of each track, each resolution as one mosaic, under a second layer in every other row."""
    t = tiles(spark, sf)
    step = F.round(F.col("dx") * 10_000).cast("int").alias("step")
    first = pixels(spark, sf).join(t.select("tile_id", (F.col("tile_id") % 1_000_000).alias("track_id"), step), "tile_id")
    second = first.where(F.col("row") % 2 == 0).withColumns(
        {"tile_id": F.col("tile_id") + 10_000_000, "elev": (F.col("row") + 500).cast("double")}
    )
    copies = t.withColumns({"tile_id": F.col("tile_id") + 10_000_000, "priority": F.col("priority") + 10_000_000})
    df = terrain.mosaic_dem(first.unionByName(second), t.unionByName(copies), ("track_id", "step"))
    return df.select("track_id", "step", F.col("row").alias("row_no"), F.col("col").alias("col_no"), "elev")


Q_LODS = f"""lod_size AS (SELECT *, CAST(greatest(1, floor(m / (dy * 111320::DOUBLE)), ceil(nr / px)) AS INT) AS sr,
  CAST(greatest(1, floor(m / (dx * (111320::DOUBLE * cos(radians(mid))))), ceil(nc / px)) AS INT) AS sc
  FROM (SELECT track_id, tile_id, priority, nr, nc, dx, dy, (min(lat) + max(lat)) / 2 AS mid FROM clip GROUP BY ALL) CROSS JOIN (VALUES (0, 10::DOUBLE, 2000), (1, 50::DOUBLE, 1000), (2, 200::DOUBLE, 500)) l(lod, m, px)),
lod_best AS (SELECT * FROM lod_size QUALIFY row_number() OVER (PARTITION BY track_id, lod ORDER BY ceil(nr / sr) * ceil(nc / sc) DESC, priority) = 1),
thin AS (SELECT track_id, tile_id, lod, CAST(floor(r / sr) AS INT) AS r, CAST(floor(c / sc) AS INT) AS c, elev FROM clip JOIN lod_best b USING (track_id, tile_id) WHERE r % sr = 0 AND c % sc = 0),
{sql_smooth('thin', 'track_id, tile_id, lod', 'lods')}"""
L_SQL = with_(Q_TRACK, Q_TILES, Q_PIXELS, Q_BOX, Q_CLIP, Q_LODS)


@query("dem_lods", L_SQL + "SELECT track_id, tile_id, lod, r AS row_no, c AS col_no, round(elev, 6) AS elev FROM lods")
def dem_lods(spark, sf):
    df = terrain.level_pixels(_lods(spark, sf, True))
    return df.select("track_id", "tile_id", "lod", F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.round("elev", 6).alias("elev"))


Q_MOSAIC = f"""base AS (SELECT track_id, arg_min({{'l': tl, 't': tt, 'dx': dx, 'dy': dy}}, priority) AS b, greatest(max(w), min(tl)) AS w, least(min(e), max(tr)) AS e, greatest(max(s), min(tb)) AS s, least(min(n), max(tt)) AS n
  FROM windows WHERE r0 <= r1 AND c0 <= c1 GROUP BY track_id),
frame AS (SELECT track_id, b.l AS bl, b.t AS bt, b.dx AS bdx, b.dy AS bdy, ceil((w - b.l) / b.dx - 0.5::DOUBLE) AS fc0, floor((e - b.l) / b.dx - 0.5::DOUBLE) AS fc1, ceil((b.t - n) / b.dy - 0.5::DOUBLE) AS fr0, floor((b.t - s) / b.dy - 0.5::DOUBLE) AS fr1 FROM base),
level AS (SELECT *, CAST(greatest(1, floor(m / (bdy * 111320::DOUBLE)), ceil((fr1 - fr0 + 1) / px)) AS INT) AS sr,
  CAST(greatest(1, floor(m / (bdx * (111320::DOUBLE * cos(radians(((bt - (fr0 + 0.5::DOUBLE) * bdy) + (bt - (fr1 + 0.5::DOUBLE) * bdy)) / 2))))), ceil((fc1 - fc0 + 1) / px)) AS INT) AS sc
  FROM frame CROSS JOIN (VALUES (0, 10::DOUBLE, 2000), (1, 50::DOUBLE, 1000), (2, 200::DOUBLE, 500)) l(lod, m, px) WHERE fr0 <= fr1 AND fc0 <= fc1),
cells AS (SELECT * EXCLUDE (m, px), CAST(unnest(range(CAST(ceil((fc1 - fc0 + 1) / sc) AS BIGINT))) AS INT) AS c FROM (SELECT *, CAST(unnest(range(CAST(ceil((fr1 - fr0 + 1) / sr) AS BIGINT))) AS INT) AS r FROM level)),
centres AS (SELECT *, bt - (fr0 + r * sr + 0.5::DOUBLE) * bdy AS lat, bl + (fc0 + c * sc + 0.5::DOUBLE) * bdx AS lon FROM cells),
laid AS (SELECT k.track_id, k.lod, k.r, k.c, any_value(k.lat) AS lat, any_value(k.lon) AS lon, arg_min(p.elev, w.priority) FILTER (p.elev IS NOT NULL) AS elev
  FROM centres k LEFT JOIN windows w ON w.track_id = k.track_id AND w.r0 <= w.r1 AND w.c0 <= w.c1
  LEFT JOIN pixels p ON p.tile_id = w.tile_id AND p.r = floor((w.tt - k.lat) / w.dy + 0.000001::DOUBLE) AND p.c = floor((k.lon - w.tl) / w.dx + 0.000001::DOUBLE) GROUP BY ALL),
{sql_smooth('laid', 'track_id, lod', 'levels')}"""
M_SQL = with_(Q_TRACK, Q_TILES, Q_PIXELS, Q_BOX, Q_CLIP, Q_MOSAIC)


@query("mosaic_lods", M_SQL + "SELECT track_id, lod, r AS row_no, c AS col_no, round(lat, 8) AS lat, round(lon, 8) AS lon, round(levels.elev, 6) AS elev FROM levels JOIN laid USING (track_id, lod, r, c)")
def mosaic_lods(spark, sf):
    """Levels of the fine and the coarse tile under each track: fine where it reaches, coarse beyond and in its gaps."""
    df = terrain.level_pixels(_lods(spark, sf, False))
    return df.select("track_id", "lod", F.col("row").alias("row_no"), F.col("col").alias("col_no"), *[F.round(c, 8).alias(c) for c in ("lat", "lon")], F.round("elev", 6).alias("elev"))


@query("largest_tile", with_(Q_TRACK, Q_TILES, Q_PIXELS, Q_BOX, Q_CLIP, Q_LODS) + "SELECT track_id, lod, tile_id FROM lod_best WHERE lod = 0")
def largest_tile(spark, sf):
    sized = _windows(spark, sf).select("track_id", "tile_id", "priority", (F.col("n_rows") * F.col("n_cols")).alias("n_pixels"))
    return terrain.largest_tile(sized.withColumn("lod", F.lit(0))).select("track_id", "lod", "tile_id")


_BUDGET = 0.19085
_MB = "(3 * (floor({r}) * floor({c})) + 200000) / 1048576::DOUBLE"


@query(
    "reduce_to_budget",
    G_SQL + f"""SELECT tile_id, CAST(floor(r / step) AS INT) AS row_no, CAST(floor(c / step) AS INT) AS col_no, elev
FROM (SELECT *, CASE WHEN {_MB.format(r='n_rows', c='n_cols')} <= {_BUDGET}::DOUBLE THEN 1
  ELSE coalesce(list_filter(range(2, 11), lambda z: {_MB.format(r='n_rows / z', c='n_cols / z')} <= {_BUDGET}::DOUBLE)[1], 1) END AS step FROM tiles) JOIN pixels USING (tile_id) WHERE r % step = 0 AND c % step = 0""",
)
def reduce_to_budget(spark, sf):
    sized = pixels(spark, sf).join(tiles(spark, sf).select("tile_id", "n_rows", "n_cols"), "tile_id")
    df = terrain.reduce_to_budget(sized, _BUDGET)
    return df.select("tile_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"), "elev")


@query(
    "write_dem_level",
    M_SQL + """SELECT track_id, lod, 0 AS part, CAST(max(r) OVER g + 1 AS BIGINT) AS n_rows, CAST(max(c) OVER g + 1 AS BIGINT) AS n_cols,
  CAST(max(r) OVER g - r AS BIGINT) AS row_from_south, CAST(c AS BIGINT) AS col_no, round(elev, 1) AS elev FROM levels WINDOW g AS (PARTITION BY track_id, lod)""",
)
def write_dem_level(spark, sf):
    """The documents, read back as JSON, value by value."""
    bounds = summary.track_bounds(track(spark, sf))
    docs = dem_documents(_lods(spark, sf, False), bounds)
    kind = "struct<grid:struct<n_rows:bigint,n_cols:bigint,first_row:bigint,elevations:array<double>>>"
    df = docs.withColumn("d", F.from_json("document", kind)).select("track_id", "lod", "part", "d.grid.*")
    cells = df.select("track_id", "lod", "part", "n_rows", "n_cols", "first_row", F.posexplode("elevations").alias("i", "elev"))
    return cells.select(
        "track_id", "lod", "part", "n_rows", "n_cols",
        (F.col("first_row") + F.floor(F.col("i") / F.col("n_cols"))).alias("row_from_south"), (F.col("i") % F.col("n_cols")).alias("col_no"), "elev",
    )
