"""Files that hold many tracks: every reader finds each track, whole and in order, however the files are cut."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackloom.plans.pipelines import merge_and_write
from trackloom.registry import files
from trackloom.sinks.gpx import write_gpx
from trackloom.sources.dem import read_ascii_grid
from trackloom.sources.files import read_lines
from trackloom.sources.gpx import read_gpx
from trackloom.sources.igc import read_igc
from trackloom.sources.kml import read_kml
from trackloom.sources.nmea import read_nmea

LINES = [("7", 0, "$GPGSV,1,1,00*79"), ("8", 0, "a\tb"), ("7", 1, "no sentence"), (None, 0, "x"), ("7", 3, ""), ("7", 2, "c"), ("8", 1, "*")]


def n_files(path) -> int:
    return len([p for p in Path(path.removeprefix("file:")).rglob("part-*") if p.stat().st_size])


@pytest.fixture
def lines(spark):
    return spark.createDataFrame(LINES, "track_id string, line_no int, value string")


def test_lines_of_many_logs_in_a_file(spark, lines):
    path = files._write_named_logs(lines.coalesce(1), spark, "few")
    rows = read_lines(spark, path, named=True).orderBy("track_id", "chunk", "line_no").collect()
    wanted = sorted(LINES, key=lambda r: (r[0] or "", r[1]))
    assert [(r["track_id"], r["value"]) for r in rows] == [(t, v) for t, _, v in wanted]
    tokens = read_nmea(spark, path, None, named=True)
    assert sorted(r["status"] for r in tokens.where("track_id = 7").collect()) == ["malformed", "malformed", "parsed"]


def test_a_log_in_several_splits_keeps_its_order(spark):
    made = spark.range(400).select((F.col("id") % 3).alias("track_id"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("value"))
    path = files._write_named_logs(made, spark, "split")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = read_lines(spark, path, named=True).orderBy("track_id", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["chunk"] for r in rows}) > 1
    assert [(r["track_id"], int(r["value"])) for r in rows] == [(str(t), i) for t in range(3) for i in range(t, 400, 3)]


def test_a_line_without_a_name_is_of_no_log(spark, tmp_path):
    (tmp_path / "x.txt").write_text("lost\n1\tHFDTE010124\n1\tB1200004730123N00812345EA0010000200\n")
    assert [r["value"] for r in read_lines(spark, str(tmp_path), named=True).orderBy("line_no").collect()][0] == "HFDTE010124"
    assert [(r["track_id"], r["alt"]) for r in read_igc(spark, str(tmp_path), None, named=True).collect()] == [("1", 200.0)]


def test_grids_of_one_file(spark, tmp_path):
    head = ["ncols 2", "nrows 2", "xllcorner 8", "yllcorner 47", "cellsize 0.5", "nodata_value -9"]
    (tmp_path / "grids").write_text("".join(f"{t}\t{v}\n" for t in ("a", "b") for v in [*head, "1 2" if t == "a" else "5 6", "3 -9"]))
    tiles, px = read_ascii_grid(spark, str(tmp_path), None, named=True)
    assert sorted(r["tile_id"] for r in tiles.collect()) == ["a", "b"]
    rows = px.orderBy("tile_id", "row", "col").collect()
    assert [(r["tile_id"], r["elev"]) for r in rows] == [("a", 1), ("a", 2), ("a", 3), ("a", None), ("b", 5), ("b", 6), ("b", 3), ("b", None)]


def points(spark):
    return spark.sql(
        "SELECT id % 9 AS track_id, id AS idx, timestamp_micros(id * 1000000) AS ts, 1.0D * (id % 80) AS lat, 2.0D AS lon, 5.0D AS alt, 3.6D AS speed_kmh, id % 2 AS seg FROM range(180)"
    )


def test_gpx_of_many_tracks(spark, tmp_path, monkeypatch):
    """Parts and segments of a track are joined in order, as where each track has its folder."""
    monkeypatch.setattr("trackloom.sinks.gpx.PART_POINTS", 50)
    found = []
    for files_ in (None, 2):
        path = str(tmp_path / f"gpx{files_}")
        write_gpx(points(spark), path, segment="seg", files=files_)
        rows = read_gpx(spark, path, glob=None, named=bool(files_)).orderBy("track_id", "seq").collect()
        found.append([(r["track_id"], r["ts"], r["lat"], r["lon"], r["alt"], r["speed_kmh"], r["hdop"]) for r in rows])
    assert found[0] == found[1] and len(found[0]) == 180
    assert n_files(str(tmp_path / "gpx2")) == 2


def test_gpx_of_a_track_without_a_name_and_of_a_point_without_a_place(spark, tmp_path):
    rows = points(spark).withColumn("track_id", F.when(F.col("track_id") != 3, F.concat(F.lit("<&"), "track_id")))
    write_gpx(rows.withColumn("lat", F.when(F.col("idx") != 3, F.col("lat"))), str(tmp_path / "g"), files=1)
    counts = {r["track_id"]: r["count"] for r in read_gpx(spark, str(tmp_path / "g"), glob=None, named=True).groupBy("track_id").count().collect()}
    assert counts == {None: 19} | {f"<&{i}": 20 for i in range(9) if i != 3}


def test_kml_of_many_tracks(spark, tmp_path):
    track = '<Placemark><gx:Track id="{0}"><when>2024-01-01T00:00:0{1}Z</when><gx:coord>{1} 47</gx:coord></gx:Track></Placemark>'
    text = '<kml xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>' + "".join(track.format(t, i) for t, i in [("a", 1), ("b", 2), ("a", 3)]) + "</Document></kml>"
    (tmp_path / "x.kml").write_text(text)
    rows = read_kml(spark, str(tmp_path), named=True).orderBy("track_id", "seq").collect()
    assert [(r["track_id"], r["lon"]) for r in rows] == [("a", 1), ("a", 3), ("b", 2)]
    assert {r["track_id"].startswith("kml_x_") for r in read_kml(spark, str(tmp_path)).collect()} == {True}


@pytest.mark.parametrize("name", ["read_nmea", "read_igc", "read_kml", "process_kml", "read_gpx", "process_gpx", "read_ascii_grid", "merge_and_write"])
def test_files_do_not_grow_with_the_tracks(spark, tmp_path, monkeypatch, name):
    from trackloom.registry import QUERIES, load_all

    load_all()
    kind = "CASE id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END"
    spark.sql(
        f"SELECT id AS event_id, id % 40 AS user_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, {kind} AS event_type, 1.0D AS value FROM range(800)"
    ).write.parquet(f"{tmp_path}/in/events.parquet")
    made = []
    real = files.scratch_path
    monkeypatch.setattr(files, "scratch_path", lambda s, label: made.append(real(s, label)) or made[-1])
    found = QUERIES[name](spark, f"{tmp_path}/in")
    assert found.count() > 0 and 0 < n_files(made[0]) <= 8


def test_merged_tracks_in_few_files(spark, tmp_path):
    rows = points(spark).select(F.col("track_id").alias("merge_id"), F.col("seg").cast("int").alias("part_no"), "idx", "ts", "lat", "lon", "alt", "speed_kmh")
    columns = {c.name for c in rows.schema}
    assert {"merge_id", "part_no"} <= columns
    merged = merge_and_write(rows, str(tmp_path / "m"), files=2)
    back = read_gpx(spark, str(tmp_path / "m"), glob=None, named=True)
    assert back.count() == merged.count() and back.select("track_id").distinct().count() == 9
