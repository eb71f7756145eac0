"""Whole directories: tracks are files, sidecars belong to their folder, columns do not depend on what is there."""

import json

import pytest

from trackloom.plans.pipelines import export_directory, process_directory


def sentence(body):
    total = 0
    for c in body:
        total ^= ord(c)
    return f"${body}*{total:02X}"


def nmea_log(lat, n=20):
    lines = []
    for i in range(n):
        t = f"1200{i:02d}.00"
        lines.append(sentence(f"GNRMC,{t},A,{lat}{i % 10}.0000,N,00830.0000,E,10.0,90.0,010124,,,A"))
        lines.append(sentence(f"GNGGA,{t},{lat}{i % 10}.0000,N,00830.0000,E,1,10,1.2,400.0,M,46.9,M,,"))
    return "\n".join(lines) + "\n"


def gpx(lat):
    points = "".join(
        f'<trkpt lat="{lat}" lon="8.{i}"><ele>400</ele><time>2024-01-01T12:00:{i:02d}Z</time></trkpt>\n' for i in range(5)
    )
    return f'<?xml version="1.0"?>\n<gpx><trk><trkseg>\n{points}</trkseg></trk></gpx>\n'


@pytest.fixture
def folder(tmp_path):
    for name, text in {
        "a/log.txt": nmea_log("470"), "b/log.txt": nmea_log("480"), "a/tour.gpx": gpx(47), "b/tour.gpx": gpx(48), "b/my walk.gpx": gpx(46),
    }.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "in"


def by_track(points):
    rows = points.groupBy("track_id", "source_file").agg({"lat": "min", "*": "count"}).collect()
    return sorted((r["source_file"], int(r["min(lat)"]), r["count(1)"]) for r in rows)


def test_tracks_and_cuts_of_a_directory(spark, folder):
    """Files of the same name are tracks of their own; cuts of the own folder edit points and sentences."""
    plain, before, all_sentences = process_directory(spark, str(folder))
    assert by_track(plain) == [("log.txt", 47, 20), ("log.txt", 48, 20), ("my walk.gpx", 46, 5), ("tour.gpx", 47, 5), ("tour.gpx", 48, 5)]
    assert before.count() == 0 and all_sentences.select("track_id").distinct().count() == 2
    cut = {"source": "log.txt", "cut_ranges": [{"start": 0, "end": 4, "mode": "trim"}]}
    (folder / "b" / "log.txt.cuts.json").write_text(json.dumps(cut, indent=2))
    # a sidecar without its log in the same folder edits nothing
    (folder / "a" / "my walk.gpx.cuts.json").write_text(json.dumps(cut))
    points, done, sentences = process_directory(spark, str(folder))
    assert points.columns == plain.columns and done.columns == before.columns and sentences.columns == all_sentences.columns
    assert by_track(points) == [("log.txt", 47, 20), ("log.txt", 48, 15), ("my walk.gpx", 46, 5), ("tour.gpx", 47, 5), ("tour.gpx", 48, 5)]
    assert [(r["n_trim_cuts"], r["n_points_removed"]) for r in done.collect()] == [(1, 5)]
    assert sentences.count() < all_sentences.count()
    assert [(r["source_name"], r["count_differs"]) for r in done.collect()] == [("log.txt", False)]


def test_export_of_a_directory(spark, folder, tmp_path):
    """Documents tell file, format, offset and satellites; grids and overlays of the folder are exported with them."""
    cells = "\n".join(" ".join(str(100 * r + c) for c in range(4)) for r in range(4))
    (folder / "a" / "hill.asc").write_text(f"ncols 4\nnrows 4\nxllcorner 8.0\nyllcorner 46.5\ncellsize 0.5\nNODATA_value -9999\n{cells}\n")
    (folder / "a" / "chart.txt").write_text("8 48\n9 48\n8 47\n9 47\n")
    (folder / "a" / "chart.png").write_bytes(b"\x89PNG")
    cut = {"source": "tour.gpx", "n_points_reference": 7, "cut_ranges": [], "z_offset_m": 12.5}
    (folder / "b" / "tour.gpx.cuts.json").write_text(json.dumps(cut))
    export_directory(spark, str(folder), str(tmp_path / "out"))
    kind = "struct<meta:struct<source_file:string,source_type:string,n_points:int,suggested_z_offset_m:double,has_satellites:boolean,has_terrain:boolean,derivation:struct<count_differs:boolean>>>"
    docs = spark.read.text(str(tmp_path / "out" / "track")).selectExpr(f"from_json(value, '{kind}').meta AS m").select("m.*").collect()
    told = sorted((d["source_file"], d["source_type"], d["n_points"], d["suggested_z_offset_m"], d["has_satellites"]) for d in docs)
    assert told == [
        ("log.txt", "nmea", 20, 0.0, False), ("log.txt", "nmea", 20, 0.0, False), ("my walk.gpx", "gpx", 5, 0.0, False),
        ("tour.gpx", "gpx", 5, 0.0, False), ("tour.gpx", "gpx", 5, 12.5, False),
    ]
    assert [d["derivation"]["count_differs"] for d in docs if d["derivation"]] == [True]
    assert any(d["has_terrain"] for d in docs) and not all(d["has_terrain"] for d in docs)
    assert spark.read.text(str(tmp_path / "out" / "overlays")).count() == 1
    found = spark.read.parquet(str(tmp_path / "out" / "catalogue"))
    assert found.count() == 5 and {r["charts"] for r in found.collect()} == {"charts.json"}


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "notes.doc").write_text("x")
    with pytest.raises(ValueError):
        process_directory(spark, str(tmp_path))
