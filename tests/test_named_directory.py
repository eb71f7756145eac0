"""Directories of files that hold many logs: the same tracks as in a file for each, and files that do not grow with the tracks."""

import json

import pytest
from test_directory import nmea_log
from test_together import n_files

from trackloom.plans import pipelines
from trackloom.plans.skew import CHUNK
from trackloom.registry import files

LOGS = {"a": nmea_log("470"), "b": nmea_log("480", 12), "c": nmea_log("460", 1)}
CUT = {"source": "b", "cut_ranges": [{"start": 0, "end": 4, "mode": "trim"}]}
SHOWN = ["source_type", "idx", "ts", "lat", "lon", "alt", "speed_kmh", "distance_m", "suggested_z_offset_m"]


@pytest.fixture
def folders(tmp_path):
    """The same logs and cuts, in a file each and in two files."""
    single, few = tmp_path / "single", tmp_path / "few"
    (few / "sub").mkdir(parents=True)
    single.mkdir()
    for name, text in LOGS.items():
        (single / f"{name}.txt").write_text(text)
    named = {n: "".join(f"{n}\t{line}\n" for line in t.splitlines()) for n, t in LOGS.items()}
    (few / "one.txt").write_text(named["a"] + named["b"] + "lost\n")
    (few / "sub" / "two.txt").write_text(named["c"])
    (few / "chart.txt").write_text("8 48\n9 48\n8 47\n9 47\n")
    (few / "chart.png").write_bytes(b"\x89PNG")
    (single / "b.txt.cuts.json").write_text(json.dumps(CUT))
    (few / "b.cuts.json").write_text(json.dumps(CUT))
    return single, few


def rows(points):
    return sorted(tuple(str(v) for v in r) for r in points.select(*SHOWN).collect())


def test_named_files_give_the_tracks_of_single_ones(spark, folders):
    single, few = folders
    points, done, sentences = pipelines.process_directory(spark, str(few), named=True)
    wanted, was_done, was_sentences = pipelines.process_directory(spark, str(single))
    assert rows(points) == rows(wanted) and sentences.count() == was_sentences.count()
    told = {(r["track_id"], r["source_file"], r["count"]) for r in points.groupBy("track_id", "source_file").count().collect()}
    assert told == {("a", "one.txt", 20), ("b", "one.txt", 7), ("c", "two.txt", 1)}
    assert [(r["track_id"], r["n_points_removed"]) for r in done.collect()] == [("b", 5)] and was_done.count() == 1


def test_a_long_log_keeps_its_pieces(spark, folders, monkeypatch):
    """Logs are taken whole only where none is long."""
    seen = []
    real = pipelines.process_nmea
    monkeypatch.setattr(pipelines, "process_nmea", lambda t: seen.append(CHUNK in t.columns) or real(t))
    found = []
    for rows_of_a_task in ("500000", "30"):
        spark.conf.set("trackloom.targetRows", rows_of_a_task)
        try:
            found.append(rows(pipelines.process_directory(spark, str(folders[1]), named=True)[0]))
        finally:
            spark.conf.unset("trackloom.targetRows")
    assert seen == [False, True] and found[0] == found[1]


def test_files_of_the_query_do_not_grow_with_the_tracks(spark, tmp_path, monkeypatch):
    from trackloom.registry import QUERIES, load_all

    load_all()
    kind = "CASE id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END"
    spark.sql(
        f"SELECT id AS event_id, id % 40 AS user_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, {kind} AS event_type, 1.0D AS value FROM range(800)"
    ).write.parquet(f"{tmp_path}/in/events.parquet")
    made = []
    real = files.scratch_path
    monkeypatch.setattr(files, "scratch_path", lambda s, label: made.append(real(s, label)) or made[-1])
    assert QUERIES["process_directory"](spark, f"{tmp_path}/in").count() > 0
    assert 0 < n_files(made[0]) <= 8
