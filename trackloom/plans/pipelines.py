"""User-level chains over whole fleets: every function handles all tracks in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.clean import filter_invalid
from trackloom.operators.consolidate import consolidate
from trackloom.operators.edit import (
    add_z_offset,
    apply_cuts_raw,
    apply_sidecar_cuts,
    check_reference_count,
    derivation,
    effective_cuts,
    point_counts,
)
from trackloom.operators.enrich import enrich_speed
from trackloom.operators.merge import merge_tracks
from trackloom.operators.nmea import (
    apply_types,
    build_schema_a,
    carry_clock,
    check_gga_against_rmc,
    extract_fields,
)
from trackloom.operators.quantiles import class_by_boundaries, global_boundaries
from trackloom.operators.satellites import align_satellites
from trackloom.operators.summary import comparison_bounds, reference_point, track_bounds
from trackloom.operators.raster import as_blocks
from trackloom.operators.terrain import above_neutral, dem_lods, enrich_terrain
from trackloom.plans.session import settle
from trackloom.plans.skew import CHUNK, attach_track, split_hot_tracks, target_rows_of
from trackloom.sinks.catalogue import catalogue, save_track
from trackloom.sinks.document import (
    dem_documents,
    overlay_documents,
    satellite_documents,
    track_documents,
    write_documents,
)
from trackloom.sinks.gpx import write_gpx
from trackloom.sources.cuts import cut_rows, read_cuts
from trackloom.sources.dem import read_ascii_blocks
from trackloom.sources.discover import discover_inputs
from trackloom.sources.files import named_logs, track_id
from trackloom.sources.gpx import read_gpx
from trackloom.sources.igc import read_igc
from trackloom.sources.kml import read_kml
from trackloom.sources.nmea import read_nmea
from trackloom.sources.overlays import read_overlays


def _sentences(tokens: DataFrame) -> DataFrame:
    """Tokenized lines to sentences, written once: filters and satellites both read them."""
    return settle(build_schema_a(carry_clock(extract_fields(tokens))), "schema-a")


def sentence_table(tokens: DataFrame) -> DataFrame:
    """Tokenized lines to the typed sentence table."""
    return apply_types(check_gga_against_rmc(_sentences(tokens)))


def process_nmea(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentence table, track table). The sentence table is unfiltered: satellites are aligned against it."""
    rows = _sentences(tokens)
    schema_a = apply_types(check_gga_against_rmc(rows))
    return schema_a, enrich_speed(consolidate(filter_invalid(schema_a), rows), bound=rows)


def process_points(points: DataFrame) -> DataFrame:
    """GPX, KML and IGC rows to the track table."""
    return enrich_speed(points)


@dataclass
class Export:
    """The outputs of one export, each a lazy DataFrame over intermediate tables that are written once."""

    points: DataFrame
    documents: DataFrame
    catalogue: DataFrame
    satellites: DataFrame | None = None
    terrain_levels: DataFrame | None = None
    overlays: DataFrame | None = None


def export_tracks(
    points: DataFrame,
    schema_a: DataFrame | None = None,
    tiles: DataFrame | None = None,
    pixels: DataFrame | None = None,
    overlays: DataFrame | None = None,
    derivations: DataFrame | None = None,
    source_type: str = "nmea",
    cell_deg: float = 1.0,
    largest_tile: bool = False,
) -> Export:
    """Documents for every track: points, satellites, terrain levels, overlays and the catalogue.

    Terrain levels show the mosaic of all tiles under a track, or with ``largest_tile`` only the one with the most pixels.

    ``source_type`` is that of tracks without a column of this name; columns ``source_file`` and
    ``suggested_z_offset_m`` of the points are told in the documents.
    """
    points = split_hot_tracks(points, order="idx")
    lods = None
    if tiles is not None and pixels is not None:
        bounds = track_bounds(points)
        pixels = settle(as_blocks(pixels, tiles), "blocks")
        points = settle(above_neutral(enrich_terrain(points, tiles, pixels, 0.0, cell_deg)), "points")
        lods = settle(dem_lods(bounds, tiles, pixels, cell_deg=cell_deg, largest=largest_tile), "lods")
    aligned = None
    if schema_a is not None:
        aligned = settle(align_satellites(points, schema_a.where(F.col("sentence_type") == "GSV")), "aligned")
    return Export(
        points=points,
        documents=track_documents(points, derivations, source_type, aligned),
        catalogue=catalogue(points, aligned, lods, 0 if overlays is None else 1),
        satellites=None if aligned is None else satellite_documents(points, aligned),
        terrain_levels=None if lods is None else dem_documents(lods, bounds),
        overlays=None if overlays is None else overlay_documents(overlays),
    )


def write_export(export: Export, path: str) -> None:
    """Points as Parquet, documents as text, below ``path``."""
    base = path.rstrip("/")
    save_track(export.points, f"{base}/points")
    write_documents(export.documents, f"{base}/track")
    export.catalogue.write.parquet(f"{base}/catalogue")
    if export.satellites is not None:
        write_documents(export.satellites, f"{base}/satellites")
    if export.terrain_levels is not None:
        write_documents(export.terrain_levels, f"{base}/terrain")
    if export.overlays is not None:
        export.overlays.select("document").write.text(f"{base}/overlays")


def compare_tracks(points: DataFrame, value: str = "speed_kmh", n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(classed rows, one row per comparison) for rows that carry ``comparison_id``.

    Class limits are those of all tracks of a comparison together.
    """
    group = ("comparison_id",)
    limits = global_boundaries(points, value, n, group)
    summary = limits.join(comparison_bounds(points, 0.0, group), list(group)).join(
        reference_point(points, group), list(group)
    )
    return class_by_boundaries(points, value, limits, group), summary


def merge_and_write(rows: DataFrame, path: str, mode: str = "gap", files: int | None = None) -> DataFrame:
    """Merge the parts of each ``merge_id`` and write them as GPX with one segment per part (``files``: as in ``write_gpx``)."""
    merged = merge_tracks(rows, mode)
    write_gpx(merged, path, key="merge_id", order="merged_idx", segment="segment_no", files=files)
    return merged


def process_directory(spark: SparkSession, path: str, named: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(track table, derivations, sentence table) of all logs in a directory, sidecar cuts applied to both tables.

    A track is a file, told by its folder and name; ``source_file`` is its name. One job per format, not per file. Formats
    without files are not scanned. Derivations have the same columns whether or not there are cuts; the sentence table
    is None where there are no NMEA logs. ``named`` files hold many logs, as in ``read_lines``: a track is a name in them, and
    ``<name>.cuts.json`` its sidecar.
    """
    found = settle(discover_inputs(spark, path), "inputs")
    kinds = {r["kind"] for r in found.select("kind").distinct().collect()}
    tables: list[DataFrame] = []
    schema_a = None
    if "nmea" in kinds:
        texts = found.where(F.col("kind") == "nmea")
        if named:
            # what is no log, such as an overlay, has no sound sentence
            logs = settle(named_logs(spark, path, texts, "*.txt"), "logs")
        else:
            # a line takes a byte or more
            logs = texts.select(track_id("nmea", F.col("path")).alias("track_id"), F.col("name").alias("source_file"), F.col("length").alias("n_lines"))
        names = logs.select("track_id", "source_file")
        tokens = read_nmea(spark, path, named=named)
        most = logs.groupBy("track_id").agg(F.sum("n_lines").alias("n")).agg(F.max("n")).first()[0]
        if most is None or most <= target_rows_of(tokens):
            # no log is long: in one piece each is parsed once, in several each step over them would parse it again
            tokens = tokens.drop(CHUNK)
        if not named:
            tokens = attach_track(tokens, names.select("track_id"), how="left_semi")
        schema_a, track = process_nmea(tokens)
        tables.append(attach_track(track, names))
        tables[0] = tables[0].withColumn("source_type", F.lit("nmea"))
    for kind, reader in (("gpx", read_gpx), ("kml", read_kml), ("igc", read_igc)):
        if kind in kinds:
            tables.append(process_points(reader(spark, path, named=named)).withColumn("source_type", F.lit(kind)))
    if not tables:
        raise ValueError(f"no NMEA, GPX, KML or IGC files in {path}")
    points = tables[0].drop("chunk")
    for other in tables[1:]:
        points = points.unionByName(other.drop("chunk"), allowMissingColumns=True)
    # the cuts read the points several times: they are parsed once
    points = split_hot_tracks(settle(points, "directory-points"), order="idx")
    instructions, _ = read_cuts(spark, path)
    if named:
        instructions = instructions.join(points.select("track_id").distinct(), F.col("source_name") == F.col("track_id"))
    else:
        # a sidecar belongs to the log of its own folder
        tracks = [
            found.where((F.col("kind") == kind) & F.col("cuts_path").isNotNull()).select(
                track_id(kind, F.col("path")).alias("track_id"), "cuts_path"
            )
            for kind in ("nmea", "gpx", "kml", "igc")
        ]
        instructions = instructions.join(reduce(DataFrame.unionByName, tracks), F.col("path") == F.col("cuts_path")).drop("cuts_path")
    instructions = settle(instructions, "cuts")
    cuts = cut_rows(instructions)
    effective = settle(effective_cuts(points, cuts), "effective-cuts")
    checked = check_reference_count(instructions, point_counts(points)).drop("n_points")
    done = add_z_offset(derivation(points, cuts, effective=effective), checked)
    if schema_a is not None:
        schema_a = apply_cuts_raw(schema_a, points, cuts, effective=effective).drop("chunk")
    return apply_sidecar_cuts(points, instructions, effective).drop("chunk"), done, schema_a


def export_directory(spark: SparkSession, path: str, out: str, cell_deg: float = 1.0) -> Export:
    """``process_directory``, then documents with satellites, elevation grids and overlays of the folder, below ``out``.

    ``out`` must lie outside ``path``. Elevation grids are ASCII grids; what the folder lacks is not scanned.
    """
    points, derivations, schema_a = process_directory(spark, path)
    points, derivations = settle(points, "edited-points"), settle(derivations, "derivations")
    kinds = {r["kind"] for r in discover_inputs(spark, path).select("kind").distinct().collect()}
    tiles, pixels = (settle(t, "grids") for t in read_ascii_blocks(spark, path)) if "dem" in kinds else (None, None)
    overlays = read_overlays(spark, path) if "overlay" in kinds else None
    export = export_tracks(points, schema_a, tiles, pixels, overlays, derivations, cell_deg=cell_deg)
    write_export(export, out)
    return export
