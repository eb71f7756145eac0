"""trackloom: Spark-native analytics for fleets of GPS/GNSS tracks."""

from functools import wraps as _wraps

from pyspark.sql import DataFrame as _DataFrame

from trackloom.operators import edit as _edit
from trackloom.operators import enrich as _enrich
from trackloom.operators import merge as _merge
from trackloom.operators import satellites as _satellites
from trackloom.plans import pipelines as _pipelines
from trackloom.plans.pipelines import export_directory, export_tracks, merge_and_write, process_directory, write_export
from trackloom.plans.skew import CHUNK as _CHUNK
from trackloom.plans.skew import split_hot_tracks
from trackloom.sinks.catalogue import load_track, save_track
from trackloom.sinks.gpx import write_gpx
from trackloom.sources.cuts import read_cuts
from trackloom.sources.discover import discover_inputs
from trackloom.sources.gpx import read_gpx
from trackloom.sources.igc import read_igc
from trackloom.sources.kml import read_kml
from trackloom.sources.nmea import read_nmea
from trackloom.sources.overlays import read_overlays



def _public(f):
    """``f`` without the column by which long tracks are split inside, unless the caller's own table has it."""

    @_wraps(f)
    def call(*args, **kwargs):
        own = any(isinstance(x, _DataFrame) and _CHUNK in x.columns for x in [*args, *kwargs.values()])
        found = f(*args, **kwargs)
        if own:
            return found
        if isinstance(found, tuple):
            return tuple(x.drop(_CHUNK) if isinstance(x, _DataFrame) else x for x in found)
        return found.drop(_CHUNK)

    return call


align_satellites = _public(_satellites.align_satellites)
apply_cuts_raw = _public(_edit.apply_cuts_raw)
apply_cuts_track = _public(_edit.apply_cuts_track)
apply_sidecar_cuts = _public(_edit.apply_sidecar_cuts)
compare_tracks = _public(_pipelines.compare_tracks)
enrich_speed = _public(_enrich.enrich_speed)
merge_tracks = _public(_merge.merge_tracks)
process_nmea = _public(_pipelines.process_nmea)
process_points = _public(_pipelines.process_points)

__all__ = [
    "align_satellites",
    "apply_cuts_raw",
    "apply_cuts_track",
    "apply_sidecar_cuts",
    "compare_tracks",
    "discover_inputs",
    "enrich_speed",
    "export_directory",
    "export_tracks",
    "load_track",
    "merge_and_write",
    "merge_tracks",
    "process_directory",
    "process_nmea",
    "process_points",
    "read_cuts",
    "read_gpx",
    "read_igc",
    "read_kml",
    "read_nmea",
    "read_overlays",
    "save_track",
    "split_hot_tracks",
    "write_export",
    "write_gpx",
]
