"""Schemas of the tables."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
#: Multipolygon: polygons of rings (the first is the outer one) of points.
GEOMETRY = f"array<array<{RING}>>"
BOX = "struct<minx:double,miny:double,maxx:double,maxy:double>"

ZONES = f"src_ordinal bigint, tatort string, kommunnamn string, tatortskod string, bef bigint, geometry {GEOMETRY}"
COLLECTIONS = "collections array<struct<id:string,extent:struct<spatial:struct<bbox:array<array<double>>>>>>"
ASSET = "struct<data:struct<href:string,`file:size`:bigint,`proj:bbox`:array<double>>>"
ITEMS = f"features array<struct<id:string,assets:{ASSET},properties:struct<`proj:bbox`:array<double>>>>, links array<struct<rel:string,href:string>>"
TILES = f"item_id string, collection_id string, href string, size_bytes bigint, bbox_3006 {BOX}"
PIXELS = "tile string, row int, col int, v double"
RUNS = (
    "tatort string, kommun string, tatortskod string, collections array<string>, planned_batches bigint, planned_tiles bigint, "
    "total_raw_size_bytes bigint, status string, tiles_scanned bigint, tiles_used bigint, min_altitude_m double, max_altitude_m double, "
    "min_coord_x double, min_coord_y double, max_coord_x double, max_coord_y double, altitude_range_m double, relief_q05_m double, "
    "relief_q95_m double, normalized_relief double, rms_slope_deg double, hilliness_score double, error_message string"
)
TILE_STATE = (
    "tatort string, kommun string, item_id string, collection_id string, href string, size_bytes bigint, batch_index int, batch_position int, "
    "download_status string, process_status string, local_min double, local_max double, min_coord_x double, min_coord_y double, "
    "max_coord_x double, max_coord_y double, slope_sum_squares double, slope_count bigint, chunk_path string, error_message string"
)
PROFILES = (
    "rank int, tatort string, kommun string, score double, x array<double>, p10 array<double>, p50 array<double>, p90 array<double>, "
    "y_min double, y_max double, width_km double, outline_segments array<array<array<double>>>, view_axis_segment array<array<double>>"
)
RESULTS = (
    "rank int, tatort string, kommun string, tatortskod string, collections string, batches int, total_raw_size_mb double, tiles_scanned int, "
    "tiles_used int, min_altitude_m double, min_coord_lat_lon string, max_altitude_m double, max_coord_lat_lon string, altitude_range_m double, "
    "relief_q05_m double, relief_q95_m double, normalized_relief double, rms_slope_deg double, hilliness_score double"
)
