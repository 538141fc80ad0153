"""Readers and writers of the tables that the engine works on."""

from .files import (
    extract,
    gpkg_safe,
    inside_box,
    read_building_links,
    read_buildings,
    read_connectors,
    read_id_list,
    read_roads,
    read_sniffed_csv,
    road_segments,
    stringify_complex,
    write_csv,
    write_parquet,
)
from .geopackage import GeoPackageSource, read_geopackage, register, write_geopackage
from .geoparquet import geo_srid, read_geoparquet, write_geoparquet

__all__ = [
    "GeoPackageSource", "extract", "geo_srid", "gpkg_safe", "inside_box", "read_building_links", "read_buildings", "read_connectors", "read_geopackage", "read_geoparquet",
    "read_id_list", "read_roads", "read_sniffed_csv", "register", "road_segments", "stringify_complex", "write_csv", "write_geopackage", "write_geoparquet", "write_parquet",
]
