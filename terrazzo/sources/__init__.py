"""Vector sources and sinks: GeoJSON, WKT tables, rasters in long form, and fixtures derived from plain tables."""
