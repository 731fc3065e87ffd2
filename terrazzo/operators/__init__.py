"""Table-level operators.  Points are ``(rid, x, y, ...)``, lines and rings ``(rid, geom)``."""
