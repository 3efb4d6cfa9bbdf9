"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import oracles_more, queries_hough, queries_hypotheses, queries_images, queries_more, queries_polygons, queries_scans, queries_shapes, queries_sources, queries_streams, queries_tiles

flagship = queries_shapes.flagship  # importing the modules registers their queries too
assert all(m.add is queries_images.add for m in (queries_hough, queries_hypotheses, queries_more, queries_polygons, queries_scans, queries_sources, queries_streams, queries_tiles))
QUERIES = queries_images.QUERIES
ORACLES = queries_images.ORACLES | oracles_more.MORE
