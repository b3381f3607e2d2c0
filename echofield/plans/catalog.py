"""The registered queries of the raster engine and their SQL."""

from __future__ import annotations

from . import collects, files, formed, frames, inverted, measuring, pixels, products, viewing

QUERIES: dict = pixels.QUERIES | collects.QUERIES | measuring.QUERIES | formed.QUERIES | frames.QUERIES | files.QUERIES | viewing.QUERIES | products.QUERIES | inverted.QUERIES
ORACLE_SQL: dict[str, str] = pixels.ORACLE_SQL | collects.ORACLE_SQL | measuring.ORACLE_SQL | formed.ORACLE_SQL | frames.ORACLE_SQL | files.ORACLE_SQL | viewing.ORACLE_SQL | products.ORACLE_SQL | inverted.ORACLE_SQL
