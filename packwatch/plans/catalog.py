"""All registered queries and their SQL."""

from . import base, detectors, lifecycle, pages, promotion, quality, reading, sources, texts, views  # noqa: F401  each registers its queries

FLAGSHIP = "brand_scorecard"
QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
