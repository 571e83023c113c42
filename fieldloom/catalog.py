"""Named queries of the geostatistics library and their SQL."""

from __future__ import annotations

from fieldloom.plans import named


def queries() -> dict:
    return dict(named.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(named.SQL)
