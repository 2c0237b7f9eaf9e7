"""All queries of the library over the driver's tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geomill.plans import q_aggregates, q_geo, q_hexes, q_joins, q_more, q_records, q_rows, q_vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (q_rows, q_joins, q_aggregates, q_geo, q_hexes, q_vectors, q_more, q_records):
    for _name, (_query, _sql) in _module.QUERIES.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLES[_name] = _sql
