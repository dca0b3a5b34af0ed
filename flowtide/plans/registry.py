"""Registered queries over the given tables and the same results in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inventory_queries, network_queries, packet_queries, span_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = packet_queries.QUERIES | inventory_queries.QUERIES | span_queries.QUERIES | network_queries.QUERIES
ORACLE_SQL: dict[str, str] = packet_queries.SQL | inventory_queries.SQL | span_queries.SQL | network_queries.SQL
FLAGSHIP = "enriched_flows"
