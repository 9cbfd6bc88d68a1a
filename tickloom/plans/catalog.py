"""All registered queries."""

from tickloom.plans import (  # noqa: F401
    cluster_queries, cross_queries, forecast_queries, function_queries, quality_queries, scenario_queries, series_queries, source_queries,
    stream_queries,
)
from tickloom.plans.registry import ORACLE, QUERIES  # noqa: F401
