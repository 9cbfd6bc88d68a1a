"""All queries of this subpackage."""

from tickloom.llm import doc_queries, mining_queries, more_queries  # noqa: F401
from tickloom.llm.registry import ORACLE, QUERIES  # noqa: F401
