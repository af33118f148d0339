"""All queries of this package."""

from dyadic.llm import (  # noqa: F401  (register their queries)
    archive_queries,
    duplicate_queries,
    model_queries,
    native_queries,
    scan_queries,
    term_queries,
    token_queries,
)
from dyadic.llm.registry import ORACLES, QUERIES  # noqa: F401
