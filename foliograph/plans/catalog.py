"""Every query of the library over the driver's tables, with its SQL twin."""

from foliograph.plans import document_queries, graph_queries, scan_queries, search_queries, table_queries, text_queries  # noqa: F401
from foliograph.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
