"""Import every query module so that all queries are registered."""

from . import q_catalog, q_conflicts, q_extract, q_history, q_keys, q_lineage, q_reports, q_streams  # noqa: F401
