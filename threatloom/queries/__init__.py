"""Registered queries: each operator run over the test tables, with a DuckDB query for the same rows."""

from threatloom.queries import alerts, attention, graphs, labels, links, reports, snapshots, storage, windows  # noqa: F401
from threatloom.queries.base import ORACLES, QUERIES  # noqa: F401
