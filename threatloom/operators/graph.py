"""A graph as two DataFrames."""

from pyspark.sql import DataFrame


class Graph:
    """``nodes(key, ntype, ord, pos)`` and ``edges(src, dst, etype, ord)``, both free of duplicates.

    ``report_edges`` are the edges that leave a report, where a graph has them as a table of its own, and else all edges.
    A table may be handed in as a function that makes it. It is called once, when the table is first read, so the
    steps of a table that nobody reads are not taken.
    """

    def __init__(self, nodes, edges, report_edges=None):
        self._tables = {"nodes": nodes, "edges": edges, "report_edges": report_edges}

    def _table(self, name) -> DataFrame:
        if callable(self._tables[name]):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def report_edges(self) -> DataFrame:
        return self.edges if self._tables["report_edges"] is None else self._table("report_edges")

    def __iter__(self):
        return iter((self.nodes, self.edges))
