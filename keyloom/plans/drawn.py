"""What is drawn by hand on a pipeline's graph, kept in a store: nodes, edges, values to run yet, nodes hidden.

Everything is a row of one append-only log; the newest of a thing counts, and taking it away
is a row too. Every change takes a table, so that many things change in one append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest
from ..sources.store import LOGS, Store, checkpointed, now

_NODE, _EDGE = "type string, label string, config string", "source string, target string, source_handle string, target_handle string"
_VALUE = "constant string, value string"


class DrawnGraph:
    def __init__(self, store: Store):
        self.store = store

    def _write(self, kind: str, rows: DataFrame, name: Column, content: Column | None, present: bool = True) -> None:
        told = F.lit(None).cast("string") if content is None else content
        self.store._append("drawn", rows.select(F.lit(kind).alias("kind"), name.alias("id"), told.alias("content"), F.lit(present).alias("present"), F.lit(now()).alias("timestamp")))

    def _now(self, kind: str) -> DataFrame:
        log = self.store._read("drawn", LOGS["drawn"]).where(F.col("kind") == kind)
        return latest(log, ["id"], "timestamp", F.struct("present", "content")).where("present")

    def _table(self, kind: str, schema: str) -> DataFrame:
        return self._now(kind).select("id", F.from_json("content", schema).alias("c")).select("id", "c.*")

    def add_nodes(self, nodes: DataFrame) -> None:
        """nodes: (id, type, label) and, if known, config as JSON; a node that is there is replaced."""
        config = F.col("config") if "config" in nodes.columns else F.lit(None).cast("string")
        self._write("node", nodes, F.col("id"), F.to_json(F.struct("type", "label", config.alias("config"))))

    def configure(self, configs: DataFrame) -> None:
        """configs: (id, config); ids without a node are left out."""
        known = checkpointed(self.nodes().drop("config").join(configs.select("id", "config"), "id"))
        self.add_nodes(known)

    def delete_nodes(self, ids: DataFrame) -> None:
        self._write("node", ids.select("id").distinct(), F.col("id"), None, present=False)

    def graduate(self, pairs: DataFrame) -> None:
        """pairs: (old, new): a drawn node that the runs show by now goes, and edges that name it name the new one.

        An old name has one new one; edges between two such nodes change both ends.
        """
        edges = self.edges()
        for end in ("source", "target"):
            named = pairs.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"))
            edges = edges.join(named, end, "left")
        changed = checkpointed(edges.where("new_source IS NOT NULL OR new_target IS NOT NULL"))
        self.add_edges(changed.withColumns({e: F.coalesce(f"new_{e}", e) for e in ("source", "target")}))
        self.delete_nodes(pairs.select(F.col("old").alias("id")))

    def add_edges(self, edges: DataFrame) -> None:
        """edges: (id, source, target) and, if known, source_handle and target_handle."""
        handles = [F.col(h) if h in edges.columns else F.lit(None).cast("string").alias(h) for h in ("source_handle", "target_handle")]
        self._write("edge", edges, F.col("id"), F.to_json(F.struct("source", "target", *handles)))

    def delete_edges(self, ids: DataFrame) -> None:
        self._write("edge", ids.select("id").distinct(), F.col("id"), None, present=False)

    def add_pending(self, values: DataFrame, present: bool = True) -> None:
        """values: (constant, value) that are to be run yet; present=False takes them away."""
        content = F.to_json(F.struct("constant", "value"))
        self._write("pending", values.select("constant", "value").distinct(), content, content, present)

    def hide(self, ids: DataFrame, hidden: bool = True) -> None:
        """Hide nodes that the runs show, or show them again."""
        self._write("hidden", ids.select("id").distinct(), F.col("id"), None, present=hidden)

    def nodes(self) -> DataFrame:
        """(id, type, label, config)"""
        return self._table("node", _NODE)

    def edges(self) -> DataFrame:
        """(id, source, target, source_handle, target_handle)"""
        return self._table("edge", _EDGE)

    def pending(self) -> DataFrame:
        """(constant, value)"""
        return self._table("pending", _VALUE).drop("id")

    def hidden(self) -> DataFrame:
        """(id)"""
        return self._now("hidden").select("id")
