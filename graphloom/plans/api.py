"""The three query operators over a loaded index, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, lookup, search
from graphloom.plans.session import cut


class Index:
    """Tables of an index: symbols, edges, imports, files and, where present, skeletons and vectors (name, file, vec)."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, tables

    def search(self, query: str, layer: str | None = None, query_vector: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
        return search.search(self.spark, self.tables["symbols"], self.tables["files"], query, layer, self.tables.get("vectors"), query_vector, rules)

    def _homes(self, symbol: str) -> DataFrame:
        homes = self.tables["symbols"].where(F.col("name") == symbol).select(F.col("name").alias("symbol"), "file").distinct()
        event = self.tables["edges"].where(F.col("dst") == symbol).select(F.col("dst").alias("symbol"), F.lit(None).cast("string").alias("file")).limit(1)
        return homes.unionByName(event) if homes.isEmpty() else homes

    def graph(
        self, query: str, direction: str = "up", depth: int | None = None, layer: str | None = None, mode: str = "tree", edge_types: list[str] | None = None, query_vector: DataFrame | None = None
    ) -> DataFrame:
        """down: the capped tree's edges; up with mode impact: caller states by hop; up with mode tree: shown callers by level.

        Raises LookupError if nothing is called by that name.
        """
        if direction not in ("up", "down") or mode not in ("tree", "impact"):
            raise ValueError("direction is up or down, mode is tree or impact")
        edges, imports = self.tables["edges"], self.tables["imports"]
        depth = graph.clamp_depth(depth)
        if direction == "down":
            start = self.spark.createDataFrame([(query, query)], "root string, node string")
            if self._homes(query).isEmpty() and edges.where(F.col("src") == query).isEmpty():
                raise LookupError(query)
            sims = search.best_similarity(self.tables["vectors"], query_vector) if query_vector is not None and "vectors" in self.tables else None
            return graph.down_capped(edges, self.tables["symbols"], start, depth, edge_types, layer, sims)
        homes = cut(self._homes(query))
        if homes.isEmpty():
            raise LookupError(query)
        if mode == "impact":
            return graph.impact(edges, imports, homes, depth, edge_types, layer)
        return self._up_tree(homes, edges, imports, depth, edge_types, layer)

    def _up_tree(self, homes: DataFrame, edges: DataFrame, imports: DataFrame, depth: int, edge_types: list[str] | None, layer: str | None) -> DataFrame:
        """(hop, sym, from_file, file, rank, distance, callers, hidden_callers, hidden_files): what each level of the tree shows.

        The cap depends on the symbol and on the file it was reached from, so both are carried along.
        """
        first = homes.agg(F.min("file").alias("node")).withColumn("root", F.col("node"))
        distances = cut(graph.import_distances(imports, first.select("root", "node")).select("file", "distance"))
        turned = edges.select(F.col("dst").alias("sym"), F.col("src").alias("caller"), "file", "edge_type", "ord")
        level = homes.select(F.col("symbol").alias("sym"), F.col("file").alias("from_file"))
        seen, out = level, []
        for hop in range(1, depth + 1):
            refs = graph.of_types(graph.scope_callers(level.join(turned, "sym"), imports), edge_types)
            # a caller is listed once a file, under its first reference
            refs = refs.groupBy("sym", "from_file", "caller", "file").agg(F.min("ord").alias("ord"))
            keyed = refs.withColumn("pair", F.struct("sym", "from_file"))
            shown = graph.callers_by_distance(keyed.select(F.col("pair").alias("sym"), "caller", "file", "ord"), distances, layer)
            shown = cut(shown.select(F.lit(hop).alias("hop"), F.col("sym.sym").alias("sym"), F.col("sym.from_file").alias("from_file"), "file", "rank", "distance", "callers", "hidden_callers", "hidden_files"))
            out.append(shown)
            ahead = shown.select(F.explode("callers").alias("sym"), F.col("file").alias("from_file")).distinct()
            same = (F.col("a.sym") == F.col("b.sym")) & F.col("a.from_file").eqNullSafe(F.col("b.from_file"))
            level = cut(ahead.alias("a").join(seen.alias("b"), same, "left_anti"))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        whole = out[0]
        for part in out[1:]:
            whole = whole.unionByName(part)
        return whole

    def implement(self, symbol: str, filename: str) -> DataFrame:
        return lookup.implement(self.tables["symbols"], self.tables["edges"], self.tables["symbols"], self.tables["skeletons"], symbol, filename)
