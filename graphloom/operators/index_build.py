"""Index build: symbol map, edges in both directions, dependents and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Places that the calls of one file take in the order of all calls.
FILE_STEP = 1 << 34


def coerce_calls(raw: DataFrame, column: str = "calls") -> DataFrame:
    """Calls as (name, edge_type, event): an old file's bare string is a plain call, a missing type is call.

    The column is an array of JSON texts or bare names, as the permissive mapping scan gives it.
    """
    schema = "name string, edgeType string, event string"

    def one(text):  # type: ignore[no-untyped-def]
        parsed = F.from_json(text, schema)
        is_object = text.startswith("{")
        return F.struct(
            F.when(is_object, parsed["name"]).otherwise(F.regexp_replace(text, '^"|"$', "")).alias("name"),
            F.when(is_object, F.coalesce(parsed["edgeType"], F.lit("call"))).otherwise("call").alias("edge_type"),
            F.when(is_object, parsed["event"]).alias("event"),
        )

    return raw.withColumn(column, F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), one))


def symbol_map(symbols: DataFrame) -> DataFrame:
    """(name, files): every name with its distinct files, sorted."""
    return symbols.groupBy("name").agg(F.sort_array(F.collect_set("file")).alias("files"))


def edges_of(symbols: DataFrame) -> DataFrame:
    """(src, dst, file, edge_type, event, ord) from symbols with calls; a listener's edge leads from its event to the handler.

    ord follows file, symbol and call order; duplicates stay. A file has under FILE_STEP calls: more would not fit a text.
    """
    # calls of the symbols before in the same file: symbols may have any number of them
    earlier = F.sum(F.greatest(F.size("calls"), F.lit(0)).cast("long")).over(Window.partitionBy("file").orderBy("sym_ord").rowsBetween(Window.unboundedPreceding, -1))
    flat = symbols.withColumn("before", F.coalesce(earlier, F.lit(0).cast("long"))).select("file", "file_ord", "before", F.col("name").alias("symbol"), F.posexplode("calls").alias("call_ord", "call"))
    listens = (F.col("call.edge_type") == "event_listen") & F.col("call.event").isNotNull()
    order = F.col("file_ord").cast("long") * FILE_STEP + F.col("before") + F.col("call_ord")
    return flat.select(
        F.when(listens, F.col("call.event")).otherwise(F.col("symbol")).alias("src"),
        F.col("call.name").alias("dst"),
        "file",
        F.coalesce("call.edge_type", F.lit("call")).alias("edge_type"),
        F.col("call.event").alias("event"),
        order.alias("ord"),
    )


def reverse_calls(edges: DataFrame) -> DataFrame:
    """(dst, callers): each callee or event with its callers' references in order."""
    ref = F.struct("ord", F.col("src").alias("caller"), "file", "edge_type")
    return edges.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(ref)), lambda r: r.dropFields("ord")).alias("callers"))


def file_dependents(imports: DataFrame) -> DataFrame:
    """(resolved, importers) without external modules."""
    return imports.where("resolved <> 'external'").groupBy("resolved").agg(F.sort_array(F.collect_set("importer")).alias("importers"))


def of_types(edges: DataFrame, edge_types: list[str] | None) -> DataFrame:
    """Edges of the wanted types; none named means all."""
    return edges.where(F.col("edge_type").isin(list(edge_types))) if edge_types else edges


def adjacency(edges: DataFrame, edge_types: list[str] | None = None) -> DataFrame:
    """(src, dst, edge_type, ord): distinct callees of each caller, under the type and place of the first edge; types are filtered first."""
    return of_types(edges, edge_types).groupBy("src", "dst").agg(F.min_by("edge_type", "ord").alias("edge_type"), F.min("ord").alias("ord"))


def counts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbols, files): distinct names and files."""
    return symbols.agg(F.countDistinct("name").alias("symbols")).crossJoin(files.agg(F.countDistinct("path").alias("files")))


def virtual_events(log: DataFrame, user: str, event: str, order: list[str]) -> DataFrame:
    """(src, dst, n) edges between consecutive events of a user: what was emitted leads to what followed."""
    before = F.lag(event).over(Window.partitionBy(user).orderBy(*order))
    return log.select(before.alias("src"), F.col(event).alias("dst")).where("src is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
