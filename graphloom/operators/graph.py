"""Graph traversal: reach, import distance, capped and pruned neighbourhoods, caller scoping and impact.

Loops are level by level: the frontier is joined with the edges, what was visited before is
anti-joined away, and each level is cut to reliable storage, so that plans stay short and a
lost executor costs one level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import edge_label, hop_label, in_layer, is_test_file
from graphloom.operators.index_build import adjacency, of_types
from graphloom.operators.search import layer_or_all
from graphloom.plans.schema import EDGE_TYPES
from graphloom.plans.session import cut, small_rows

DEFAULT_DEPTH, MAX_DEPTH, FAN_OUT, UP_FILES, UP_FILES_LAYER, UP_CALLERS, IMPACT_SHOWN = 4, 6, 6, 5, 8, 3, 15
MIN_SIMILARITY = 0.1


def clamp_depth(depth: int | None) -> int:
    depth = DEFAULT_DEPTH if depth is None else depth
    if depth <= 0:
        raise ValueError("depth must be positive")
    return min(depth, MAX_DEPTH)


def check_types(edge_types: list[str] | None) -> list[str] | None:
    unknown = sorted(set(edge_types or ()) - set(EDGE_TYPES))
    if unknown:
        raise ValueError(f"unknown edge types: {unknown}")
    return edge_types


def reach(edges: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """(root, node, hop): every node within depth hops (None: all) of the starts (root, node), at its smallest hop."""
    # computed and shuffled once for all hops: a level then moves to its edges. Not made distinct: what a level reaches
    # is, and that is far less than all edges
    steps = cut(edges.select("src", "dst").repartition("src"))
    level = visited = cut(starts.select("root", "node").distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        ahead = level.join(steps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        level = cut(ahead.join(visited.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def down_reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """Smallest hops downstream over the uncapped graph of the wanted types."""
    return reach(of_types(edges, check_types(edge_types)), starts, clamp_depth(depth))


def up_reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """Smallest hops upstream."""
    turned = of_types(edges, check_types(edge_types)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(turned, starts, clamp_depth(depth))


def import_distances(imports: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, file, distance) over importers, as far as they go; starts is (root, node)."""
    turned = imports.where("resolved <> 'external'").select(F.col("resolved").alias("src"), F.col("importer").alias("dst"))
    return reach(turned, starts, None).select("root", F.col("node").alias("file"), F.col("hop").alias("distance"))


def layer_pass(adjacent: DataFrame, symbols: DataFrame, layer: str | None) -> DataFrame:
    """Edges whose callee has a file in the layer, or no file at all."""
    if not layer:
        return adjacent
    homes = symbols.groupBy(F.col("name").alias("dst")).agg(F.max(in_layer(F.col("file"), layer).cast("int")).alias("__in"))
    return adjacent.join(homes, "dst", "left").where(F.col("__in").isNull() | (F.col("__in") == 1)).select(*adjacent.columns)


def semantic_prune(adjacent: DataFrame, similarity: DataFrame, floor: float = MIN_SIMILARITY) -> DataFrame:
    """adjacent (src, dst, ...) with sim from similarity (name, max_sim): callees over the floor, or all of a caller that has none over it."""
    sims = similarity.select(F.col("name").alias("dst"), F.col("max_sim").alias("sim"))
    scored = adjacent.join(sims, "dst", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    # combined before the shuffle and joined back, so that a caller of very many callees is no single task
    top = scored.groupBy(F.col("src").alias("__src")).agg(F.max("sim").alias("__top"))
    return scored.join(top, F.col("src").eqNullSafe(F.col("__src"))).where((F.col("sim") > floor) | (F.col("__top") <= floor)).drop("__top", "__src")


def fan_out(adjacent: DataFrame, limit: int = FAN_OUT, by_similarity: bool = False) -> DataFrame:
    """The first callees of each caller with rank and hidden, the number of those left out."""
    order = [F.desc("sim"), "ord", "dst"] if by_similarity else ["ord", "dst"]
    window = Window.partitionBy("src")
    ranked = adjacent.withColumn("rank", F.row_number().over(window.orderBy(*order)))
    # counted apart from the ranking: with the rank alone in its window, Spark drops rows over the limit before the shuffle
    totals = adjacent.groupBy("src").agg(F.count(F.lit(1)).alias("total"))
    kept = ranked.where(F.col("rank") <= limit)
    return kept.join(totals, "src").withColumn("hidden", F.greatest(F.col("total") - limit, F.lit(0))).drop("total")


def down_capped(edges: DataFrame, symbols: DataFrame, starts: DataFrame, depth: int | None = None, edge_types: list[str] | None = None, layer: str | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """(root, hop, src, dst, edge_type, rank, hidden): the edges that the capped tree of each start (root, node) can show.

    Any node may be a start, events too. The cap of a node depends on the node alone, so the
    tree's edges are those of a level-by-level walk over capped edges; a level's edges alone are
    made distinct, ranked and capped, once for each node, and the others are only read.
    """
    check_types(edge_types)
    level = visited = cut(starts.select("root", "node").distinct().withColumn("hop", F.lit(0)))
    before, capped, shown = None, None, []
    for hop in range(1, clamp_depth(depth) + 1):
        nodes = level.select(F.col("node").alias("src")).distinct()
        if before is not None:
            nodes = nodes.join(before.select(F.col("node").alias("src")), "src", "left_anti")
        own = edges.join(small_rows(cut(nodes), "src"), "src", "left_semi")
        near = layer_pass(adjacency(own, edge_types), symbols, layer)
        if similarity is not None:
            near = semantic_prune(near, similarity)
        found = cut(fan_out(cut(near), FAN_OUT, similarity is not None).select("src", "dst", "edge_type", "rank", "hidden"))
        capped = found if capped is None else capped.unionByName(found)
        edges_of_level = level.join(capped, F.col("node") == F.col("src"))
        shown.append(edges_of_level.select("root", (F.col("hop") + 1).alias("hop"), "src", "dst", "edge_type", "rank", "hidden"))
        if hop == clamp_depth(depth):
            break
        ahead = edges_of_level.select("root", F.col("dst").alias("node")).distinct()
        before = visited
        level = cut(ahead.join(visited.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return reduce(DataFrame.unionByName, shown)


def scope_callers(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (sym, from_file, caller, file, ...): callers whose file imports from_file or is it.

    If from_file has no importers, or none of a symbol's callers qualifies, all of them stay.
    """
    pairs = imports.select(F.col("importer").alias("file"), F.col("resolved").alias("from_file")).where("from_file <> 'external'").distinct()
    known = pairs.select("from_file").distinct().withColumn("__known", F.lit(True))
    marked = refs.join(pairs.withColumn("__imports", F.lit(True)), ["file", "from_file"], "left").join(known, "from_file", "left")
    hit = F.coalesce("__imports", F.lit(False)) | F.col("file").eqNullSafe(F.col("from_file"))
    marked = marked.withColumn("__hit", hit)
    # combined before the shuffle and joined back: a symbol that all files call is no single task
    some = marked.groupBy(F.col("sym").alias("__sym"), F.col("from_file").alias("__from")).agg(F.max(F.col("__hit").cast("int")).alias("__any"))
    same = F.col("sym").eqNullSafe(F.col("__sym")) & F.col("from_file").eqNullSafe(F.col("__from"))
    keep = F.col("__known").isNull() | F.col("__hit") | (F.col("__any") == 0)
    return marked.join(some, same).where(keep).select(*refs.columns)


def callers_by_distance(callers: DataFrame, distances: DataFrame, layer: str | None = None, limit: int | None = None) -> DataFrame:
    """callers (sym, caller, file, ord) grouped by file: (sym, file, rank, distance, callers, hidden_callers, hidden_files).

    Test files are hidden; files are ranked by import distance (file, distance), those without
    one last, then by first appearance; five are shown, eight with a layer; three callers of each.
    """
    limit = limit or (UP_FILES_LAYER if layer else UP_FILES)
    rows = layer_or_all(callers, layer, "sym", path="file").where(~is_test_file(F.col("file")))
    per = rows.groupBy("sym", "file").agg(F.count(F.lit(1)).alias("refs"), F.min("ord").alias("ord"))
    far = per.join(distances.select("file", "distance"), "file", "left")
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("sym").orderBy(F.asc_nulls_last("distance"), "ord", "file")))
    totals = per.groupBy("sym").agg(F.count(F.lit(1)).alias("files"))
    shown = ranked.where(F.col("rank") <= limit).join(totals, "sym")
    # with the rank alone in its window, Spark drops callers over the limit before the shuffle
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("sym", "file").orderBy("ord", "caller"))).where(F.col("place") <= UP_CALLERS)
    names = first.groupBy("sym", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "caller"))), lambda r: r["caller"]).alias("callers"))
    return shown.join(names, ["sym", "file"]).select(
        "sym", "file", "rank", "distance", "callers", F.greatest(F.col("refs") - UP_CALLERS, F.lit(0)).cast("int").alias("hidden_callers"), F.greatest(F.col("files") - limit, F.lit(0)).alias("hidden_files")
    )


def impact(
    edges: DataFrame, imports: DataFrame, starts: DataFrame, depth: int | None = None, edge_types: list[str] | None = None, layer: str | None = None, hide_tests: bool = True
) -> DataFrame:
    """(hop, symbol, file, edge_type): every caller state (symbol, file) upstream of the starts (symbol, file), once, at its first hop.

    Callers are scoped by imports first; types, the strict layer and test files are filtered
    after that, and what is filtered is not followed. The type is that of the first edge, by
    the order of the frontier and of the edges.
    """
    check_types(edge_types)
    turned = cut(edges.select(F.col("dst").alias("sym"), F.col("src").alias("caller"), "file", "edge_type", "ord").repartition("sym"))
    level = cut(starts.select(F.col("symbol"), "file").distinct().withColumns({"hop": F.lit(0), "edge_type": F.lit(None).cast("string"), "place": F.lit(0).cast("bigint")}))
    visited, found = level.select("symbol", "file"), []
    for hop in range(1, clamp_depth(depth) + 1):
        refs = level.select(F.col("symbol").alias("sym"), F.col("file").alias("from_file"), "place").join(turned, "sym")
        refs = of_types(scope_callers(refs, imports), edge_types)
        if layer:
            refs = refs.where(in_layer(F.col("file"), layer))
        if hide_tests:
            refs = refs.where(~is_test_file(F.col("file")))
        first = F.struct("place", "ord")
        ahead = refs.groupBy(F.col("caller").alias("symbol"), "file").agg(F.min_by("edge_type", first).alias("edge_type"), F.min("ord").alias("place"))
        level = cut(ahead.join(visited, ["symbol", "file"], "left_anti").withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            break
        found.append(level)
        visited = visited.unionByName(level.select("symbol", "file"))
    if not found:
        return level.select("hop", "symbol", "file", "edge_type").where("hop > 0")
    return reduce(DataFrame.unionByName, found).select("hop", "symbol", "file", "edge_type")


def impact_summary(states: DataFrame, shown: int = IMPACT_SHOWN) -> DataFrame:
    """(hop, label, edge_type, tag, n, names): the states of each hop by edge type, with the first names."""
    ranked = states.withColumn("rank", F.row_number().over(Window.partitionBy("hop", "edge_type").orderBy("symbol", "file")))
    names = F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", "symbol"))))
    grouped = ranked.groupBy("hop", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.transform(names, lambda x: x["symbol"]).alias("names"))
    return grouped.select("hop", hop_label(F.col("hop")).alias("label"), "edge_type", edge_label(F.col("edge_type")).alias("tag"), "n", "names")
