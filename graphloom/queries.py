"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import evaluate as E
from graphloom.operators import extract
from graphloom.operators import graph as G
from graphloom.operators import hashing as H
from graphloom.operators import index_build as D
from graphloom.operators import lookup as L
from graphloom.operators import search as S
from graphloom.operators import telemetry as T
from graphloom.operators import vectors as V
from graphloom.plans.session import shared_folder, small
from graphloom.registry import ORACLE_SQL, QUERIES, query
from graphloom.sources.driver import LINK_EDGES_SQL, document_files, link_edges, page_links, page_tags, part_symbols, table
from graphloom.streaming import refresh as R

def long(*columns: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# index build


@query("SELECT p_name AS name, list_sort(list(DISTINCT 'p' || p_partkey::VARCHAR)) AS files FROM part GROUP BY 1")
def symbol_map(spark: SparkSession, sf: str) -> DataFrame:
    return D.symbol_map(part_symbols(spark, sf))


@query(f"WITH e AS ({LINK_EDGES_SQL}) SELECT dst, count(*) AS callers, list(src || ':' || edge_type ORDER BY src || ':' || edge_type) AS refs FROM e WHERE dst LIKE 's%' OR dst LIKE 'n%' GROUP BY 1")
def reverse_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = link_edges(spark, sf).where(F.startswith("dst", F.lit("s")) | F.startswith("dst", F.lit("n")))
    turned = D.reverse_calls(e.withColumns({"file": F.lit("all"), "ord": F.concat_ws(":", "src", "edge_type")}))
    return turned.select("dst", F.size("callers").cast("bigint").alias("callers"), F.transform("callers", lambda r: F.concat_ws(":", r["caller"], r["edge_type"])).alias("refs"))


@query(
    """WITH e AS (SELECT 'p' || l_partkey::VARCHAR AS src, 's' || l_suppkey::VARCHAR AS dst, l_returnflag AS edge_type, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
    SELECT src, dst, min(edge_type) AS edge_type, min(ord) AS ord FROM (SELECT *, rank() OVER (PARTITION BY src, dst ORDER BY ord) AS r FROM e) WHERE r = 1 GROUP BY 1, 2"""
)
def adjacency_first_type(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    # (order, line) is not unique, so the type takes part in the order
    e = li.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("edge_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n")
    ).withColumn("ord", F.struct("n", "edge_type"))
    return D.adjacency(e).select("src", "dst", "edge_type", F.col("ord.n").alias("ord"))


@query("SELECT url AS resolved, list_sort(list(DISTINCT importer)) AS importers FROM (SELECT host AS url, page_id AS importer FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)) GROUP BY 1")
def file_dependents(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return D.file_dependents(table(spark, sf, "pages").select(F.col("page_id").alias("importer"), host.alias("resolved")))


@query("SELECT (SELECT count(DISTINCT p_name) FROM part) AS symbols, (SELECT count(DISTINCT doc_id) FROM documents) AS files")
def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.counts(part_symbols(spark, sf), document_files(spark, sf))


@query("WITH e AS (SELECT event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events) SELECT src, dst, count(*) AS n FROM e WHERE src IS NOT NULL GROUP BY 1, 2")
def event_virtual_edges(spark: SparkSession, sf: str) -> DataFrame:
    return D.virtual_events(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2")
def page_tag_edges(spark: SparkSession, sf: str) -> DataFrame:
    return page_tags(spark, sf).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT page_id, href, CASE WHEN starts_with(href, '.') OR starts_with(href, '/') THEN 'relative' ELSE 'external' END AS kind FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""")
def page_link_edges(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.startswith("href", F.lit(".")) | F.startswith("href", F.lit("/")), "relative").otherwise("external")
    return page_links(spark, sf).select("page_id", "href", kind.alias("kind")).distinct()


# incremental hashing


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the documents, every seventh with another text, and some that are gone."""
    d = document_files(spark, sf)
    text = F.when(F.col("doc_id") % 7 == 1, F.concat("content", F.lit(" old"))).otherwise(F.col("content"))
    old = d.where("doc_id % 3 <> 0").select("path", F.md5(text).alias("md5"))
    gone = d.where("doc_id % 10 = 0").select(F.concat(F.lit("gone/"), "path").alias("path"), F.md5("content").alias("md5"))
    return old.unionByName(gone)


_DOCS_SQL = "SELECT doc_id, lang || '/' || source || '/' || doc_id::VARCHAR AS path, md5(text) AS md5, text FROM documents"
_SNAPSHOT_SQL = "SELECT path, md5(CASE WHEN doc_id % 7 = 1 THEN text || ' old' ELSE text END) AS md5 FROM d WHERE doc_id % 3 <> 0 UNION ALL SELECT 'gone/' || path, md5 FROM d WHERE doc_id % 10 = 0"


@query(f"SELECT path, md5 FROM ({_DOCS_SQL})")
def hash_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return H.with_hashes(document_files(spark, sf))


@query(f"WITH d AS ({_DOCS_SQL}), s AS ({_SNAPSHOT_SQL}) SELECT d.path, d.md5 FROM d LEFT JOIN s USING (path) WHERE d.md5 IS DISTINCT FROM s.md5")
def changed_docs(spark: SparkSession, sf: str) -> DataFrame:
    return H.to_update(H.with_hashes(document_files(spark, sf)), _snapshot(spark, sf))


@query(f"WITH d AS ({_DOCS_SQL}), s AS ({_SNAPSHOT_SQL}) SELECT s.path, s.md5 FROM s ANTI JOIN d USING (path)")
def pruned_docs(spark: SparkSession, sf: str) -> DataFrame:
    return H.prune(_snapshot(spark, sf), H.with_hashes(document_files(spark, sf)))[1]


@query(
    f"""WITH d AS ({_DOCS_SQL}), s AS ({_SNAPSHOT_SQL}) SELECT CASE WHEN d.md5 IS NULL THEN 'gone' WHEN s.md5 IS NULL THEN 'new' WHEN s.md5 = d.md5 THEN 'same' ELSE 'changed' END AS status, count(*) AS n
    FROM d FULL JOIN s ON d.path = s.path GROUP BY 1"""
)
def snapshot_status(spark: SparkSession, sf: str) -> DataFrame:
    return H.classify(H.with_hashes(document_files(spark, sf)), _snapshot(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH d AS ({_DOCS_SQL}), s AS ({_SNAPSHOT_SQL}) SELECT path, md5 FROM d UNION ALL SELECT path, md5 FROM s ANTI JOIN d USING (path)")
def upserted_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return H.upsert(_snapshot(spark, sf), H.with_hashes(document_files(spark, sf)))


@query("SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# traversal

_DOWN_SQL = f"WITH RECURSIVE e AS ({LINK_EDGES_SQL}), r(node, hop) AS (SELECT '{{start}}', 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON r.node = e.src WHERE r.hop < {{depth}}{{types}}), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY 1)"
_UP_SQL = _DOWN_SQL.replace("SELECT e.dst,", "SELECT e.src,").replace("r.node = e.src", "r.node = e.dst")


def _start(spark: SparkSession, node: str) -> DataFrame:
    return spark.createDataFrame([(node, node)], "root string, node string")


@query(_DOWN_SQL.format(start="c7", depth=4, types="") + " SELECT hop::INTEGER AS hop, count(*) AS n, min(node) AS first_node FROM m GROUP BY 1")
def graph_down_reach(spark: SparkSession, sf: str) -> DataFrame:
    found = G.down_reach(link_edges(spark, sf, False), _start(spark, "c7"), 4)
    return found.groupBy("hop").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node"))


@query(_DOWN_SQL.format(start="c7", depth=4, types=" AND e.edge_type IN ('call', 'new')") + " SELECT node, hop::INTEGER AS hop FROM m")
def graph_down_typed(spark: SparkSession, sf: str) -> DataFrame:
    return G.down_reach(link_edges(spark, sf, False), _start(spark, "c7"), 4, ["call", "new"]).select("node", "hop")


@query(_UP_SQL.format(start="s1", depth=3, types="") + " SELECT hop::INTEGER AS hop, count(*) AS n, min(node) AS first_node FROM m GROUP BY 1")
def graph_up_reach(spark: SparkSession, sf: str) -> DataFrame:
    found = G.up_reach(link_edges(spark, sf, False), _start(spark, "s1"), 3)
    return found.groupBy("hop").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node"))


@query(
    _UP_SQL.format(start="n3", depth=3, types="")
    + ", h AS (SELECT m.node, m.hop, e.edge_type FROM m JOIN e ON e.src = m.node JOIN m AS b ON b.node = e.dst AND b.hop = m.hop - 1 WHERE m.hop > 0 GROUP BY ALL), f AS (SELECT node, hop, min(edge_type) AS edge_type FROM h GROUP BY 1, 2)"
    " SELECT hop::INTEGER AS hop, CASE hop WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect' ELSE hop::VARCHAR || '-hop' END AS label, edge_type, count(*) AS n FROM f GROUP BY ALL"
)
def impact_by_hop(spark: SparkSession, sf: str) -> DataFrame:
    order = F.when(F.col("edge_type") == "call", 1).when(F.col("edge_type") == "event_emit", 2).when(F.col("edge_type") == "event_listen", 3).when(F.col("edge_type") == "jsx", 4).when(F.col("edge_type") == "new", 5).otherwise(6)
    edges = link_edges(spark, sf, False).withColumns({"file": F.lit("all"), "ord": order.cast("bigint")})
    none = spark.createDataFrame([], "importer string, module string, resolved string")
    start = spark.createDataFrame([("n3", "all")], "symbol string, file string")
    return G.impact_summary(G.impact(edges, none, start, 3)).select("hop", "label", "edge_type", "n")


@query(
    """WITH RECURSIVE i AS (SELECT 'c' || c_custkey::VARCHAR AS importer, 'n' || c_nationkey::VARCHAR AS resolved FROM customer UNION ALL SELECT 's' || s_suppkey::VARCHAR, 'n' || s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation),
    r(root, file, distance) AS (SELECT 'r' || r_regionkey::VARCHAR, 'r' || r_regionkey::VARCHAR, 0 FROM region UNION SELECT r.root, i.importer, r.distance + 1 FROM r JOIN i ON r.file = i.resolved)
    SELECT root, file, min(distance)::INTEGER AS distance FROM r GROUP BY 1, 2"""
)
def import_distance(spark: SparkSession, sf: str) -> DataFrame:
    imports = link_edges(spark, sf, False).where(F.col("edge_type").isin("jsx", "event_emit", "event_listen")).select(F.col("src").alias("importer"), F.lit("m").alias("module"), F.col("dst").alias("resolved"))
    regions = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return G.import_distances(imports, regions.withColumn("node", F.col("root")))


@query("WITH o AS (SELECT o_custkey AS src, o_orderkey AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) SELECT src, dst, rank::INTEGER AS rank, greatest(total - 6, 0) AS hidden FROM o WHERE rank <= 6")
def fanout_topk(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("call").alias("edge_type"), F.col("o_orderkey").alias("ord"))
    return G.fan_out(edges).select("src", "dst", "rank", "hidden")


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), s AS (SELECT a.src, a.dst, CASE WHEN s_acctbal > 5000 THEN s_acctbal / 10000.0 ELSE 0.0 END AS sim FROM a LEFT JOIN supplier ON dst = s_suppkey),
    w AS (SELECT *, max(sim) OVER (PARTITION BY src) AS top FROM s) SELECT src, dst, round(sim, 6) AS sim FROM w WHERE sim > 0.1 OR top <= 0.1"""
)
def semantic_prune(spark: SparkSession, sf: str) -> DataFrame:
    near = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    sims = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("name"), (F.col("s_acctbal") / 10000.0).alias("max_sim"))
    return G.semantic_prune(near, sims).select("src", "dst", F.round("sim", 6).alias("sim"))


_SCOPE_SQL = """WITH refs AS (SELECT DISTINCT 'p' || (l_partkey % 50)::VARCHAR AS sym, 's' || l_suppkey::VARCHAR AS caller, 'n' || s_nationkey::VARCHAR AS file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 7 = 0),
    imports AS (SELECT DISTINCT 'n' || a.n_nationkey::VARCHAR AS importer, 'n' || b.n_nationkey::VARCHAR AS resolved FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
    f AS (SELECT refs.*, 'n' || n_nationkey::VARCHAR AS from_file FROM refs CROSS JOIN nation),
    m AS (SELECT f.*, (f.file = f.from_file OR EXISTS (SELECT 1 FROM imports i WHERE i.importer = f.file AND i.resolved = f.from_file))::INTEGER AS hit, EXISTS (SELECT 1 FROM imports i WHERE i.resolved = f.from_file) AS known FROM f),
    w AS (SELECT *, max(hit) OVER (PARTITION BY sym, from_file) AS hits FROM m)"""


@query(_SCOPE_SQL + " SELECT sym, from_file, count(*) AS kept, min(caller) AS first_caller FROM w WHERE NOT known OR hit = 1 OR hits = 0 GROUP BY 1, 2")
def caller_scope(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    sup, nat = table(spark, sf, "supplier"), table(spark, sf, "nation")
    li = table(spark, sf, "lineitem").where("l_suppkey % 7 = 0").select((F.col("l_partkey") % 50).alias("k"), "l_suppkey").distinct()
    refs = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(key("p", "k").alias("sym"), key("s", "l_suppkey").alias("caller"), key("n", "s_nationkey").alias("file"))
    other = nat.select(F.col("n_nationkey").alias("k2"), F.col("n_regionkey").alias("r2"))
    imports = nat.join(other, (F.col("n_regionkey") == F.col("r2")) & (F.col("n_nationkey") < F.col("k2"))).select(key("n", "n_nationkey").alias("importer"), key("n", "k2").alias("resolved"))
    scoped = G.scope_callers(refs.crossJoin(small(nat.select(key("n", "n_nationkey").alias("from_file")))), imports)
    return scoped.groupBy("sym", "from_file").agg(F.count(F.lit(1)).alias("kept"), F.min("caller").alias("first_caller"))


@query(
    """WITH c AS (SELECT DISTINCT 'p' || (l_partkey % 20)::VARCHAR AS sym, 's' || l_suppkey::VARCHAR AS caller, 'n' || s_nationkey::VARCHAR AS file, l_suppkey AS ord FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    d AS (SELECT 'n' || n_nationkey::VARCHAR AS file, n_regionkey AS distance FROM nation WHERE n_regionkey < 3),
    g AS (SELECT sym, file, list(caller ORDER BY ord) AS callers, min(ord) AS ord FROM c GROUP BY 1, 2),
    r AS (SELECT g.*, distance, row_number() OVER (PARTITION BY sym ORDER BY distance NULLS LAST, ord, g.file) AS rank, count(*) OVER (PARTITION BY sym) AS files FROM g LEFT JOIN d USING (file))
    SELECT sym, file, rank::INTEGER AS rank, distance, callers[1:3] AS callers, greatest(len(callers) - 3, 0)::INTEGER AS hidden_callers, greatest(files - 5, 0) AS hidden_files FROM r WHERE rank <= 5"""
)
def callers_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    li = table(spark, sf, "lineitem").select((F.col("l_partkey") % 20).alias("k"), "l_suppkey").distinct()
    callers = li.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(key("p", "k").alias("sym"), key("s", "l_suppkey").alias("caller"), key("n", "s_nationkey").alias("file"), F.col("l_suppkey").alias("ord"))
    distances = table(spark, sf, "nation").where("n_regionkey < 3").select(key("n", "n_nationkey").alias("file"), F.col("n_regionkey").alias("distance"))
    return G.callers_by_distance(callers, distances)


@query(
    f"""WITH RECURSIVE e AS ({LINK_EDGES_SQL}), a AS (SELECT src, dst, edge_type, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank, count(*) OVER (PARTITION BY src) AS total FROM e),
    k AS (SELECT src, dst, edge_type, rank, greatest(total - 6, 0) AS hidden FROM a WHERE rank <= 6),
    r(node, hop) AS (SELECT 'c1', 0 UNION SELECT k.dst, r.hop + 1 FROM r JOIN k ON r.node = k.src WHERE r.hop < 3), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY 1)
    SELECT 'c1' AS root, (hop + 1)::INTEGER AS hop, src, dst, edge_type, rank::INTEGER AS rank, hidden FROM m JOIN k ON m.node = k.src"""
)
def graph_down_capped(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], "name string, file string")
    return G.down_capped(link_edges(spark, sf, False).withColumn("ord", F.lit(0).cast("bigint")), none, _start(spark, "c1"), 4)


# vectors

_VECTORS_SQL = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"


@query(f"WITH e AS ({_VECTORS_SQL}), q AS (SELECT v AS q FROM e WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS sim FROM e, q WHERE vec_id <> 7 ORDER BY round(list_cosine_similarity(v, q), 9) DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return V.cosine_topk(table(spark, sf, "embeddings"), "vec_id", "embedding", 7, 20).withColumn("sim", F.round("sim", 6))


@query(f"WITH e AS ({_VECTORS_SQL}), q AS (SELECT v[1:16] AS q FROM e WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(v[1:16], q), 6) AS sim FROM e, q")
def cosine_truncated(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", X.truncate_dims(F.col("embedding"), 16).alias("vec"))
    return V.with_similarity(e, e.where("vec_id = 7").select(F.col("vec").alias("query_vec"))).select("vec_id", F.round("sim", 6).alias("sim"))


@query(f"WITH e AS ({_VECTORS_SQL}), q AS (SELECT v AS q FROM e WHERE vec_id = 7) SELECT label AS name, round(greatest(0, max(list_cosine_similarity(v, q))), 6) AS max_sim FROM e, q WHERE vec_id <> 7 GROUP BY 1")
def max_sim_per_label(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    vectors = e.where("vec_id <> 7").select(F.col("label").alias("name"), F.col("embedding").alias("vec"))
    return V.best_similarity(vectors, e.where("vec_id = 7").select(F.col("embedding").alias("query_vec"))).select("name", F.round("max_sim", 6).alias("max_sim"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 OR label = 4")
def vectors_to_embed(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.lit("f").alias("file"), F.lit("m").alias("md5"), "vec_id", "label")
    cache = wanted.withColumn("version", F.when(F.col("label") == 4, "1").otherwise("2")).where("vec_id % 3 = 0")
    return V.to_embed(wanted, V.cached_of(cache, "2")).select("vec_id")


# search


@query("SELECT DISTINCT p_name AS name, 'p' || p_partkey::VARCHAR AS path FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def search_exact(spark: SparkSession, sf: str) -> DataFrame:
    symbols = part_symbols(spark, sf)
    return S.exact(symbols, symbols.agg(F.min("name")).first()[0])


@query("WITH n AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part WHERE starts_with(lower(p_name), 'co') GROUP BY 1) SELECT name FROM n ORDER BY ord, name LIMIT 5")
def search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return S.prefix_names(part_symbols(spark, sf), "Co").select("name")


_FUZZY_SQL = """WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, 1 - levenshtein('wdg', lower(name)) / greatest(3, length(name))::DOUBLE AS raw FROM n WHERE regexp_matches(lower(name), 'w.*d.*g')),
    k AS (SELECT * FROM c WHERE raw > 0 ORDER BY round(raw, 9) DESC, name LIMIT 50), s AS (SELECT name, raw * CASE WHEN 3.0 / length(name) < 0.4 THEN 3.0 / length(name) / 0.4 ELSE 1 END AS score FROM k)"""


@query(_FUZZY_SQL + " SELECT name, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, name LIMIT 20")
def search_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    names = part_symbols(spark, sf).groupBy("name").agg(F.collect_set("file").alias("paths"))
    return S.fuzzy_scores(names, "wdg").select("name", F.round("score", 6).alias("score"))


@query(
    _FUZZY_SQL
    + f""", t AS (SELECT name, score FROM s ORDER BY round(score, 9) DESC, name LIMIT 20), e AS ({_VECTORS_SQL}), q AS (SELECT v AS q FROM e WHERE vec_id = 7),
    m AS (SELECT p_name AS name, greatest(0, max(list_cosine_similarity(v, q))) AS sim FROM part JOIN e ON e.vec_id = p_partkey, q GROUP BY 1)
    SELECT name, round(CASE WHEN coalesce(sim, 0) > 0 THEN 0.4 * score + 0.6 * sim ELSE score END, 6) AS final FROM t LEFT JOIN m USING (name)"""
)
def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.collect_set(F.col("p_partkey").cast("string")).alias("paths"))
    e = table(spark, sf, "embeddings")
    vectors = table(spark, sf, "part").join(e, F.col("p_partkey") == F.col("vec_id")).select(F.col("p_name").alias("name"), F.col("embedding").alias("vec"))
    return S.rerank(S.fuzzy_scores(parts, "wdg"), vectors, e.where("vec_id = 7").select(F.col("embedding").alias("query_vec"))).select("name", F.round("final", 6).alias("final"))


@query("SELECT url AS path FROM pages WHERE contains(lower(url), 'en') AND page_id % 2 = 0 ORDER BY 1 LIMIT 15")
def search_path(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id")
    return S.path_matches(pages, "EN", seen=pages.where("page_id % 2 <> 0"))


@query("WITH w AS (SELECT source, doc_id, lang, max((lang = 'de' AND doc_id % 11 = 0)::INTEGER) OVER (PARTITION BY source) AS hits FROM documents) SELECT source, doc_id FROM w WHERE (lang = 'de' AND doc_id % 11 = 0) OR hits = 0")
def layer_fallback(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.when((F.col("lang") == "de") & (F.col("doc_id") % 11 == 0), "server").otherwise("other")
    rows = table(spark, sf, "documents").select("source", "doc_id", F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"))
    return S.layer_or_all(rows, "server", "source").select("source", "doc_id")


_RULES = [(0, "almond", "nuts"), (1, "blue", "colours"), (2, "on", "metals"), (3, "widget", "things")]


@query("WITH r(rule_ord, keyword, hint) AS (VALUES (0, 'almond', 'nuts'), (1, 'blue', 'colours'), (2, 'on', 'metals'), (3, 'widget', 'things')), n AS (SELECT DISTINCT lower(p_name) AS query FROM part) SELECT query, arg_min(hint, rule_ord) AS hint FROM n JOIN r ON contains(query, keyword) OR contains(keyword, query) GROUP BY 1")
def hint_rules(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "part").select(F.lower("p_name").alias("query")).distinct()
    return S.hints(spark.createDataFrame(_RULES, "rule_ord int, keyword string, hint string"), asked)


@query(
    """WITH l AS (SELECT doc_id, k - 1 AS line_no, string_split(text, chr(10))[k] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(k) WHERE contains(text, 'token = ')), h AS (SELECT * FROM l WHERE contains(line, 'token = '))
    SELECT doc_id::VARCHAR AS path, count(*) AS n, min(line_no)::INTEGER AS line_no, arg_min(trim(line), line_no) AS example FROM h GROUP BY 1"""
)
def text_match_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return S.text_matches(docs, "token = ")


_PAGE_PATH = "url || CASE page_id % 5 WHEN 0 THEN '/a.spec.ts' WHEN 1 THEN '/E2E/b.ts' WHEN 2 THEN '/__tests__/c.ts' WHEN 3 THEN '/spec.tsx' ELSE '/d.test.tsx' END"


@query(f"SELECT {_PAGE_PATH} AS path, page_id % 5 <> 3 AS tested, string_split({_PAGE_PATH}, '/')[-1] AS base FROM pages WHERE NOT regexp_matches(lower(url), '[.](test|spec)[.]ts|/e2e/|/__tests__/')")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").where(~F.lower("url").rlike("[.](test|spec)[.]ts|/e2e/|/__tests__/")).select(F.expr(_PAGE_PATH).alias("path"))
    return p.select("path", X.is_test_file(F.col("path")).alias("tested"), X.basename(F.col("path")).alias("base"))


# lookup and telemetry


@query("SELECT doc_id FROM documents WHERE ends_with(lower(lang || '/' || source || '/' || doc_id::VARCHAR), '/7')")
def same_file_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return document_files(spark, sf).where(L.same_file(F.col("path"), "/7")).select("doc_id")


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS dst, min(l_orderkey) OVER (PARTITION BY l_suppkey) AS ord FROM lineitem WHERE l_partkey = 5), f AS (SELECT s_suppkey AS dst, s_nationkey AS file, s_name AS skeleton FROM supplier)
    SELECT 's' || dst::VARCHAR AS dst, 'n' || file::VARCHAR AS file, n_name AS skeleton FROM (SELECT file, min(ord) AS ord, arg_min(dst, (ord, dst)) AS dst FROM e JOIN f USING (dst) GROUP BY file) JOIN nation ON file = n_nationkey ORDER BY ord, dst LIMIT 5"""
)
def callee_context(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, sf, "lineitem").where("l_partkey = 5").select(F.lit("p5").alias("src"), key("s", "l_suppkey").alias("dst"), (F.col("l_orderkey") * 100_000 + F.col("l_suppkey")).alias("ord"))
    symbols = table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("name"), key("n", "s_nationkey").alias("file"), F.lit(0).alias("file_ord"), F.lit(0).alias("sym_ord"))
    skeletons = table(spark, sf, "nation").select(key("n", "n_nationkey").alias("path"), F.col("n_name").alias("skeleton"))
    return L.callee_context(edges, symbols, skeletons, "p5")


@query("SELECT count(*) AS calls, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, round((max(turn) - min(turn))::DOUBLE, 6) AS seconds FROM conversations")
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("role").alias("tool"), F.col("conv_id").cast("string").alias("symbol"), "text", F.timestamp_seconds("turn").alias("ts"))
    return T.totals(T.log_calls(c)).withColumn("seconds", F.round("seconds", 6))


@query("WITH h AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT count(*) AS symbols, count(CASE WHEN n > 1 THEN 1 END) AS repeated, round(count(CASE WHEN n > 1 THEN 1 END) / count(*), 6) AS rate FROM h")
def repeat_rate(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").where("event_type <> 'view'").select(F.col("user_id").alias("symbol"))
    return T.repeat_rate(calls).withColumn("rate", F.round("rate", 6))


@query("SELECT user_id AS symbol, count(*) AS hits FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def hot_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return T.hot_symbols(table(spark, sf, "events").select(F.col("user_id").alias("symbol")))


# sessions and evaluation


@query("WITH t AS (SELECT conv_id, turn, role, text, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations) SELECT conv_id, t::INTEGER AS turn, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM t GROUP BY 1, 2")
def session_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumnRenamed("turn", "pos")
    turns = E.turn_ids(c, F.col("role") == "user", "conv_id", "pos")
    said = F.array_sort(F.collect_list(F.struct("pos", "role")))
    return turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(said, lambda r: r["role"]), ",").alias("roles"))


@query("SELECT conv_id, role, min(turn) AS first, arg_max(text, turn) AS content FROM conversations GROUP BY 1, 2")
def last_content(spark: SparkSession, sf: str) -> DataFrame:
    return E.last_content(table(spark, sf, "conversations"), "role", "turn", "text", "conv_id")


@query("SELECT conv_id, count(*) AS calls, round(avg((role = 'assistant')::INTEGER), 6) AS share, count(*) > 10 AS too_many, avg((role = 'assistant')::INTEGER) > 0.3 AS over, avg((role = 'assistant')::INTEGER) < 0.05 AS under FROM conversations GROUP BY 1")
def tool_share(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "conversations").withColumnRenamed("role", "tool")
    return E.call_share(calls, "assistant", "conv_id", F.lit(True)).withColumn("share", F.round("share", 6))


_TERMS_SQL = "SELECT DISTINCT item_id, unnest(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 6)) AS term FROM benchmark WHERE item_id < 40"


@query(
    f"""WITH t AS ({_TERMS_SQL}), a AS (SELECT doc_id AS item_id, lower(text) AS answer FROM documents), h AS (SELECT item_id, coalesce(contains(answer, term), false)::INTEGER AS hit FROM t LEFT JOIN a USING (item_id))
    SELECT item_id, sum(hit)::BIGINT AS found, count(*) AS total, round(avg(hit), 6) AS coverage, avg(hit) < 1 AS flagged FROM h GROUP BY 1"""
)
def key_term_coverage(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 6)
    terms = table(spark, sf, "benchmark").where("item_id < 40").select("item_id", F.explode(words).alias("term")).distinct()
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("answer"))
    return E.term_coverage(answers, terms, "item_id").withColumn("coverage", F.round("coverage", 6))


_TRUTH_SQL = "SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, 'src/' || (o_orderkey % 40)::VARCHAR AS file FROM orders WHERE o_custkey % 25 = 0"
_RETRIEVED_SQL = "SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS pos, (o_orderkey % 40)::VARCHAR || '.ts' AS name FROM orders WHERE o_custkey % 25 = 0 AND o_orderkey % 3 <> 0"


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_custkey % 25 = 0")
    window = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_custkey").alias("k"), (F.row_number().over(window) - 1).cast("bigint").alias("ord"), F.concat(F.lit("src/"), (F.col("o_orderkey") % 40).cast("string")).alias("file"))


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_custkey % 25 = 0 and o_orderkey % 3 <> 0")
    window = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return o.select(F.col("o_custkey").alias("k"), (F.row_number().over(window) - 1).cast("bigint").alias("pos"), F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit(".ts")).alias("name"))


_POSITION_SQL = f"t AS ({_TRUTH_SQL}), r AS ({_RETRIEVED_SQL}), p AS (SELECT t.k, t.ord, t.file, min(pos) + 1 AS position FROM t LEFT JOIN r ON t.k = r.k AND contains(r.name, string_split(t.file, '/')[-1]) GROUP BY 1, 2, 3)"


@query(f"WITH {_POSITION_SQL} SELECT * FROM p")
def retrieval_position(spark: SparkSession, sf: str) -> DataFrame:
    return E.retrieval_positions(_truth(spark, sf), _retrieved(spark, sf), "k")


@query(
    f"""WITH {_POSITION_SQL}, e AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord) AS rank, file AS expected FROM p), a AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY position NULLS LAST, ord) AS rank, file AS actual FROM p)
    SELECT k, rank::INTEGER AS rank, expected, actual FROM e JOIN a USING (k, rank)"""
)
def order_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return E.order_alignment(E.retrieval_positions(_truth(spark, sf), _retrieved(spark, sf), "k"), "k")


@query(
    f"""WITH t AS (SELECT DISTINCT k, file FROM ({_TRUTH_SQL})), r AS ({_RETRIEVED_SQL}), i AS (SELECT k, name FROM r WHERE pos % 2 = 0), g AS (SELECT k, name FROM r WHERE pos % 2 = 1), b AS (SELECT k, file, string_split(file, '/')[-1] AS base FROM t)
    SELECT k, file, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.k = b.k AND contains(i.name, base)) THEN 'implement' WHEN EXISTS (SELECT 1 FROM g WHERE g.k = b.k AND contains(g.name, base)) THEN 'graph' END AS source FROM b"""
)
def file_hits(spark: SparkSession, sf: str) -> DataFrame:
    r = _retrieved(spark, sf)
    none = spark.createDataFrame([], "k bigint, answer string")
    return E.file_hits(_truth(spark, sf).select("k", "file").distinct(), r.where("pos % 2 = 0").select("k", F.col("name").alias("file")), r.where("pos % 2 = 1").select("k", F.col("name").alias("path")), none, "k")


@query("SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'both' WHEN quality = 0 THEN 'quality' ELSE 'toxic' END AS type, count(*) AS n FROM labels WHERE quality = 0 OR toxic = 1 GROUP BY 1")
def error_counts(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "labels").where("quality = 0 or toxic = 1")
    return E.error_counts(bad.select(F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "both").when(F.col("quality") == 0, "quality").otherwise("toxic").alias("type")))


@query("WITH c AS (SELECT source AS question, min(doc_id) AS id FROM documents WHERE doc_id < 12 GROUP BY 1) SELECT id, count(*) AS turns FROM documents JOIN c ON source = question GROUP BY 1")
def case_match(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    turns = d.select("doc_id", F.col("source").alias("query"))
    cases = d.where("doc_id < 12").select(F.col("doc_id").alias("id"), F.col("source").alias("question"))
    return E.match_cases(turns, cases).groupBy("id").agg(F.count(F.lit(1)).alias("turns"))


@query("SELECT event_type, avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS mean_k, count(*) AS n FROM events GROUP BY 1")
def json_arguments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "map<string,string>")["k"].cast("int")
    return table(spark, sf, "events").groupBy("event_type").agg(F.avg(k).alias("mean_k"), F.count(F.lit(1)).alias("n"))


# extraction and streaming: rows only, tests hold them against snippets


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source text for each supplier, calling what its parts' names say, importing its nation's file."""
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    parts = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().where("l_partkey % 10 = 0").join(table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z]", "_").alias("f")), F.col("l_partkey") == F.col("p_partkey"))
    calls = parts.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("f", F.lit("(x);")))), " ").alias("body"))
    text = F.concat(F.lit("import { n } from '../nation/n"), F.col("s_nationkey").cast("string"), F.lit("';\nexport function supplier"), F.col("s_suppkey").cast("string"), F.lit("(x: Input): Output { "), F.coalesce("body", F.lit("")), F.lit(" bus.emit('sold'); }\n"))
    path = lambda folder, c: F.concat(F.lit(folder), F.col(c).cast("string"), F.lit(".ts"))
    nations = table(spark, sf, "nation").select(path("server/nation/n", "n_nationkey").alias("path"), F.concat(F.lit("export const n = () => start('"), "n_name", F.lit("');\n")).alias("content"))
    return sup.join(calls, "s_suppkey", "left").select(path("server/supplier/s", "s_suppkey").alias("path"), text.alias("content")).unionByName(nations)


_CALLED_SQL = """WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), p AS (SELECT DISTINCT l_suppkey, regexp_replace(p_name, '[^A-Za-z]', '_', 'g') AS f FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 10 = 0)"""


@query(_CALLED_SQL + " SELECT 'supplier' || l_suppkey::VARCHAR AS src, f AS dst FROM p")
def extracted_calls(spark: SparkSession, sf: str) -> DataFrame:
    files = _sources(spark, sf).withColumn("file_ord", F.lit(0))
    edges = D.edges_of(extract.symbols_of(extract.scan_files(files), files))
    return edges.where("edge_type = 'call' and src like 'supplier%'").select("src", "dst")


@query("SELECT 'server/supplier/s' || s_suppkey::VARCHAR || '.ts' AS importer, 'server/nation/n' || s_nationkey::VARCHAR || '.ts' AS resolved FROM supplier")
def extracted_imports(spark: SparkSession, sf: str) -> DataFrame:
    files = _sources(spark, sf)
    return extract.imports_of(extract.scan_files(files), files).select("importer", "resolved")


@query("SELECT 'function' AS type, count(*) AS n FROM supplier UNION ALL SELECT 'variable_function', count(*) FROM nation")
def extracted_symbols(spark: SparkSession, sf: str) -> DataFrame:
    files = _sources(spark, sf).withColumn("file_ord", F.lit(0))
    return extract.symbols_of(extract.scan_files(files), files).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'supplier' || s_suppkey::VARCHAR AS name, 'server/supplier/s' || s_suppkey::VARCHAR || '.ts' AS file FROM supplier UNION ALL SELECT 'n', 'server/nation/n' || n_nationkey::VARCHAR || '.ts' FROM nation")
def streaming_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Sources arrive as files of a stream in two batches; the newest snapshot's symbols are those of all sources."""
    base = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    files = _sources(spark, sf).repartition(2, "path")
    for half in (0, 1):
        files.where(F.pmod(F.xxhash64("path"), F.lit(2)) == half).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("path string, content string").parquet(f"{base}/in")
        R.watch(stream, f"{base}/index", f"{base}/state").awaitTermination()
    return R.read_snapshot(spark, f"{base}/index")["symbols"].select("name", "file")
