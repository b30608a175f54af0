"""Named queries over generated source trees: every extraction rule, and the index as its users call it.

A file is made for each supplier; what must be found in it follows from the supplier's key, so
that SQL can say it without reading a line of code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evaluate as E
from graphloom.operators import extract, lookup
from graphloom.operators import index_build as D
from graphloom.operators import search as S
from graphloom.plans.api import Index
from graphloom.plans.session import cut
from graphloom.registry import query
from graphloom.sources.driver import table

#: Stands for the supplier's key in code and in what is expected.
KEY = "@@"


def _files(spark: SparkSession, sf: str, code: str, path: str = f"server/s{KEY}.tsx") -> DataFrame:
    """(k, path, content, file_ord): the code of every supplier."""
    k = F.col("s_suppkey").cast("string")
    fill = lambda text: F.replace(F.lit(text), F.lit(KEY), k)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), fill(path).alias("path"), fill(code).alias("content"), F.col("s_suppkey").cast("int").alias("file_ord"))


def _symbols(spark: SparkSession, sf: str, code: str) -> DataFrame:
    files = _files(spark, sf, code)
    return extract.symbols_of(extract.scan_files(files), files)


def _sql(columns: list[str], rows: list[tuple]) -> str:
    value = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    kinds = ["BOOLEAN" if isinstance(rows[0][i], bool) else "INTEGER" if isinstance(rows[0][i], int) else "VARCHAR" for i in range(len(columns))]
    shown = ", ".join(f"replace(v.{c}, '{KEY}', s_suppkey::VARCHAR) AS {c}" if t == "VARCHAR" else f"v.{c}::{t} AS {c}" for c, t in zip(columns, kinds))
    return f"SELECT s_suppkey AS k, {shown} FROM supplier, (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS v({', '.join(columns)})"


#: rule: code of the body of function f@@, and the edges it must give: (src, dst, edge type, event)
EDGE_RULES: dict[str, tuple[str, list[tuple[str, str, str, str | None]]]] = {
    "rule_call_filter": ("x(1); console(); JSON(); go@@(1); go@@(2);", [(f"f{KEY}", f"go{KEY}", "call", None)]),
    "rule_plain_call": ("one@@(1); if (ok) { two@@(); }", [(f"f{KEY}", f"one{KEY}", "call", None), (f"f{KEY}", f"two{KEY}", "call", None)]),
    "rule_property_callee": ("a.b.send@@(1); y?.ask@@();", [(f"f{KEY}", f"send{KEY}", "call", None), (f"f{KEY}", f"ask{KEY}", "call", None)]),
    "rule_callback_emit": ("callbacks.run('saved@@', x); this.callbacks.runAsync('later@@'); other.run('none');", [(f"f{KEY}", f"saved{KEY}", "event_emit", None), (f"f{KEY}", f"later{KEY}", "event_emit", None)]),
    "rule_callback_listen": ("callbacks.add('saved@@', onSaved@@); callbacks.add('kept', mod.onKept@@);", [(f"saved{KEY}", f"onSaved{KEY}", "event_listen", f"saved{KEY}"), ("kept", f"onKept{KEY}", "event_listen", "kept")]),
    "rule_generic_emit": ("bus.emit('made@@'); bus.emit(Events.Room.Made);", [(f"f{KEY}", f"made{KEY}", "event_emit", None), (f"f{KEY}", "Events.Room.Made", "event_emit", None)]),
    "rule_on_once": ("bus.on('made@@', handler@@); bus.once('done@@', () => work@@());", [(f"made{KEY}", f"handler{KEY}", "event_listen", f"made{KEY}"), (f"f{KEY}", f"done{KEY}", "event_listen", None), (f"f{KEY}", f"work{KEY}", "call", None)]),
    "rule_publish_subscribe": ("Meteor.publish('rooms@@', x); Meteor.subscribe('users@@');", [(f"f{KEY}", f"rooms{KEY}", "pubsub_publish", None), (f"f{KEY}", f"users{KEY}", "pubsub_subscribe", None)]),
    "rule_string_dispatch": ("sdk.call('save@@', 1);", [(f"f{KEY}", f"save{KEY}", "call", None), (f"f{KEY}", "call", "call", None)]),
    "rule_jsx_element": ("return <Panel@@><Item /><b>it's</b></Panel@@>;", [(f"f{KEY}", f"Panel{KEY}", "jsx", None), (f"f{KEY}", "Item", "jsx", None)]),
    "rule_jsx_prop": ("return <Panel onSend={sendIt@@} n={1} />;", [(f"f{KEY}", "Panel", "jsx", None), (f"f{KEY}", f"sendIt{KEY}", "jsx", None)]),
    "rule_new": ("new Store@@(1); new ns.Store2();", [(f"f{KEY}", f"Store{KEY}", "new", None)]),
    "rule_type_reference": ("const q = (v: Model@@, n: string) => v as Other@@;", [(f"f{KEY}", f"Model{KEY}", "type", None), (f"f{KEY}", f"Other{KEY}", "type", None)]),
}


def _register_edge_rule(name: str, code: str, rows: list[tuple]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        edges = D.edges_of(_symbols(spark, sf, f"export function f{KEY}() {{ {code} }}\n"))
        key = F.regexp_extract("file", r"(\d+)\.tsx$", 1).cast("bigint").alias("k")
        return edges.where("src <> 'q'").select(key, "src", "dst", "edge_type", "event")

    query(_sql(["src", "dst", "edge_type", "event"], rows), name)(run)


for _name, (_code, _rows) in EDGE_RULES.items():
    _register_edge_rule(_name, _code, _rows)

#: rule: a file's code, and the symbols it must give: (type, name, qualified name, exported)
_DECLARED = f"interface I{KEY} {{ a: X }}\nenum E{KEY} {{ A }}\ntype T{KEY} = X;\nconst v{KEY} = () => go();\nexport function f{KEY}() {{}}\nconst plain = 3;\nlone();\n"
_CLASS = f"export class C{KEY} {{ p = mk(); q = 1; get g() {{ return h(); }} m{KEY}() {{}} constructor() {{ go(); }} }}\n"
_HOOKS = f"const C{KEY} = () => {{ const onA = useCallback(() => {{ go(); }}, []); const handleB = 1; const o = {{ onC: async () => {{ await run2(); }} }}; const onD = () => 1; }};"


def _register_symbol_rule(name: str, code: str, wanted: tuple[str, ...], rows: list[tuple]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        key = F.regexp_extract("file", r"(\d+)\.tsx$", 1).cast("bigint").alias("k")
        return _symbols(spark, sf, code).where(F.col("type").isin(list(wanted))).select(key, "type", "name")

    query(_sql(["type", "name"], rows), name)(run)


_register_symbol_rule("rule_classes", _CLASS, ("class", "method", "class_property"), [("class", f"C{KEY}"), ("method", f"m{KEY}"), ("method", "constructor"), ("class_property", "p")])
_register_symbol_rule("rule_functions", _DECLARED, ("function", "variable_function"), [("function", f"f{KEY}"), ("variable_function", f"v{KEY}")])
_register_symbol_rule("rule_declared_types", _DECLARED, ("interface", "type", "enum"), [("interface", f"I{KEY}"), ("type", f"T{KEY}"), ("enum", f"E{KEY}")])


@query(_sql(["qualified_name", "callee"], [(f"C{KEY}.onA", "go"), (f"C{KEY}.onC", "run2")]))
def rule_inner_handlers(spark: SparkSession, sf: str) -> DataFrame:
    """Handlers inside components, behind the hooks that wrap them, with what they call."""
    inner = _symbols(spark, sf, _HOOKS).where("type = 'inner_function'")
    key = F.regexp_extract("file", r"(\d+)\.tsx$", 1).cast("bigint").alias("k")
    return inner.select(key, "qualified_name", F.explode("calls").alias("c")).select("k", "qualified_name", F.col("c.name").alias("callee"))


@query(_sql(["header", "shown", "hidden"], [(f"## File: server/s{KEY}.tsx", True, True)]))
def rule_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    """Skeletons keep signatures and hide bodies."""
    files = _files(spark, sf, f"export class A{KEY} {{ m(x: B): C {{ return secret{KEY}; }} }}\n")
    made = extract.skeletons_of(extract.scan_files(files))
    key = F.regexp_extract("path", r"(\d+)\.tsx$", 1).cast("bigint")
    name = F.concat(F.lit("A"), key.cast("string"))
    return made.select(key.alias("k"), F.get(F.split("skeleton", "\n"), F.lit(0)).alias("header"), (F.contains("skeleton", name) & F.contains("skeleton", F.lit("m(x: B): C"))).alias("shown"), (~F.contains("skeleton", F.lit("secret"))).alias("hidden"))


# the index

#: Function n of every supplier n calls n + 1 and n + 2; every third lies on the client, every tenth in a test file.
_PATH_SQL = "CASE WHEN s_suppkey % 3 = 0 THEN 'apps/client/fn' ELSE 'apps/server/fn' END || s_suppkey::VARCHAR || CASE WHEN s_suppkey % 10 = 0 THEN '.spec.ts' ELSE '.ts' END"
_CHAIN_SQL = f"f AS (SELECT s_suppkey AS n, 'fn' || s_suppkey::VARCHAR AS name, {_PATH_SQL} AS file FROM supplier), e AS (SELECT n, name AS src, file, 'fn' || (n + d)::VARCHAR AS dst, n + d AS m, d FROM f, (VALUES (1), (2)) AS v(d))"


def chain_index(spark: SparkSession, sf: str) -> Index:
    n = F.col("s_suppkey")
    path = F.concat(F.when(n % 3 == 0, "apps/client/fn").otherwise("apps/server/fn"), n.cast("string"), F.when(n % 10 == 0, ".spec.ts").otherwise(".ts"))
    call = lambda d: F.concat(F.lit("fn"), (n + d).cast("string"), F.lit("(); "))
    code = F.concat(F.lit("export function fn"), n.cast("string"), F.lit("() { "), call(1), call(2), F.lit("}\n"))
    files = cut(table(spark, sf, "supplier").select(path.alias("path"), code.alias("content"), n.cast("int").alias("file_ord")))
    scanned = cut(extract.scan_files(files))
    symbols = cut(extract.symbols_of(scanned, files))
    return Index(spark, {"symbols": symbols, "edges": cut(D.edges_of(symbols)), "imports": extract.imports_of(scanned, files), "files": files.select("path", "content"), "skeletons": extract.skeletons_of(scanned)})


@query(
    f"""WITH {_CHAIN_SQL}, x AS (SELECT 'exact' AS tier, 1 AS rank, name, file AS path FROM f WHERE name = 'fn7'), p AS (SELECT file AS path FROM f WHERE contains(file, 'fn7') AND file NOT IN (SELECT path FROM x) ORDER BY 1 LIMIT 15)
    SELECT tier, rank::INTEGER AS rank, name, path FROM x UNION ALL SELECT 'path', row_number() OVER (ORDER BY path)::INTEGER, NULL, path FROM p"""
)
def index_search_exact(spark: SparkSession, sf: str) -> DataFrame:
    return chain_index(spark, sf).search("fn7").select("tier", "rank", "name", "path")


@query(
    f"""WITH {_CHAIN_SQL}, q AS (SELECT file AS path FROM f ORDER BY 1 LIMIT 15)
    SELECT 'prefix' AS tier, rank::INTEGER AS rank, name, NULL AS path FROM (SELECT name, row_number() OVER (ORDER BY n) AS rank FROM f) WHERE rank <= 5 UNION ALL SELECT 'path', row_number() OVER (ORDER BY path)::INTEGER, NULL, path FROM q"""
)
def index_search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return chain_index(spark, sf).search("fN").select("tier", "rank", "name", "path")


@query(
    f"""WITH {_CHAIN_SQL} SELECT 'text' AS tier, file AS path, 1::BIGINT AS n, 'export function ' || name || '() {{ fn' || (n + 1)::VARCHAR || '(); fn' || (n + 2)::VARCHAR || '(); }}' AS example FROM f WHERE n IN (8, 9)"""
)
def index_search_text(spark: SparkSession, sf: str) -> DataFrame:
    """What is searched holds a bracket, so lines of files are matched too."""
    return chain_index(spark, sf).search("fn10();").where("tier = 'text'").select("tier", "path", "n", "example")


def _callers(index: Index, symbol: str, kind: str, **how) -> DataFrame:
    """The columns of kind of graph(symbol, "up"); no rows, as in SQL, where the tables are too small to hold the symbol."""
    try:
        found = index.graph(symbol, "up", **how)
    except LookupError:
        return index.spark.createDataFrame([], kind)
    return found.select(*(c.split()[0] for c in kind.split(", ")))


_SEEN_SQL = "r(m, hop) AS (SELECT {start}::BIGINT, 0 UNION SELECT {step}, r.hop + 1 FROM r JOIN e ON {on} WHERE r.hop < {depth}{more}), b AS (SELECT m, min(hop) AS hop FROM r GROUP BY 1)"


@query(
    f"WITH RECURSIVE {_CHAIN_SQL}, " + _SEEN_SQL.format(start=2, step="e.m", on="e.n = r.m", depth=3, more="")
    + " SELECT 'fn2' AS root, (b.hop + 1)::INTEGER AS hop, e.src, e.dst, 'call' AS edge_type, e.d::INTEGER AS rank, 0::BIGINT AS hidden FROM b JOIN e ON e.n = b.m"
)
def index_graph_down(spark: SparkSession, sf: str) -> DataFrame:
    return chain_index(spark, sf).graph("fn2", "down", 4)


@query(
    f"WITH RECURSIVE {_CHAIN_SQL}, s AS (SELECT e.*, row_number() OVER (PARTITION BY e.n ORDER BY e.d) AS rank FROM e LEFT JOIN f ON f.n = e.m WHERE f.file IS NULL OR contains(f.file, '/server/')),"
    " r(m, hop) AS (SELECT 2::BIGINT, 0 UNION SELECT s.m, r.hop + 1 FROM r JOIN s ON s.n = r.m WHERE r.hop < 3), b AS (SELECT m, min(hop) AS hop FROM r GROUP BY 1)"
    " SELECT (b.hop + 1)::INTEGER AS hop, s.src, s.dst, s.rank::INTEGER AS rank FROM b JOIN s ON s.n = b.m"
)
def index_graph_down_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Callees outside the layer are passed over, those without a file are not."""
    return chain_index(spark, sf).graph("fn2", "down", 4, layer="server").select("hop", "src", "dst", "rank")


@query(
    f"WITH RECURSIVE {_CHAIN_SQL}, k AS (SELECT * FROM e WHERE NOT contains(file, '.spec.ts')), r(m, hop) AS (SELECT 29::BIGINT, 0 UNION SELECT k.n, r.hop + 1 FROM r JOIN k ON k.m = r.m WHERE r.hop < 2), b AS (SELECT m, min(hop) AS hop FROM r GROUP BY 1),"
    " t AS (SELECT b.hop + 1 AS hop, b.m, k.name, k.file, k.n FROM b JOIN (SELECT k.*, k.src AS name FROM k) k ON k.m = b.m)"
    " SELECT t.hop::INTEGER AS hop, 'fn' || t.m::VARCHAR AS sym, t.file, row_number() OVER (PARTITION BY t.m ORDER BY t.n)::INTEGER AS rank, [t.name] AS callers, 0 AS hidden_callers, 0::BIGINT AS hidden_files FROM t"
)
def index_graph_up(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of callers, level by level, without test files."""
    return _callers(chain_index(spark, sf), "fn29", "hop int, sym string, file string, rank int, callers array<string>, hidden_callers int, hidden_files long", depth=3)


@query(
    f"WITH RECURSIVE {_CHAIN_SQL}, t AS (SELECT e.*, contains(file, '/server/') AS inside, max(contains(file, '/server/')) OVER (PARTITION BY m) AS held FROM e), k AS (SELECT * FROM t WHERE (inside OR NOT held) AND NOT contains(file, '.spec.ts')),"
    " r(m, hop) AS (SELECT 29::BIGINT, 0 UNION SELECT k.n, r.hop + 1 FROM r JOIN k ON k.m = r.m WHERE r.hop < 2), b AS (SELECT m, min(hop) AS hop FROM r GROUP BY 1)"
    " SELECT (b.hop + 1)::INTEGER AS hop, 'fn' || b.m::VARCHAR AS sym, k.file, row_number() OVER (PARTITION BY b.m ORDER BY k.n)::INTEGER AS rank, [k.src] AS callers FROM b JOIN k ON k.m = b.m"
)
def index_graph_up_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Callers of the layer, or all of a symbol that has none there."""
    return _callers(chain_index(spark, sf), "fn29", "hop int, sym string, file string, rank int, callers array<string>", depth=3, layer="server")


@query(
    f"WITH RECURSIVE {_CHAIN_SQL}, k AS (SELECT * FROM e WHERE contains(file, '/server/') AND NOT contains(file, '.spec.ts')), r(m, hop) AS (SELECT 29::BIGINT, 0 UNION SELECT k.n, r.hop + 1 FROM r JOIN k ON k.m = r.m WHERE r.hop < 4), b AS (SELECT m, min(hop) AS hop FROM r GROUP BY 1)"
    " SELECT b.hop::INTEGER AS hop, f.name AS symbol, f.file, 'call' AS edge_type FROM b JOIN f ON f.n = b.m WHERE b.hop > 0"
)
def index_impact(spark: SparkSession, sf: str) -> DataFrame:
    """Impact in a layer: callers elsewhere and test files are neither shown nor followed."""
    return _callers(chain_index(spark, sf), "fn29", "hop int, symbol string, file string, edge_type string", depth=4, layer="server", mode="impact")


@query(
    f"""WITH {_CHAIN_SQL} SELECT 'source' AS part, name, file, 'export function ' || name || '() {{ fn' || (n + 1)::VARCHAR || '(); fn' || (n + 2)::VARCHAR || '(); }}' AS text FROM f WHERE n = 4
    UNION ALL SELECT 'callee', name, file, '## File: ' || file FROM f WHERE n IN (5, 6)"""
)
def index_implement(spark: SparkSession, sf: str) -> DataFrame:
    """A symbol's source, and the head of its callees' skeletons."""
    rows = chain_index(spark, sf).implement("fn4", "fn4.ts")
    return rows.select("part", "name", "file", F.when(F.col("part") == "callee", F.get(F.split("text", "\n"), F.lit(0))).otherwise(F.trim("text")).alias("text"))


@query(f"WITH {_CHAIN_SQL} SELECT 'hint' AS part, name, file FROM f WHERE n = 4")
def index_implement_hint(spark: SparkSession, sf: str) -> DataFrame:
    """Asked for in a wrong file, the answer is where the symbol is."""
    return chain_index(spark, sf).implement("fn4", "elsewhere.ts").select("part", "name", "file")


@query("SELECT 's' || s_suppkey::VARCHAR AS file, (CASE WHEN s_suppkey % 4 = 1 THEN 0 ELSE 1 END)::INTEGER AS rank FROM supplier WHERE s_suppkey < 40")
def ranked_homes(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one name, those that the asking file imports first."""
    s = table(spark, sf, "supplier").where("s_suppkey < 40")
    file = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    symbols = s.select(F.lit("run").alias("name"), file.alias("file"), F.col("s_suppkey").cast("int").alias("file_ord"))
    imports = s.where("s_suppkey % 4 = 1").select(F.lit("server/asker.ts").alias("importer"), F.lit("m").alias("module"), file.alias("resolved"))
    return lookup.ranked_files(symbols, imports, "run", "asker.ts").select("file", "rank")


@query("SELECT p_name AS name, max(score) AS final FROM (SELECT DISTINCT p_name, round(p_size / 100.0, 6)::DOUBLE AS score FROM part WHERE p_size >= 30) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def search_confident(spark: SparkSession, sf: str) -> DataFrame:
    """The best five of at least 0.3."""
    scored = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.round(F.max("p_size") / 100.0, 6).alias("final"))
    return S.confident(scored).select("name", "final")



# recorded sessions

_LOGGED_SQL = """w AS (SELECT conv_id, turn, role, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations),
    c AS (SELECT conv_id, t, turn, row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) AS call, CASE turn % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'implement' ELSE 'search' END AS tool, CASE WHEN turn % 4 = 1 THEN '✗' ELSE '✓' END AS status FROM w WHERE role = 'assistant' AND t > 0)"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A terminal's recording of each conversation: what the user asks, and a tool's box and an answer for the assistant."""
    turn = F.col("turn").cast("string")
    tool = F.when(F.col("turn") % 3 == 0, "graph").when(F.col("turn") % 3 == 1, "implement").otherwise("search")
    mark = F.when(F.col("turn") % 4 == 1, "✗").otherwise("✓")
    box = F.concat(F.lit("\x1b[32m╭──────╮\x1b[0m\r\n│ "), mark, F.lit(" "), tool, F.lit(' {"symbol":"s'), turn, F.lit('"} │\r\n│ found '), turn, F.lit(" │\n╰──────╯\n✦ answer "), turn, F.lit("\n"))
    said = F.when(F.col("role") == "user", F.concat(F.lit("> \x1b[1mask "), turn, F.lit("\x1b[0m\r\n"))).when(F.col("role") == "assistant", box).otherwise("a note\n")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", said.alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "said")))
    return rows.groupBy(F.col("conv_id").alias("session_id")).agg(F.array_join(F.transform(ordered, lambda r: r["said"]), "").alias("text"))


@query(f"WITH {_LOGGED_SQL} SELECT conv_id AS session_id, t::INTEGER AS turn, call::INTEGER AS call, tool, status, 's' || turn::VARCHAR AS symbol, ['found ' || turn::VARCHAR] AS result_lines FROM c")
def session_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls of cleaned recordings, with their arguments and results."""
    calls = E.parse_sessions(E.log_lines(_sessions(spark, sf)))[1]
    return calls.select("session_id", "turn", "call", "tool", "status", F.col("args")["symbol"].alias("symbol"), F.filter("result_lines", lambda x: x != "").alias("result_lines"))


@query(
    f"""WITH {_LOGGED_SQL} SELECT conv_id AS session_id, t::INTEGER AS turn, 'ask ' || min(CASE WHEN role = 'user' THEN turn END)::VARCHAR AS query,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'answer ' || turn::VARCHAR END, chr(10) ORDER BY turn), '') AS answer FROM w WHERE t > 0 GROUP BY 1, 2"""
)
def session_answers(spark: SparkSession, sf: str) -> DataFrame:
    return E.parse_sessions(E.log_lines(_sessions(spark, sf)))[0].select("session_id", "turn", "query", "answer")


@query(f"WITH {_LOGGED_SQL} SELECT conv_id AS session_id, count(*) AS calls, round(avg((tool = 'implement')::INTEGER), 6) AS share FROM c WHERE status = '✓' GROUP BY 1")
def session_tool_share(spark: SparkSession, sf: str) -> DataFrame:
    """Of successful calls alone."""
    calls = E.parse_sessions(E.log_lines(_sessions(spark, sf)))[1]
    return E.call_share(calls, "implement").select("session_id", "calls", F.round("share", 6).alias("share"))
