import pytest

from graphloom.functions.tsscan import import_candidates, scan_source
from graphloom.operators import extract, index_build


def edges(code, name="f"):
    """Edges of a function's body."""
    found = scan_source(f"function {name}() {{ {code} }}", "a.tsx")
    return {(c.name, c.edge_type, c.event) for s in found.symbols if s.name == name for c in s.calls}


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("go(1);", {("go", "call", None)}),
        ("x(1); console(); JSON();", set()),
        ("a.b.send(1); y?.ask();", {("send", "call", None), ("ask", "call", None)}),
        ("callbacks.run('saved', x);", {("saved", "event_emit", None)}),
        ("this.callbacks.runAsync('saved');", {("saved", "event_emit", None)}),
        ("other.run('saved');", set()),
        ("callbacks.add('saved', onSaved);", {("onSaved", "event_listen", "saved")}),
        ("callbacks.add('saved', mod.onSaved);", {("onSaved", "event_listen", "saved")}),
        ("callbacks.add('saved', () => 1);", set()),
        ("bus.emit('made'); bus.emit(Events.Room.Made);", {("made", "event_emit", None), ("Events.Room.Made", "event_emit", None)}),
        ("bus.on('made', handler);", {("handler", "event_listen", "made")}),
        ("bus.once('made', () => work());", {("made", "event_listen", None), ("work", "call", None)}),
        ("Meteor.publish('rooms', x); Meteor.subscribe('users');", {("rooms", "pubsub_publish", None), ("users", "pubsub_subscribe", None)}),
        ("sdk.call('save', 1);", {("save", "call", None), ("call", "call", None)}),
        ("return <Panel><Item /><b>it's</b></Panel>;", {("Panel", "jsx", None), ("Item", "jsx", None)}),
        ("return <Panel onSend={sendIt} n={1} />;", {("Panel", "jsx", None), ("sendIt", "jsx", None)}),
        ("new Store(1); new ns.Store2();", {("Store", "new", None)}),
        ("const q = (v: Model, n: string) => v as Other;", {("Model", "type", None), ("Other", "type", None)}),
        ("const m: Map<string, Room> = make();", {("Room", "type", None), ("make", "call", None)}),
        ("const o = { a: Upper }; const t = c ? One : Two;", set()),
        ("if (ok) { go(); } for (const i of list()) { }", {("go", "call", None), ("list", "call", None)}),
        ("const s = `a ${mk(1)} b`; const r = /x\\(y/.test(s);", {("mk", "call", None), ("test", "call", None)}),
        ("// no(1)\n/* no(2) */ yes(3); 'no(4)';", {("yes", "call", None)}),
    ],
)
def test_edge_rules(code, want):
    assert edges(code) == want


def test_symbols_in_order():
    found = scan_source(
        "interface I { a: X }\nenum E { A }\ntype T = X;\nconst v = () => go();\nexport function f() {}\nexport class C { p = mk(); q = 1; get g() { return h(); } m() {} constructor() { go(); } }\nconst plain = 3;\nlone();\n", "a.ts"
    )
    assert [(s.type, s.name) for s in found.symbols] == [
        ("class", "C"), ("method", "m"), ("method", "constructor"), ("class_property", "p"), ("function", "f"), ("variable_function", "v"), ("interface", "I"), ("type", "T"), ("enum", "E"),
    ]
    assert {s.name: s.exported for s in found.symbols if s.exported is not None} == {"C": True, "m": True, "constructor": True, "p": True, "f": True, "v": False}
    assert [s.line for s in found.symbols if s.name in "vI"] == [4, 1]


def test_inner_handlers_unwrap_hooks():
    found = scan_source("const C = () => { const onA = useCallback(() => { go(); }, []); const handleB = 1; const o = { onC: async () => { await run2(); } }; const onD = () => 1; };", "a.tsx")
    assert [(s.qualified_name, [c.name for c in s.calls]) for s in found.symbols if s.type == "inner_function"] == [("C.onA", ["go"]), ("C.onC", ["run2"])]


def test_skeleton_hides_bodies_only():
    text = scan_source("export class A { m(x: B): C { return x; } }\nfunction f() { go(); }\nconst g = (a) => a + 1;\n", "dir/a.ts").skeleton
    assert text.startswith("## File: dir/a.ts\n\n```typescript\n") and text.endswith("\n```")
    assert "return x" not in text and "go()" not in text and "(a) => a + 1" in text and text.count("Implementation Hidden") == 2


@pytest.mark.parametrize("code", ["", "function", "class {", "<", "const a = `${", "foo(", "export default class extends X<", "a < b > (c)", "}}}))", "\x00é世界"])
def test_broken_sources_do_not_fail(code):
    scan_source(code, "a.tsx")


def test_import_resolution(spark):
    assert import_candidates("a/b.ts", "react") == []
    assert import_candidates("a/b.ts", "../c/d.js")[4:] == ["c/d.ts", "c/d.tsx"]
    files = spark.createDataFrame([("a/x.ts", "import './y'; import '../b'; import './z.js'; import './none'; import 'lib';"), ("a/y.tsx", ""), ("b/index.ts", ""), ("a/z.ts", "")], "path string, content string")
    got = {r["module"]: r["resolved"] for r in extract.imports_of(extract.scan_files(files), files).collect()}
    assert got == {"./y": "a/y.tsx", "../b": "b/index.ts", "./z.js": "a/z.ts", "./none": "a/none.ts", "lib": "external"}


def test_events_become_virtual_nodes(spark):
    files = spark.createDataFrame([("a.ts", "function boot() { bus.on('made', onMade); bus.emit('made'); }", 0)], "path string, content string, file_ord int")
    got = {(r["src"], r["dst"], r["edge_type"]) for r in index_build.edges_of(extract.symbols_of(extract.scan_files(files), files)).collect()}
    assert got == {("made", "onMade", "event_listen"), ("boot", "made", "event_emit")}


def test_old_calls_are_coerced(spark):
    raw = spark.createDataFrame([(["go", '{"name":"a","edgeType":"jsx"}', '{"name":"b"}'],), (None,)], "calls array<string>")
    got = [[(c["name"], c["edge_type"]) for c in r["calls"]] for r in index_build.coerce_calls(raw).collect()]
    assert got == [[("go", "call"), ("a", "jsx"), ("b", "call")], []]
