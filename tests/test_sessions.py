from graphloom.operators import evaluate as E
from graphloom.sources import files as S
from graphloom.streaming import refresh as R

LOG = """\x1b[2Jnoise
 > Where is it?\r
╭──
│ ✓  search (graph) {"query":"send"} │
│ src/a.ts found
╰──
╭──
│ ✗  graph (graph) {"query":"x"} │
╰──
✦ It is in a.ts
✦ and more
 > Next one
╭──
│ ✓  implement (graph) {"symbolName":"f","filename":"b.ts"} │
│ body of c.tsx
╰──
╭──
│ spinner
╰──
✦ done"""


def lines(spark):
    return E.log_lines(spark.createDataFrame([("s", LOG)], "session_id string, text string"))


def test_sessions_parse(spark):
    turns, calls = E.parse_sessions(lines(spark))
    assert [(r["turn"], r["query"], r["answer"]) for r in turns.orderBy("turn").collect()] == [(1, "Where is it?", "It is in a.ts\nand more"), (2, "Next one", "done")]
    got = [(r["turn"], r["call"], r["tool"], r["status"], r["args"]) for r in calls.orderBy("turn", "call").collect()]
    assert got == [(1, 1, "search", "✓", {"query": "send"}), (1, 2, "graph", "✗", {"query": "x"}), (2, 1, "implement", "✓", {"symbolName": "f", "filename": "b.ts"})]
    share = E.call_share(calls, "implement").first()
    assert (share["calls"], share["share"], share["too_many"], share["over"], share["under"]) == (2, 0.5, False, True, False)


def test_redrawn_boxes_keep_first_place_and_last_content(spark):
    text = " > q\n╭─\n│ ✓  search (g) {} │\n│ old\n╰─\n✦ a\n╭─\n│ ✓  search (g) {} │\n│ new\n╰─\n╭─\n│ spinner\n╰─"
    rows = E.conversation(E.log_lines(spark.createDataFrame([("s", text)], "session_id string, text string"))).orderBy("first").collect()
    assert [(r["kind"], r["first"]) for r in rows] == [("user", 0), ("box", 1), ("ai", 5)]
    assert "new" in rows[1]["content"] and "old" not in rows[1]["content"]


def test_scores(spark):
    truth = spark.createDataFrame([("c", 0, "x/a.ts"), ("c", 1, "x/b.ts"), ("c", 2, "x/z.ts")], "k string, ord int, file string")
    seen = spark.createDataFrame([("c", 0, "b.ts"), ("c", 1, "my-a.ts"), ("c", 2, "b.ts")], "k string, pos int, name string")
    positions = E.retrieval_positions(truth, seen, "k")
    assert {(r["file"], r["position"]) for r in positions.collect()} == {("x/a.ts", 2), ("x/b.ts", 1), ("x/z.ts", None)}
    assert [(r["expected"], r["actual"]) for r in E.order_alignment(positions, "k").orderBy("rank").collect()] == [("x/a.ts", "x/b.ts"), ("x/b.ts", "x/a.ts"), ("x/z.ts", "x/z.ts")]
    terms = spark.createDataFrame([("c", "foo"), ("c", "bar"), ("d", "x")], "k string, term string")
    answers = spark.createDataFrame([("c", "a foo")], "k string, answer string")
    coverage = E.term_coverage(answers, terms, "k")
    assert {(r["k"], r["found"], r["total"], r["flagged"]) for r in coverage.collect()} == {("c", 1, 2, True), ("d", 0, 1, True)}
    one = lambda column, value: spark.createDataFrame([("c", value)], f"k string, {column} string")
    hits = E.file_hits(truth.select("k", "file"), one("file", "a.ts"), one("path", "lib/b.ts"), one("answer", "see a.ts, b.ts"), "k")
    assert {(r["file"], r["source"]) for r in hits.collect()} == {("x/a.ts", "implement"), ("x/b.ts", "graph"), ("x/z.ts", None)}
    total = E.report_totals(coverage, hits).first()
    assert (total["symbols_found"], total["symbols"], total["files_found"], total["files"], total["all_files"]) == (1, 3, 2, 3, False)


def test_cases_boxes_paths(spark):
    turns = spark.createDataFrame([(1, "Q?"), (2, "other")], "turn int, query string")
    cases = spark.createDataFrame([("b", "Q?"), ("a", "Q?")], "id string, question string")
    assert [(r["turn"], r["id"]) for r in E.match_cases(turns, cases).collect()] == [(1, "a")]
    found = E.paths_in(spark.createDataFrame([("see src/a.ts and lib/b.tsx, not c.js",)], "line string"))
    assert [r["path"] for r in found.collect()] == ["src/a.ts", "lib/b.tsx"]
    box = E.summary_box(lines(spark), "body of").orderBy("pos").collect()
    assert len(box) == 4 and box[0]["line"].startswith("╭")
    runs = spark.createDataFrame([("s", 1), ("s", 2), ("e", 1)], "kind string, ts int")
    assert {(r["kind"], r["ts"]) for r in E.newest_only(runs, "kind", "ts").collect()} == {("s", 2), ("e", 1)}


def test_tree_round_trip(spark, tmp_path):
    for name, text in {"a.ts": "export function f() { g(); }", "b/c.tsx": "const g = () => 1;", "b/c.d.ts": "", "b/x.test.ts": "", "node_modules/m.ts": "", "n.js": ""}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    files = S.scan_directory(spark, str(tmp_path / "src"))
    assert [(r["path"], r["file_ord"]) for r in files.orderBy("file_ord").collect()] == [("a.ts", 0), ("b/c.tsx", 1)]
    folder = str(tmp_path / "index")
    assert S.load_index(spark, folder) is None
    none = spark.createDataFrame([], "name string, file string, vec array<double>")
    S.save_index({"symbols": files.select("path"), "files": files, "vectors": none}, folder)
    assert set(S.load_index(spark, folder)) == {"symbols", "files"}
    S.clear_index(spark, folder)
    assert S.load_index(spark, folder) is None


def test_mapping_scan_skips_broken_files(spark, tmp_path):
    (tmp_path / "a.mapping.json").write_text('{"sourcePath":"a.ts","symbols":[{"type":"function","name":"f","exported":true,"line":3,"calls":["go",{"name":"X","edgeType":"jsx"}]},{"type":"enum","name":"E","line":1}],"imports":[{"module":"./b","resolved":"b.ts"}]}')
    (tmp_path / "b.mapping.json").write_text("{broken")
    rows = S.scan_mappings(spark, str(tmp_path)).orderBy("sym_ord").collect()
    assert [(r["name"], [(c["name"], c["edge_type"]) for c in r["calls"]]) for r in rows] == [("f", [("go", "call"), ("X", "jsx")]), ("E", [])]
    assert [r["resolved"] for r in S.scan_mapping_imports(spark, str(tmp_path)).collect()] == ["b.ts"]


def test_refresh_replaces_and_removes(spark, tmp_path):
    folder = str(tmp_path / "index")
    frame = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    assert R.refresh(frame(("a.ts", "function f() { g(); }"), ("b.ts", "function g() {}")), folder) == 1
    assert R.refresh(frame(("a.ts", "function f() { g(); }")), folder) == 1
    gone = spark.createDataFrame([("b.ts",)], "path string")
    assert R.refresh(frame(("a.ts", "function f2() { go(); }")), folder, gone) == 2
    tables = R.ordered(R.read_snapshot(spark, folder))
    assert [r["name"] for r in tables["symbols"].collect()] == ["f2"]
    assert [(r["src"], r["dst"]) for r in tables["edges"].collect()] == [("f2", "go")]


def test_a_batch_writes_its_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "index")
    files = [(f"d/f{k}.ts", f"export function f{k}() {{ go{k}(); }}") for k in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    assert R.refresh(frame(files), folder) == 1
    assert R.refresh(frame([("d/f3.ts", "export function g3() { stay(); }")]), folder) == 2
    manifest = R._manifest(spark, folder, 2)
    assert sum(v == 2 for v in manifest["places"]["symbols"].values()) == 1
    present = spark.createDataFrame([(p,) for p, _ in files if p != "d/f5.ts"], "path string")
    assert R.refresh(frame([]), folder, R.vanished(spark, folder, present)) == 3
    now = R.read_snapshot(spark, folder)
    want = {f"f{k}" for k in range(40)} - {"f3", "f5"} | {"g3"}
    assert {r["name"] for r in now["symbols"].collect()} == want and now["files"].count() == 39
    assert {r["name"] for r in R.read_snapshot(spark, folder, 1)["symbols"].collect()} == {f"f{k}" for k in range(40)}
    assert R.refresh(frame([("d/f3.ts", "export function h3() { stay(); }")]), folder) == 4
    # the bucket that version 2 wrote is version 4's now
    assert R.vacuum(spark, folder, 1) == [2] and R.read_snapshot(spark, folder)["files"].count() == 39


def test_streamed_batches_take_deletions_along(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")
    rows = [("a.ts", "function a() { b(); }"), ("b.ts", "function b() {}")]
    for batch, listed in ((rows, ["a.ts", "b.ts"]), ([("c.ts", "function c() {}")], ["a.ts", "c.ts"])):
        spark.createDataFrame(batch, "path string, content string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("path string, content string").parquet(source)
        R.watch(stream, folder, str(tmp_path / "state"), present=lambda listed=listed: spark.createDataFrame([(x,) for x in listed], "path string")).awaitTermination()
    assert {r["name"] for r in R.read_snapshot(spark, folder)["symbols"].collect()} == {"a", "c"}


def test_embedding_waits_saves_and_goes_on_without(spark, tmp_path):
    from graphloom.operators import vectors as V

    class Busy(Exception):
        retry_after = 0.01

    assert V.suggested_wait(Busy()) == 0.01 and V.suggested_wait(ValueError("please retry in 2.5s")) == 2.5 and V.suggested_wait(ValueError("no")) is None
    contexts = spark.createDataFrame([(f"n{k}", "f", "m", f"text {k}") for k in range(30)], "name string, file string, md5 string, context string")
    path = str(tmp_path / "cache")
    done = V.embed_into(contexts.where("name < 'n2'"), path, "1", lambda texts: [[1.0, 2.0, 3.0] for _ in texts], every=1, dims=2, pause=0.0)
    first = done.count()
    assert 0 < first < 30 and all(r["vec"] == [1.0, 2.0] for r in done.collect())
    again = V.embed_into(contexts, path, "1", lambda texts: [[5.0, 6.0] for _ in texts], pause=0.0)
    assert again.count() == 30 and again.where("vec[0] = 1.0").count() == first and V.read_cache(spark, path, "2").count() == 0

    def broken(texts):
        raise ValueError("down")

    assert V.embed_query(spark, broken, "x") is None and V.embed_query(spark, lambda t: [[1.0, 2.0]], "x", dims=1).first()["query_vec"] == [1.0]
