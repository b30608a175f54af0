import pytest

from graphloom.functions import text as X
from graphloom.operators import hashing as H
from graphloom.operators import lookup as L
from graphloom.operators import search as S
from graphloom.operators import telemetry as T
from graphloom.operators import vectors as V
from graphloom.plans import render
from pyspark.sql import functions as F

SYMBOL = "name string, file string, file_ord int, sym_ord int"


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("sendMessage", "client/a.ts", 0, 0), ("sendMessage", "server/b.ts", 1, 0), ("sendMail", "server/b.ts", 1, 1), ("SendFile", "ee/c.ts", 2, 0), ("applyAll", "packages/d.ts", 3, 0), ("only", "server/e.ts", 4, 0)]
    symbols = spark.createDataFrame(rows, SYMBOL)
    files = spark.createDataFrame([("client/a.ts", "x = 'token'\n  foo(bar)\nfoo(bar)"), ("server/b.ts", "foo"), ("ee/c.ts", ""), ("packages/d.ts", ""), ("server/e.ts", None)], "path string, content string")
    return symbols, files


def tiers(df):
    return [(r["tier"], r["name"], r["path"]) for r in sorted(df.collect(), key=lambda r: (r["tier"], r["rank"]))]


def test_exact_shuts_out_others(spark, tree):
    got = tiers(S.search(spark, *tree, "sendMessage"))
    assert got == [("exact", "sendMessage", "client/a.ts"), ("exact", "sendMessage", "server/b.ts")]
    assert tiers(S.search(spark, *tree, "sendMessage", layer="server")) == [("exact", "sendMessage", "server/b.ts")]
    assert len(tiers(S.search(spark, *tree, "sendMessage", layer="packages"))) == 2


def test_prefix_one_many_none(spark, tree):
    assert tiers(S.search(spark, *tree, "ONL")) == [("prefix", "only", "server/e.ts")]
    assert tiers(S.search(spark, *tree, "send")) == [("prefix", "sendMessage", None), ("prefix", "sendMail", None), ("prefix", "SendFile", None)]
    assert tiers(S.search(spark, *tree, "zzz")) == []
    assert render.render_search(S.search(spark, *tree, "zzz")) == "no results"
    with pytest.raises(ValueError):
        S.search(spark, *tree, "")


def test_fuzzy_bonus_and_cut(spark, tree):
    names = tree[0].groupBy("name").agg(F.collect_set("file").alias("paths"))
    plain = {r["name"]: r["score"] for r in S.fuzzy_scores(names, "sndmail").collect()}
    assert set(plain) == {"sendMail"} and abs(plain["sendMail"] - 7 / 8) < 1e-9
    boosted = S.fuzzy_scores(names, "sndmail", "server").first()["score"]
    # the layer must stand between slashes, as in an absolute path
    assert boosted == plain["sendMail"]
    assert [t for t, *_ in tiers(S.search(spark, *tree, "sndmail"))] == ["fuzzy"]


def test_unblended_without_vector(spark):
    scored = spark.createDataFrame([("a", ["p"], 0.5, 0.5), ("b", ["p"], 0.5, 0.5)], "name string, paths array<string>, base double, score double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0])], "name string, vec array<double>")
    query = spark.createDataFrame([([1.0, 0.0],)], "query_vec array<double>")
    got = {r["name"]: r["final"] for r in S.rerank(scored, vectors, query).collect()}
    assert abs(got["a"] - (0.2 + 0.6)) < 1e-9 and got["b"] == 0.5


def test_text_and_path_tiers(spark, tree):
    got = [(r["tier"], r["path"], r["n"], r["example"]) for r in S.search(spark, *tree, "foo(bar").collect()]
    assert got == [("text", "client/a.ts", 2, "foo(bar)")]
    assert {p for t, _, p in tiers(S.search(spark, *tree, "server/")) if t == "path"} == {"server/b.ts", "server/e.ts"}
    rules = spark.createDataFrame([(1, "token", "late"), (0, "Tok", "first")], "rule_ord int, keyword string, hint string")
    assert tiers(S.search(spark, *tree, "tokens", rules=rules))[0][0] == "hint"


def test_layers_and_test_files(spark):
    paths = spark.createDataFrame([("packages/a.ts",), ("x/ee/b.test.tsx",), ("freedom/ee.ts",), ("a/E2E/b.ts",)], "p string")
    got = paths.select("p", X.in_layer(F.col("p"), "packages").alias("a"), X.in_layer(F.col("p"), "ee").alias("b"), X.in_layer(F.col("p"), None).alias("c"), X.is_test_file(F.col("p")).alias("t")).collect()
    assert [(r["a"], r["b"], r["c"], r["t"]) for r in got] == [(True, False, True, False), (False, True, True, True), (False, False, True, False), (False, False, True, True)]


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r["s"] for r in rows.select(X.cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1] == 0 and got[2] is None and got[3] is None


def test_embedding_batches_retry(spark, tmp_path):
    contexts = spark.createDataFrame([(f"s{k}", "f", "m", f"text {k}") for k in range(7)], "name string, file string, md5 string, context string").coalesce(1)
    mark = str(tmp_path / "failed")

    def provider(texts):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        assert len(texts) <= 3
        return [[float(len(t)), 1.0, 2.0] for t in texts]

    done = V.embed(contexts, provider, batch=3, dims=2).collect()
    assert len(done) == 7 and {len(r["vec"]) for r in done} == {2}


def test_context_text(spark):
    files = spark.createDataFrame([("f.ts", "\n".join(f"line{k}" for k in range(1, 30)), "m")], "path string, content string, md5 string")
    symbols = spark.createDataFrame([("s", "f.ts", 3)], "name string, file string, line int")
    text = V.context_text(symbols, files).first()["context"]
    assert "line3" in text and "line10" in text and "line11" not in text and "line2\n" not in text


def test_hash_snapshots(spark):
    old = spark.createDataFrame([("same", "1"), ("changed", "2"), ("gone", "3")], "path string, md5 string")
    now = spark.createDataFrame([("same", "1"), ("changed", "9"), ("new", "4")], "path string, md5 string")
    assert {(r["path"], r["status"]) for r in H.classify(now, old).collect()} == {("same", "same"), ("changed", "changed"), ("gone", "gone"), ("new", "new")}
    assert {r["path"] for r in H.to_update(now, old).collect()} == {"changed", "new"}
    assert {(r["path"], r["md5"]) for r in H.upsert(old, now.where("path = 'new'")).collect()} == {("same", "1"), ("changed", "2"), ("gone", "3"), ("new", "4")}
    assert H.to_update(now, now).isEmpty() and [r["path"] for r in H.prune(old, now)[1].collect()] == ["gone"]
    versioned = old.withColumn("generator_version", F.lit("1"))
    assert H.valid_snapshot(versioned, "2").isEmpty() and H.needs_rebuild(now.limit(0), now.limit(0), False) and not H.needs_rebuild(now.limit(0), now.limit(0), True)


def test_lookup(spark):
    bodies = spark.createDataFrame([("f", "a/One.ts", "class", "C", 0), ("f", "a/One.ts", "function", "F", 1), ("f", "b.ts", "method", "M", 0)], "name string, file string, type string, body string, sym_ord int")
    assert L.source_of(bodies, "f", "one.tsx").first()["body"] == "F"
    assert L.source_of(bodies, "f", "b.ts").isEmpty()
    edges = spark.createDataFrame([("f", f"g{k}", k) for k in range(8)], "src string, dst string, ord bigint")
    symbols = spark.createDataFrame([(f"g{k}", f"h{k // 2}.ts", k, 0) for k in range(8)] + [("f", "a/One.ts", 0, 0)], SYMBOL)
    skeletons = spark.createDataFrame([(f"h{k}.ts", f"S{k}") for k in range(4)], "path string, skeleton string")
    rows = L.implement(bodies, edges, symbols, skeletons, "f", "one.ts").collect()
    assert [(r["part"], r["text"]) for r in rows] == [("source", "F"), ("callee", "S0"), ("callee", "S1"), ("callee", "S2"), ("callee", "S3")]
    assert [(r["part"], r["file"]) for r in L.implement(bodies, edges, symbols, skeletons, "f", "other.ts").collect()] == [("hint", "a/One.ts")]
    with pytest.raises(ValueError):
        L.implement(bodies, edges, symbols, skeletons, "", "x")


def test_telemetry(spark):
    calls = spark.createDataFrame([("implement", "a", "12345", 0), ("implement", "a", "1", 10), ("graph", None, "", 4)], "tool string, symbol string, text string, t int").withColumn("ts", F.timestamp_seconds("t"))
    log = T.log_calls(calls)
    assert T.totals(log).first()[:] == (3, 3, 10.0)
    assert T.repeat_rate(log).first()[:] == (1, 1, 1.0) and T.repeat_rate(log.limit(0)).first()["rate"] == 0.0
    assert T.hot_symbols(log).first()["hits"] == 2


def test_output_paths_and_ranked_files(spark):
    from graphloom.sources.files import output_path

    paths = spark.createDataFrame([("a/b.ts",), ("a/c.tsx",)], "p string").select(output_path(F.col("p"), "mapping.json").alias("o"))
    assert [r["o"] for r in paths.collect()] == ["a/b.mapping.json", "a/c.mapping.json"]
    symbols = spark.createDataFrame([("f", "one.ts", 0, 0), ("f", "two.ts", 1, 0), ("g", "one.ts", 0, 1)], SYMBOL)
    imports = spark.createDataFrame([("app/Main.tsx", "./two", "two.ts")], "importer string, module string, resolved string")
    assert [r["file"] for r in L.ranked_files(symbols, imports, "f", "main.ts").collect()] == ["two.ts", "one.ts"]
    assert [r["file"] for r in L.ranked_files(symbols, imports, "f", None).collect()] == ["one.ts", "two.ts"]


def test_impact_text(spark):
    from graphloom.operators.graph import impact_summary

    states = spark.createDataFrame([(1, f"s{k:02}", "f", "call") for k in range(17)] + [(3, "z", "f", "jsx")], "hop int, symbol string, file string, edge_type string")
    text = render.render_impact(impact_summary(states)).splitlines()
    assert text[0].startswith("direct call (17): s00, s01") and text[0].endswith("s14 … 2 more") and text[1] == "3-hop jsx (1): z"
