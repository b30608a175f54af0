"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontamination, language_id, line_dedup, ngram_join, quality, secret_scan, sharding, substring_dedup, toxicity

LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps\nover the lazy dog today"), (1, "the quick brown fox jumps\nover the lazy dog today"), (2, None), (None, "a text without an id\nof two lines"), (None, None), (3, ""), (4, " \n\t\n"), (5, LONG), (6, LONG),
    (7, "x" * 100_000), (8, "é世界 ß 😀\n\nà"), (9, "one"), (10, "one"), (11, "\x00\x01 odd\r\nbytes\r\n"), (12, "the quick brown fox jumps\nover the lazy dog today"),
]
#: Names that operators use inside, and names of columns they add.
CLASH = ["id", "rep", "bands", "hash", "band", "low", "high", "size", "begin", "part", "rank", "label", "line", "lines", "grams", "spans", "tokens", "toxic", "severity", "item_id", "first_id", "__extra", "__lines", "__dropped", "__id", "__loser", "__leak", "dropped", "lines_", "body", "place", "keep", "task"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") < 9, "bb"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 3 != 0 and 1 or 0, k % 4 == 0 and 1 or 0) for k in range(1, 13)] + [(None, 1, 0), (3, None, None), (1, 0, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({"id": F.lit(1), "text": F.lit("t"), "label": F.lit(0)})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "x y"), (4, "quick brown fox jumps over the lazy dog")], "item_id long, text string").withColumn("id", F.lit(5))


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def operators(docs, labels, benchmark):
    return {
        "op1": lambda: ngram_join.ngram_jaccard_join(docs),
        "op2": lambda: language_id.language_id(docs),
        "op3": lambda: quality.quality_rules(docs, labels),
        "op4": lambda: substring_dedup.substring_dedup(docs),
        "op5": lambda: line_dedup.line_dedup(docs),
        "op6": lambda: secret_scan.secret_scan(docs, labels),
        "op7": lambda: sharding.minimax_shards(docs, shards=4),
        "op8": lambda: bpe.bpe_encode(docs),
        "op9": lambda: decontamination.find_leaks(docs, benchmark),
        "op10": lambda: toxicity.toxicity(docs, labels),
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_empty_tables(spark, docs, labels, benchmark, name):
    assert operators(docs.limit(0), labels.limit(0), benchmark.limit(0))[name]().count() == 0


def test_join_of_odd_rows(docs):
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == {(1, 12): 1.0, (5, 6): 1.0, (9, 10): 1.0}


def test_languages_of_odd_rows(docs):
    rows = language_id.language_id(docs).collect()
    assert ids(docs) == sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for k in (2, 3, 4):
        assert by[k]["language"] is None and by[k]["ambiguous"]
    assert by[5]["language"] in ("aa", "bb")
    none = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["language"] for r in none} == {None} and all(r["ambiguous"] for r in none)
    one = language_id.language_id(docs.withColumn("lang", F.lit("aa"))).where("doc_id = 1").first()
    assert one["language"] == "aa"


def test_quality_of_odd_rows(docs, labels):
    rows = quality.quality_rules(docs, labels).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["anomaly"] is None and not by[2]["keep"] and by[3]["anomaly"] is not None
    assert all(r["keep"] for r in quality.quality_rules(docs, labels.limit(0)).where("anomaly is not null").collect())


def test_chunks_of_odd_rows(docs):
    rows = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert set(rows) == {6} and rows[6]["text"] == "" and rows[6]["first_doc_ids"] == [5] and rows[6]["removed_bytes"] == len(LONG)


def test_lines_of_odd_rows(docs):
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[4]["text"] == " \n\t\n" and by[6]["text"] == "" and by[6]["dropped"] == 1
    assert [r["dropped"] for r in rows if r["doc_id"] == 1] == [0, 0] and by[12]["dropped"] == 2 and by[10]["text"] == ""
    assert {(r["text"], r["dropped"]) for r in rows if r["doc_id"] is None} == {("a text without an id\nof two lines", 0), (None, 0)}


def test_secrets_of_odd_rows(spark, docs, labels):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    more = spark.createDataFrame([(50, f'é token = "{token}" and {token}'), (50, f"{token}")], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["length"], r["masked"]) for r in secret_scan.secret_scan(docs.select("doc_id", "text").unionByName(more), labels).where("doc_id = 50").orderBy("start").collect()]
    assert got == [(50, 0, 40, token[:4] + "*" * 36), (50, 11, 40, token[:4] + "*" * 36), (50, 57, 40, token[:4] + "*" * 36)]
    assert secret_scan.secret_scan(docs, labels.limit(0)).where("doc_id in (1, 3, 9)").count() == 0


def test_shards_of_odd_rows(docs):
    rows = sharding.minimax_shards(docs, shards=4).collect()
    assert len(rows) == len(ROWS) and {r["shard"] for r in rows} <= {0, 1, 2, 3}
    by = {}
    for r in rows:
        by.setdefault(r["group_id"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert rows[0]["capacity"] == 2 * len(LONG)


def test_tokens_of_odd_rows(docs):
    rows = bpe.bpe_encode(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["tokens"] is None and r["n_tokens"] is None and r["round_trip"] is None for r in rows if r["doc_id"] == 2)
    assert all(r["round_trip"] for r in rows if r["tokens"] is not None)
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 3} == {0}


def test_leaks_of_odd_rows(docs, benchmark):
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, benchmark).collect())
    assert got == [(1, 1), (1, 1), (1, 4), (1, 4), (12, 1), (12, 4)]
    sliced = decontamination.find_leaks(docs, benchmark, max_item_bytes=20)
    assert sorted((r["doc_id"], r["item_id"]) for r in sliced.collect()) == got


def test_severity_of_odd_rows(docs, labels):
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(r["severity"] is None and r["grade"] is None and not r["toxic"] for r in rows if r["doc_id"] == 2)
    assert not any(r["toxic"] for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect())


def test_stages_take_odd_rows(spark, docs, labels, benchmark, tmp_path):
    import corpus_pipeline

    labels.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            n = out.count()
            assert n <= len(ROWS) and (rows is docs or n == 0)
    nulls = [(None, None), (2, None)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()]
    assert all(kept.count(x) == ROWS.count(x) for x in nulls) and (6, "") not in kept
    assert ids(corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))) == [x for x in ALL if x not in (6, 10, 12)]
    assert ids(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))) == [x for x in ALL if x not in (1, 12)]
