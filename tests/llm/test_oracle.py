import duckdb

from graphloom.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_queries_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}
