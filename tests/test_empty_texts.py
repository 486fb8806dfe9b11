import pytest

import __spark_entry__ as entry


def test_char_classes_of_empty_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "a1 ."), (2, ""), (3, None), (4, ""), (5, "\n")], "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["char_classes"]).fetchall())
    assert ("other", 2, 3) in want
    assert sorted(map(tuple, entry.queries()["char_classes"](spark, str(tmp_path)).collect())) == want
