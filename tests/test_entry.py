import glob
import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "cnt"]


@pytest.mark.parametrize("name", ["ws_word_counts", "bl_word_counts", "decorated_symbols", "bpe_train_bl", "lang_equity", "vocab_overlap", "corpus_stats"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    ours, theirs = entry.queries()[name](spark, D).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    key = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert cols == sorted(theirs.columns) and key(ours) == key(theirs)
