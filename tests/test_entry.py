import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
CHECKED = ["term_freq", "bm25_top10", "hybrid_top10", "pagerank_links", "bfs_levels", "suggest_many", "score_buckets", "p5_found"]


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


def same(spark, sf, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = entry.queries()[name](spark, sf)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({entry.oracle_sql()[name]}) x").fetchall()
    assert plain(got.select(*names).collect()) == plain(want)


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60 and "p5_found" in queries


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf, name):
    same(spark, sf, name)


def test_empty_tables(spark, sf, tmp_path):
    for p in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{tmp_path}/{os.path.basename(p)}")
    for name in ("search", "hybrid_multi", "pagerank_converged", "bfs_levels", "ann_lsh", "ann_top5", "ann_recall", "stream_index", "p5_cascade", "spell_correct", "summaries"):
        entry.queries()[name](spark, str(tmp_path)).count()
