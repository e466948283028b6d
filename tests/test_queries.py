"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from factweave.plans import rule_queries
from factweave.plans.catalog import QUERIES, SQL, TABLES

TINY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x


def same(spark, db, name, queries, sql):
    df = queries[name](spark, TINY)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    want = db.sql(sql[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_as_sql(spark, db, name):
    same(spark, db, name, QUERIES, SQL)


@pytest.mark.parametrize("name", sorted(rule_queries.QUERIES))
def test_rule_as_listed(spark, db, name):
    same(spark, db, name, rule_queries.QUERIES, rule_queries.SQL)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["src", "dst", "src_metric", "dst_metric"] and df.count() > 0


def test_registry():
    q = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(q) and set(QUERIES) <= set(q)


def on_texts(spark, path, name, texts, least=None):
    """Rows of a query, and of its SQL, over documents of these texts; with `least` the SQL runs without its bound of 50, as the query does."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(path))
    sql = SQL[name] if least is None else SQL[name].replace("BETWEEN 2 AND 50", f">= {least}")
    assert least is None or sql != SQL[name]
    return sorted(tuple(r) for r in df.collect()), sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})".replace(", rows FROM", ', "rows" FROM')).fetchall())


def test_near_dups_split_words_where_the_sql_does(spark, tmp_path):
    words = [f"w{i}" for i in range(20)]
    texts = [c.join(words) + f" {k}" for k in "ab" for c in (" ", "\t", "\n", "\f", "\r\n", "\x0b", "\x85", "\xa0")] + [None, "", "\x0b", " \n"]
    got, want = on_texts(spark, tmp_path, "k7_near_dups", texts)
    assert got == want and len(want) == 5 * 9


def test_near_dups_differ_from_the_sql_by_its_bound_alone(spark, tmp_path):
    texts = [" ".join(f"w{j}" for j in range(20)) + f" x{i}" for i in range(51)]
    got, want = on_texts(spark, tmp_path, "k7_near_dups", texts, least=2)
    assert got == want and len(got) == 51 * 50 // 2


def test_fragments_differ_from_the_sql_by_its_bound_alone(spark, tmp_path):
    shared = [f"line {k} of ten words that all of these texts share" for k in range(4)]
    got, want = on_texts(spark, tmp_path, "k8_fragments", ["\n".join([f"own {i}", *shared, "", f"end {i}"]) for i in range(51)], least=2)
    assert got == want and len(got) == 51 * 50 // 2
