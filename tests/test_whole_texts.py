"""Text queries read whole documents: held against their SQL with the article view's two cuts taken out."""

import duckdb
import pytest

from topicloom.plans import book, catalogue

from .test_catalogue import TABLES, table

CUTS = {"left(split_part(d.text, chr(10), 1), 120)": "split_part(d.text, chr(10), 1)", "left(d.text, 400)": "d.text"}


def whole(sql):
    for cut, text in CUTS.items():
        sql = sql.replace(cut, text)
    return sql


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_nothing_of_a_text_is_lost(spark, sf_dir):
    got = {r["ord"]: (r["title"], r["description"]) for r in book.articles(spark, sf_dir).collect()}
    docs = book.table(spark, sf_dir, "documents").collect()
    assert max(len(r["text"] or "") for r in docs) > 400
    for r in docs:
        assert got[r["doc_id"]] == (None if r["text"] is None else r["text"].split("\n")[0], r["text"])


@pytest.mark.parametrize("name", sorted(n for n, s in catalogue.ORACLE_SQL.items() if whole(s) != s))
def test_query_over_whole_texts(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = duck.execute(whole(catalogue.ORACLE_SQL[name]))
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in found.description], found.fetchall())
