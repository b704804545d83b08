"""Every query against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from noticeflow import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_like_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_content_to_md_of_any_text(spark, tmp_path):
    """Texts that are empty, blank or null, sources that end in a backslash, ids below 0."""
    texts = ["", " \n\t", "\xa0\u3000", None, "x"]
    docs = [(k, texts[k % 5], ["src1", "", None, "src\\"][k // 2 % 4]) for k in range(-20, 40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(catalogue.oracle_sql()["q_content_to_md"]).fetchall()
    out = catalogue.queries()["q_content_to_md"](spark, str(tmp_path)).collect()
    assert len(found) == 60 and rows(["doc_id", "markdown"], out) == rows(["doc_id", "markdown"], found)
