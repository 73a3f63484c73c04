import pytest
from conftest import DATA
from oracle import connect, difference

from tarnlight.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, DATA), connect(DATA), ORACLE[name]) == ""


def test_sql_on_odd_texts(spark, docs, words, tmp_path):
    """The same queries over null, empty, very long and foreign texts."""
    d = str(tmp_path)
    docs.where("doc_id is not null").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    urls = [None, "", "x", "http://A.example.com/en/7?q", "u://net", "http://b.net/de/#x", "://org/es/1", "http://xorg/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    for name, sql in ORACLE.items():
        if name.startswith("op1"):  # op11 reads another table; the SQL of op12 makes a row for each byte of the longest word
            continue
        assert difference(QUERIES[name](spark, d), con, sql) == "", name
