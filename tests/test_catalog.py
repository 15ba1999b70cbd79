"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from fieldloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(df, columns):
    return df[columns].astype(object).where(df[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    want = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert plain(got, columns).equals(plain(want, columns))


def test_first_heading_against_a_plain_parser(spark, tmp_path):
    import html
    import re

    rows = [(1, "<h1>Plain</h1>"), (2, "<p>x<h1>a &amp;&amp; b</h1><h1>two</h1>"), (3, "<h1 class=t>in <b>ner</b> mark</h1>"), (4, "<p>none</p>"), (5, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def held(got, pages):
        heads = {i: re.search(r"(?is)<h1\b[^>]*>(.*?)</h1>", h or "") for i, h in pages}
        want = {i: html.unescape(re.sub(r"<[^>]*>", "", m[1])) for i, m in heads.items() if m}
        assert {r.page_id: " ".join(r.title.split()) for r in got} == {i: " ".join(x.lower().split()) for i, x in want.items()}

    held(catalog.queries()["c21b_first_heading"](spark, str(tmp_path)).collect(), rows)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    held(catalog.queries()["c21b_first_heading"](spark, SF).collect(), [tuple(r) for r in pages])
