"""Queries that take every row, on rows that the narrower ones leave out."""

from __future__ import annotations

from urllib.parse import quote

import duckdb

from quarry.catalog import ORACLES, QUERIES


def held_against_sql(spark, folder, name: str, table: str, rows: list[tuple], schema: str) -> list[dict]:
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    rel = db.sql(ORACLES[name])
    got = [r.asDict() for r in QUERIES[name](spark, str(folder)).collect()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(got, key=key) == sorted((dict(zip(rel.columns, r)) for r in rel.fetchall()), key=key)
    return got


def test_export_keeps_every_title(spark, tmp_path):
    titles = ["plain", "a <b>bold</b> c", "x &lt;y&gt; &amp;amp; z", "1 < 2", "2 > 1 & 3", "<open", None, "", "&quot;q&apos;&nbsp;"]
    rows = [(i, None if t is None else t + "\nbody <i>", "en", "src1", 1) for i, t in enumerate(titles)]
    got = held_against_sql(spark, tmp_path, "export_list", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["caption"] for r in got) == sorted(["plain", "a  bold  c", "x <y> &amp; z", "1 < 2", "2 > 1 & 3", "<open", "", "", "\"q' "])


def test_export_counts_documents(spark):
    sf = "/root/testdata/sf0.1"
    assert QUERIES["export_list"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_escape_keeps_every_character(spark, tmp_path):
    texts = ["a~b*c'd(e)f!g+h", "%21 %2A 100%", "é 漢/字?&=#", "", "plain"]
    got = held_against_sql(spark, tmp_path, "url_escape", "benchmark", list(enumerate(texts)), "item_id long, text string")
    assert {r["item_id"]: r["escaped"] for r in got} == {i: quote(t, safe="!$&'()*,-./:;=?@_~") for i, t in enumerate(texts)}
