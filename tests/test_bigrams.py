"""Character bigrams of titles with characters beyond the basic plane."""

import duckdb

from murmur.plans.catalog import ORACLE, QUERIES


def test_a_bigram_never_begins_inside_a_character(spark, tmp_path):
    texts = ["😀a😀", "😀😀", "a😀b", "ab\nc", "a", "é😀\n😀"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], kinds).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["N24_bigram_sets"](spark, str(tmp_path)).select("doc_id", "title_bigrams", "words", "digest").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, title_bigrams, words, digest FROM ({ORACLE['N24_bigram_sets']}) x").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
