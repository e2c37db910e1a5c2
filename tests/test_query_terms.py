"""Query terms whose text has operators of its own, odd white space or nothing."""

import duckdb
from compare_sql import same_rows

from lodestar import catalog


def test_words_and_or_of_the_text_stay(spark, tmp_path):
    texts = ["And as", "or it", "a and and b", "ends with and", "ends OR", "and", "AND OR", "", " ", "a (b) \"c\"", "a  b", "a\x0b b", "\ta\n\n b ", None, "x AND AND y", "and and and"]
    rows = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(3)]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    same_rows(catalog.QUERIES["query_terms"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["query_terms"])
