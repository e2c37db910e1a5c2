import pytest
from compare_sql import same_rows

from lodestar import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    same_rows(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_partitions_do_not_change_results(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = lambda: sorted(map(tuple, catalog.QUERIES["lexical_top20"](spark, sf).collect()))
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_registers_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(catalog.QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_support_keeps_pairs_with_one_common_term(spark, sf):
    assert catalog.QUERIES["support_sigma"](spark, sf).where("matched = 1 and support > 0").count() > 0


def test_suggestions_cover_every_question(spark, sf):
    assert catalog.QUERIES["label_suggestion"](spark, sf).select("item_id").distinct().count() > 1
