"""knn_native: equal to its SQL on odd vectors and near ties, and no row for each pair."""

import contextlib
import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare_sql import same_rows

from lodestar import catalog
from lodestar.operators import retrieve

NAME = "knn_native"


def hold_against_sql(spark, tmp_path, vectors, element):
    import duckdb

    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(element)), "label": pa.array([i % 3 for i in range(len(vectors))], pa.int32())}), path)
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from '{path}'")
        same_rows(catalog.QUERIES[NAME](spark, str(tmp_path)), con, catalog.ORACLE_SQL[NAME])


@pytest.mark.parametrize("tile", [7, 512])
def test_scores_that_round_to_one_value_are_ranked_by_id(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(retrieve, "TILE", tile)
    rng = np.random.default_rng(5)
    one = rng.normal(size=8)
    # a third is one vector, a third differs from it by less than the last place, falling and rising with the id
    vectors = [(one * (1 + 3e-12 * (i % 7 - 3)) if i % 3 == 0 else one if i % 3 == 1 else rng.normal(size=8)).tolist() for i in range(400)]
    hold_against_sql(spark, tmp_path, vectors, pa.float64())


def test_missing_elements_and_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=6).round(3).tolist() for _ in range(220)]
    vectors[50], vectors[100], vectors[150] = None, vectors[100][:4], [None, *vectors[150][1:]]
    vectors[3], vectors[7], vectors[8], vectors[9] = None, [], [None] * 6, [9.0, 9.0]
    hold_against_sql(spark, tmp_path, vectors, pa.float32())


@pytest.mark.parametrize("bare", [None, []])
def test_fewer_vectors_than_places(spark, tmp_path, bare):
    hold_against_sql(spark, tmp_path, [[1.0, 2.0], bare, [0.5, 0.5], bare] + [bare] * 60, pa.float32())


@pytest.mark.parametrize("vectors", [[], [None] * 60])
def test_no_vector_at_all(spark, tmp_path, vectors):
    hold_against_sql(spark, tmp_path, vectors, pa.float32())


def test_pairs_are_not_rows(spark, sf):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        catalog.QUERIES[NAME](spark, sf).explain()
    assert "NestedLoop" not in text.getvalue() and "Cartesian" not in text.getvalue()


def test_rounding_is_that_of_sql(duck):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=2000), rng.normal(size=500) * 1e7, np.arange(-50, 50) / 2e9, [0.0, -0.0, np.inf, -np.inf, np.nan, 1e300, 2.0**53 + 2]])
    want = duck.execute("select round(x, 9) from (select unnest(?) as x)", [x.tolist()]).fetchnumpy()
    np.testing.assert_array_equal(retrieve._rounded(x, 9), np.asarray(list(want.values())[0], dtype=float))
