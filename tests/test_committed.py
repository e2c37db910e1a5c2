"""Sinks that commit: whole arrays over many files, verified downloads, and nothing left of an aborted job."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import committed as C


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 4), (5, 3), (20_000, 7)])
def test_files_in_order_are_one_array(spark, tmp_path, n, parts):
    df = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.array(F.lit('a"\n'), F.col("id").cast("string"))).alias("tags"))
    path = str(tmp_path / "array")
    C.write_array(df.repartition(parts), path, ["id"])
    got = json.loads(b"".join(C.array_chunks(path, 100)))
    assert got == [{"id": i, "tags": ['a"\n', str(i)] if i % 3 else None} for i in range(n)]
    files = sorted(x.name for x in (tmp_path / "array").iterdir() if not x.name.startswith(".") and x.name != C.MANIFEST)
    assert [f["name"] for f in C.manifest(path)["files"]] == files and C.manifest(path)["rows"] == n
    assert json.loads("".join((tmp_path / "array" / f).read_text() for f in files)) == got
    for f in C.manifest(path)["files"]:
        assert "md5" not in f or hashlib.md5((tmp_path / "array" / f["name"]).read_bytes()).hexdigest() == f["md5"]
    with pytest.raises(ValueError, match="already"):
        C.write_array(df, path)


def test_an_aborted_job_leaves_nothing_readable(spark, tmp_path):
    path = str(tmp_path / "broken")
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="broken row"):
        C.write_array(bad, path)
    assert C.manifest(path) is None and not list((tmp_path / "broken").iterdir())
    with pytest.raises(FileNotFoundError):
        next(C.array_chunks(path))
    C.write_array(bad.where("id < 900") if "id" in bad.columns else spark.range(3), path)
    assert len(json.loads(b"".join(C.array_chunks(path)))) == 3


def test_a_file_that_changed_before_the_commit_stops_it(spark, tmp_path, monkeypatch):
    writer = C._ArrayWriter(str(tmp_path))
    (tmp_path / C.STAGING / writer.run).mkdir(parents=True)
    (tmp_path / C.STAGING / writer.run / "x").write_bytes(b"short")
    with pytest.raises(OSError, match="5 bytes, 9"):
        writer.commit([C.Report(0, [{"name": "part-000000-b.json", "staged": "x", "bytes": 9, "rows": 1, "state": "ok"}])])
    assert C.manifest(str(tmp_path)) is None


def test_downloads_are_kept_if_their_digest_is_right(spark, tmp_path):
    def get(url):
        if url == "gone":
            raise TimeoutError(url)
        return url.encode() * 3

    digest = lambda url: hashlib.md5(url.encode() * 3).hexdigest()
    rows = [("a", "u1", digest("u1").upper()), ("b", "u2", digest("u1")), ("c", "gone", digest("gone")), ("d", "u4", None)]
    path = str(tmp_path / "files")
    got = C.download(spark.createDataFrame(rows, "name string, url string, md5 string").repartition(3), path, get)
    assert {r["name"]: r["state"] for r in got.collect()} == {"a": "ok", "b": "damaged", "c": "failed: TimeoutError", "d": "ok"}
    assert sorted(x.name for x in (tmp_path / "files").iterdir() if not x.name.startswith(".")) == ["a", "d", "manifest.json"]
    assert (tmp_path / "files" / "a").read_bytes() == b"u1u1u1"
