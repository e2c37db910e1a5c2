"""Sinks whose files count only once the whole job has ended, as Python data sources.

Each task writes files of its own under a staging folder and reports their
names, sizes and MD5 digests; on the driver the commit moves what the reports
name (a failed attempt's files are in no report), writes a manifest and drops
the staging folder, and an abort drops it alone. What has no manifest is not
read. The driver handles one report for each task, never rows.

Paths go through pyarrow's file systems (file, hdfs, s3, gs by their URI).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST, STAGING = "manifest.json", "_staging"
OPEN, BETWEEN, CLOSE = b"[\n", b",\n", b"\n]"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


def put(path: str, content: bytes) -> None:
    fs, at = file_system(path)
    with fs.open_output_stream(at) as out:
        out.write(content)


@dataclass
class Report(WriterCommitMessage):
    """A task's files: name, staged name, bytes, md5, rows and state."""

    partition: int
    files: list[dict] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    @property
    def staged(self) -> str:
        return f"{self.path}/{STAGING}/{self.run}"

    def _clear(self) -> None:
        fs, at = file_system(f"{self.path}/{STAGING}")
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)

    def _take(self, wanted: list[dict]) -> None:
        """Moves reported files to their names, and refuses a file that is not what its task reported."""
        fs, at = file_system(self.path)
        for f in wanted:
            found = fs.get_file_info(f"{at}/{STAGING}/{self.run}/{f['staged']}")
            if found.size != f["bytes"]:
                raise OSError(f"{f['name']}: {found.size} bytes, {f['bytes']} were written")
        for f in wanted:
            fs.move(f"{at}/{STAGING}/{self.run}/{f['staged']}", f"{at}/{f['name']}")

    def _finish(self, files: list[dict], **facts) -> None:
        body = {"files": [{k: v for k, v in f.items() if k != "staged"} for f in files], **facts}
        put(f"{self.path}/{MANIFEST}", json.dumps(body, indent=1).encode())
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _open(self):
        fs, at = file_system(self.staged)
        fs.create_dir(at, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        return fs, f"{at}/{name}", name


class _ArrayWriter(_Writer):
    """Rows of one string column, each a JSON record; the files joined in order of their names are one array."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Report:
        partition, rows, size, digest = TaskContext.get().partitionId(), 0, 0, hashlib.md5()
        fs, at, name = self._open()
        with fs.open_output_stream(at) as out:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    part = (BETWEEN if rows else b"") + record.encode()
                    out.write(part)
                    digest.update(part)
                    rows, size = rows + 1, size + len(part)
        return Report(partition, [{"name": f"part-{partition:06d}-b.json", "staged": name, "bytes": size, "md5": digest.hexdigest(), "rows": rows, "state": "ok"}])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files if f["rows"]]
        self._take(files)
        every = []
        for i, f in enumerate(files):
            before = OPEN if i == 0 else BETWEEN
            name = f["name"].replace("-b.json", "-a.json")
            put(f"{self.path}/{name}", before)
            every += [{"name": name, "bytes": len(before), "rows": 0}, f]
        end = CLOSE if files else b"[]"
        put(f"{self.path}/part-999999-c.json", end)
        self._finish([*every, {"name": "part-999999-c.json", "bytes": len(end), "rows": 0}], rows=sum(f["rows"] for f in files))


class JsonArray(DataSource):
    @classmethod
    def name(cls):
        return "committed_json_array"

    def writer(self, schema, overwrite):
        return _ArrayWriter(self.options["path"])


def files(name: str, get: Callable[[str], bytes]) -> type[DataSource]:
    """A data source to register whose rows (name, url, md5) are fetched with `get` and kept if the digest is right.

    A file that can't be fetched, or is damaged, is named in the manifest with its state and is not kept; a null digest
    is not checked. One file of a task is in memory at a time.
    """

    class Fetching(_Writer):
        def write(self, batches):
            report = Report(TaskContext.get().partitionId())
            for batch in batches:
                for row in batch.to_pylist():
                    try:
                        content = get(row["url"])
                    except Exception as e:  # noqa: BLE001  a file that can't be had is a row of the manifest
                        report.files.append({"name": row["name"], "bytes": 0, "state": f"failed: {type(e).__name__}"})
                        continue
                    md5 = hashlib.md5(content).hexdigest()
                    if row["md5"] is not None and md5 != row["md5"].lower():
                        report.files.append({"name": row["name"], "bytes": len(content), "md5": md5, "state": "damaged"})
                        continue
                    fs, at, staged = self._open()
                    with fs.open_output_stream(at) as out:
                        out.write(content)
                    report.files.append({"name": row["name"], "staged": staged, "bytes": len(content), "md5": md5, "state": "ok"})
            return report

        def commit(self, messages):
            every = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
            self._take([f for f in every if f["state"] == "ok"])
            self._finish(every, states={s: sum(f["state"] == s for f in every) for s in sorted({f["state"] for f in every})})

    class Files(DataSource):
        @classmethod
        def name(cls):
            return name

        def writer(self, schema, overwrite):
            return Fetching(self.options["path"])

    return Files


def manifest(path: str) -> dict | None:
    """What was committed at a path; None where nothing was."""
    fs, at = file_system(f"{path.rstrip('/')}/{MANIFEST}")
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def write_array(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """All rows as one JSON array over several files, in the order's columns if there are any; lists stay lists, nulls are written.

    No task holds more than its own partition, and of that one Arrow batch.
    """
    if manifest(path) is not None:
        raise ValueError(f"{path} holds an array already")
    df.sparkSession.dataSource.register(JsonArray)
    rows = df.orderBy(*order) if order else df
    lines = rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format("committed_json_array").mode("append").option("path", path).save()


def array_chunks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The committed array as a stream of bytes, to be written to one file elsewhere."""
    done = manifest(path)
    if done is None:
        raise FileNotFoundError(f"nothing was committed at {path}")
    fs, at = file_system(path)
    for f in done["files"]:
        with fs.open_input_stream(f"{at}/{f['name']}") as part:
            while chunk := part.read(size):
                yield chunk


def download(wanted: DataFrame, path: str, get: Callable[[str], bytes], source: str = "verified_files") -> DataFrame:
    """Fetches wanted (name, url, md5) into path; name and state (ok, damaged, failed: ...) of each."""
    spark: SparkSession = wanted.sparkSession
    spark.dataSource.register(files(source, get))
    wanted.select("name", "url", "md5").write.format(source).mode("append").option("path", path).save()
    return spark.read.option("multiLine", True).schema("files array<struct<name:string,state:string,bytes:long,md5:string>>").json(f"{path.rstrip('/')}/{MANIFEST}").select(F.explode("files").alias("f")).select("f.*")
