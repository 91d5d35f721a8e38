"""A sink of binary files: ``df.write.format("blobs").mode("append").save(path)`` after ``register(spark)``.

Rows (name, content) become one file each. A task writes below a folder of its own
attempt, named after its partition; the commit writes a manifest with the folders of the attempts
that count and deletes the others, so a lost executor or a second attempt leaves nothing
that a reader sees, and nothing is renamed. Files are written with pyarrow, so the folder has to be in a store that it knows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Attempt(WriterCommitMessage):
    partition: int
    folder: str
    files: int


def write_attempt(path: str, run: str, files: Iterable[tuple[str, bytes]]) -> Attempt:
    """Writes files (name, content) into the folder of this task's attempt."""
    context = TaskContext.get()
    folder, fs, n = f"part-{context.partitionId():07d}-{run}-{context.taskAttemptId()}", None, 0
    for name, content in files:
        if fs is None:
            fs, root = filesystem(f"{path}/{folder}")
            fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(content)
        n += 1
    return Attempt(context.partitionId(), folder, n)


def commit(path: str, run: str, attempts: list[Attempt | None]) -> None:
    """Adds the folders that count, in the order of partitions, to what other writes committed before, and deletes this run's others."""
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    kept = [m.folder for m in sorted((m for m in attempts if m is not None and m.files), key=lambda m: m.partition)]
    before = committed(path)
    with fs.open_output_stream(f"{root}/{MANIFEST}.{run}") as out:
        out.write(json.dumps(before + kept).encode())
    fs.move(f"{root}/{MANIFEST}.{run}", f"{root}/{MANIFEST}")
    clean(path, run, {*before, *kept})


def clean(path: str, run: str, kept: set[str]) -> None:
    """Deletes the folders of a run but for those in ``kept``."""
    fs, root = filesystem(path)
    for entry in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if entry.type == pafs.FileType.Directory and f"-{run}-" in entry.base_name and entry.base_name not in kept:
            fs.delete_dir(entry.path)


class BlobWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[Row]) -> Attempt:
        return write_attempt(self.path, self.run, ((row["name"], row["content"]) for row in iterator))

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        commit(self.path, self.run, messages)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        clean(self.path, self.run, set())


def committed(path: str) -> list[str]:
    """The folders of the manifest, in order; none without one."""
    fs, root = filesystem(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/{MANIFEST}") as held:
        return json.loads(held.read())


class Blobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"])


def write(rows: DataFrame, path: str) -> None:
    """Writes rows (name, content) as files."""
    rows.sparkSession.dataSource.register(Blobs)
    rows.select("name", "content").write.format("blobs").mode("append").save(path)


def write_made(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, bytes]]], path: str) -> None:
    """Writes the files (name, content) that ``make`` yields for the batches of each task, where they are made; what reaches the driver is a row for each task."""
    path, run = path.rstrip("/"), uuid.uuid4().hex[:12]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = write_attempt(path, run, make(batches))
        yield pa.RecordBatch.from_pylist([{"partition": done.partition, "folder": done.folder, "files": done.files}])

    try:
        attempts = rows.mapInArrow(task, "partition long, folder string, files long").collect()
    except Exception:
        clean(path, run, set())
        raise
    commit(path, run, [Attempt(*r) for r in attempts])


def read(spark: SparkSession, path: str) -> DataFrame:
    """folder_no (place of the folder in the manifest), name and content of committed files."""
    folders = committed(path)
    schema = "folder_no long, name string, content binary"
    if not folders:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{f}" for f in folders])
    places = spark.createDataFrame(list(enumerate(folders)), "folder_no long, folder string")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "content").join(F.broadcast(places), "folder").select("folder_no", "name", "content")
