"""Spans to files and back: a Python data source, for batches and streams.

A task writes its rows as one file of JSON lines under a name that no other attempt has. What counts is the manifest
that the driver writes when all tasks are done: it names the files of one write (or of one micro-batch, whose
manifest has its number, so that a batch that is written again takes the place of itself). Files of attempts that
failed are in no manifest, so a task that is tried again leaves no duplicate. The folder is on storage that all
executors share, by a URI that Arrow's file systems open.
"""

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, at.rstrip("/")


class _Files:
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        system, folder = _folder(self.path)
        system.create_dir(f"{folder}/data", recursive=True)
        name, n = f"data/{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n")
                n += 1
        if not n:
            system.delete_file(f"{folder}/{name}")
        return Written([name] if n else [], n)

    def _commit(self, messages, number: str) -> None:
        system, folder = _folder(self.path)
        system.create_dir(f"{folder}/manifests", recursive=True)
        made = [m for m in messages if m is not None]
        body = json.dumps({"files": sorted(f for m in made for f in m.files), "rows": sum(m.rows for m in made)}).encode()
        new = f"{folder}/manifests/.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(body)
        system.move(new, f"{folder}/manifests/{number}.json")

    def _abort(self, messages) -> None:
        system, folder = _folder(self.path)
        for f in [f for m in messages if m is not None for f in m.files]:
            if system.get_file_info(f"{folder}/{f}").type != fs.FileType.NotFound:
                system.delete_file(f"{folder}/{f}")


class SpanWriter(_Files, DataSourceWriter):
    def commit(self, messages) -> None:
        self._commit(messages, f"batch-{uuid.uuid4().hex}")

    def abort(self, messages) -> None:
        self._abort(messages)


class SpanStreamWriter(_Files, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:  # noqa: N803
        self._commit(messages, f"stream-{batchId:020d}")

    def abort(self, messages, batchId) -> None:  # noqa: N803
        self._abort(messages)


class SpanSink(DataSource):
    """df.write.format("spans").mode("append").option("path", folder), or df.writeStream likewise."""

    @classmethod
    def name(cls) -> str:
        return "spans"

    def schema(self) -> str:
        raise NotImplementedError("spans are read by read_spans")

    def writer(self, schema, overwrite) -> SpanWriter:
        return SpanWriter(self.options["path"])

    def streamWriter(self, schema, overwrite) -> SpanStreamWriter:  # noqa: N802
        return SpanStreamWriter(self.options["path"])


def read_spans(spark: SparkSession, path: str, schema) -> DataFrame:
    """What manifests name, in parallel; manifests are one a write."""
    system, folder = _folder(path)
    found = system.get_file_info(fs.FileSelector(f"{folder}/manifests", allow_not_found=True))
    files = []
    for f in found:
        if f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as stream:
                files += json.loads(stream.read())["files"]
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{f}" for f in files]) if files else spark.createDataFrame([], schema)
