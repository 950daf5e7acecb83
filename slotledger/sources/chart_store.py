"""Charts' CSV data: many charts in a file, each with its own header, under one manifest.

``df.write.format("chart_csv")`` takes rows (session_id, seq, csv). Each task writes one file of
chart texts, one after the other, and one index with a line for each chart (session, number,
offset, length). What a store holds is what its manifest lists, and the manifest is
replaced in one step when all tasks are done: a failed or lost task, a retried one and
a job that ends half-way leave nothing visible. Readers take a file's charts by the
index, one at a time.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

# The data source travels with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "session_id string, seq bigint, csv string"
MANIFEST = "_manifest.json"
FORMAT = "chart_csv"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.rstrip("/"))


def _read(store: fs.FileSystem, path: str) -> bytes | None:
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as stream:
        return stream.read()


def _manifest(path: str) -> list[dict]:
    """Files of the store: name, number of charts, bytes."""
    store, folder = _place(path)
    content = _read(store, f"{folder}/{MANIFEST}")
    return [] if content is None else json.loads(content)["files"]


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    charts: int
    size: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"charts-{uuid.uuid4().hex}"  # made once, on the driver

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _place(self.path)
        name, charts, offset, index, out = f"{self.job}-{uuid.uuid4().hex}", 0, 0, [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}.csv")
                    content = (row["csv"] or "").encode()
                    out.write(content)
                    index.append(json.dumps([row["session_id"], row["seq"], offset, len(content)]))
                    offset += len(content)
                    charts += 1
            if out is None:
                return _Written(None, 0, 0)
            out.close()
            with store.open_output_stream(f"{folder}/{name}.index") as stream:
                stream.write(("\n".join(index) + "\n").encode())
        except BaseException:
            if out is not None:
                out.close()
                _remove(self.path, [name])
            raise
        return _Written(name, charts, offset)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        earlier = _manifest(self.path)
        new = [{"name": m.name, "charts": m.charts, "bytes": m.size} for m in messages if m is not None and m.name]
        files = new if self.overwrite else earlier + new
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as stream:
            stream.write(json.dumps({"version": 1, "files": files}).encode())
        store.move(draft, f"{folder}/{MANIFEST}")
        if self.overwrite:  # what the new manifest no longer lists
            _remove(self.path, [f["name"] for f in earlier])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _place(self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        for file in found:  # whatever the job's tasks have written, told or not
            if file.base_name.startswith(self.job):
                store.delete_file(file.path)


def _remove(path: str, names: list[str]) -> None:
    store, folder = _place(path)
    for name in names:
        for ending in ("csv", "index"):
            file = f"{folder}/{name}.{ending}"
            if store.get_file_info(file).type != fs.FileType.NotFound:
                store.delete_file(file)


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(f["name"]) for f in _manifest(self.path)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # a store without files
            return
        store, folder = _place(self.path)
        index = _read(store, f"{folder}/{partition.name}.index")
        with store.open_input_stream(f"{folder}/{partition.name}.csv") as stream:
            for line in index.splitlines():
                session, seq, _, length = json.loads(line)
                yield session, seq, stream.read(length).decode()


class ChartStore(DataSource):
    """``spark.read`` and ``df.write`` with the format ``chart_csv``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write_charts(charts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``chart_data_csv`` rows to a chart store; one file a task."""
    charts.sparkSession.dataSource.register(ChartStore)
    rows = charts.selectExpr("session_id", "CAST(seq AS BIGINT) AS seq", "csv")
    rows.write.format(FORMAT).mode(mode).save(path)


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, seq, csv`` of all charts of a store."""
    spark.dataSource.register(ChartStore)
    return spark.read.format(FORMAT).load(path)
