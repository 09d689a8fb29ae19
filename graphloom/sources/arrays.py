"""Tables as files of arrays, one array a column: a data source that writes and reads NPZ.

    spark.dataSource.register(Arrays)
    df.write.format("arrays").mode("append").save(folder)
    spark.read.format("arrays").schema("source long, rr double").load(folder)

A task writes one file aside; the commit moves the files of the tasks that count and then writes the list of them, so a reader sees
whole writes alone. A schema that names some columns reads their arrays and no others.
Columns are numbers or booleans without nulls, or strings.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a reader gives out.
ROWS = 10_000


def _where(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _lists(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("list-"))


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


@dataclass
class Part(InputPartition):
    file: str


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.turn = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None, 0)
        table = pa.Table.from_batches(batches)
        if any(c.null_count for c in table.columns):
            raise ValueError("arrays have no nulls")
        arrays = {n: np.array(table.column(n).to_pylist()) if pa.types.is_string(table.schema.field(n).type) else table.column(n).to_numpy() for n in table.column_names}
        held = io.BytesIO()
        np.savez_compressed(held, **arrays)
        fs, root = _where(self.path)
        fs.create_dir(f"{root}/_aside-{self.turn}", recursive=True)
        task = TaskContext.get()
        file = f"{root}/_aside-{self.turn}/part-{task.partitionId()}-{task.taskAttemptId()}.npz"
        with fs.open_output_stream(file) as f:
            f.write(held.getvalue())
        return Written(file, table.num_rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _where(self.path)
        fs.create_dir(root, recursive=True)
        old, files = _lists(fs, root) if self.overwrite else [], []
        for m in messages:
            if m and m.file:
                files.append(f"part-{self.turn}-{len(files)}.npz")
                fs.move(m.file, f"{root}/{files[-1]}")
        with fs.open_output_stream(f"{root}/_list-{self.turn}") as f:
            f.write(json.dumps(files).encode())
        fs.move(f"{root}/_list-{self.turn}", f"{root}/list-{self.turn}")
        for x in old:
            fs.delete_file(x)
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_where(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_aside-{self.turn}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_aside-{self.turn}")


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Part]:
        fs, root = _where(self.path)
        files = []
        for x in _lists(fs, root):
            with fs.open_input_stream(x) as f:
                files += [Part(f"{root}/{n}") for n in json.loads(f.read())]
        return files or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _where(self.path)
        kinds = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.file) as f, np.load(f) as z:  # each array is unpacked when it is asked for
            arrays = {n: z[n] for n in kinds.names}
        n = len(next(iter(arrays.values()))) if arrays else 0
        for at in range(0, n, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(arrays[k][at : at + ROWS]).cast(kinds.field(k).type) for k in kinds.names], schema=kinds)


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> StructType:
        raise ValueError("say the columns to read, as in .schema('source long, rr double')")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)
