"""Arrow IPC files (stream or file format) as a Spark data source.

Saved problem splits are Arrow IPC files. ``format("arrowipc")`` reads a
directory (or glob) of them with one input partition per file, yielding
Arrow record batches straight to Spark; writing produces one file per
task. Register once per session with ``register(spark)``.
"""

from __future__ import annotations

import glob as _glob
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

FORMAT = "arrowipc"


def _local(path: str) -> str:
    """A mounted folder as the operating system names it; other stores are not for this format."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"Arrow IPC files are read from mounted folders, not {path}")
    return path


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        found = [os.path.join(path, f) for f in sorted(os.listdir(path))
                 if f.endswith(".arrow") and not f.startswith(".")]
    else:
        found = [f for f in sorted(_glob.glob(path)) if not os.path.basename(f).startswith(".")]
    return found


def _open(path: str):
    import pyarrow as pa
    import pyarrow.ipc as ipc
    src = pa.memory_map(path, "r")
    try:
        return ipc.open_file(src)
    except pa.ArrowInvalid:
        src = pa.memory_map(path, "r")
        return ipc.open_stream(src)


@dataclass
class _FilePartition(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path = _local(path)
        self.schema = schema

    def partitions(self):
        return [_FilePartition(p) for p in _files(self.path)]

    def read(self, partition):
        import pyarrow as pa
        r = _open(partition.path)
        names = [f.name for f in self.schema.fields]
        batches = ([r.get_batch(i) for i in range(r.num_record_batches)]
                   if hasattr(r, "num_record_batches") else r)
        for b in batches:
            cols = [b.column(b.schema.get_field_index(n)) if n in b.schema.names
                    else pa.nulls(b.num_rows) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)


@dataclass
class _Written(WriterCommitMessage):
    tmp: str
    final: str


class _Writer(DataSourceArrowWriter):
    """Each task attempt writes a hidden temporary file; the driver's
    ``commit`` publishes only the files of successful attempts, so a
    retried task never leaves a duplicate behind."""

    def __init__(self, path: str):
        self.path = _local(path)

    def commit(self, messages):
        for m in messages:
            if m is not None and m.tmp:
                os.replace(m.tmp, m.final)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.tmp and os.path.exists(m.tmp):
                os.remove(m.tmp)

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.ipc as ipc
        from pyspark import TaskContext
        ctx = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{ctx.partitionId():05d}-{uuid.uuid4().hex[:8]}.arrow"
        tmp = os.path.join(self.path, f".{name}.attempt-{ctx.attemptNumber()}.tmp")
        writer = None
        for batch in iterator:
            if writer is None:
                writer = ipc.new_stream(pa.OSFile(tmp, "wb"), batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return _Written("", "")
        writer.close()
        return _Written(tmp, os.path.join(self.path, name))


class ArrowIpcDataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        p = _files(self.options["path"])
        if not p:
            raise FileNotFoundError(self.options["path"])
        from pyspark.sql.pandas.types import from_arrow_schema
        return from_arrow_schema(_open(p[0]).schema)

    def reader(self, schema):
        return _Reader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def register(spark) -> None:
    from pairforge.session import ship_package
    ship_package(spark)
    spark.dataSource.register(ArrowIpcDataSource)
