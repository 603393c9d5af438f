"""A data source that writes the stage logs of pages: one folder for each page, all of a write or nothing.

    spark.dataSource.register(StageLogs)
    pages.write.format("stage_logs").option("path", root).mode("append").save()

Rows have document, page and log (JSON text). A task writes its pages below a hidden folder of its attempt; the commit makes each task's
folder visible by one rename, the abort removes them. So failed and repeated attempts leave nothing that `files.page_logs` reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    folder: str
    pages: int


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        missing = {"document", "page", "log"} - set(schema.names)
        if "path" not in options or missing:
            raise ValueError(f"a path and the columns document, page and log are needed; missing: {sorted(missing) or 'path'}")
        self.root, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def _hidden(self) -> str:
        return f"{self.root}/_writing-{self.job}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        fs, hidden = _open(self._hidden())
        folder, n = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0
        for row in iterator:
            if not row.document or "/" in row.document or row.document.startswith((".", "_")):
                raise ValueError(f"no name of a document's folder: {row.document!r}")
            at = f"{hidden}/{folder}/{row.document}/page{row.page:03d}"
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/log.json", compression=None) as stream:
                stream.write(row.log.encode())
            n += 1
        return Written(folder, n)

    def commit(self, messages) -> None:
        fs, hidden = _open(self._hidden())
        root = _open(self.root)[1]
        for m in messages:
            if m is not None and m.pages:
                fs.move(f"{hidden}/{m.folder}", f"{root}/part-{self.job}-{m.folder}")
        self._clear(fs, hidden)

    def abort(self, messages) -> None:
        self._clear(*_open(self._hidden()))

    @staticmethod
    def _clear(fs: pafs.FileSystem, hidden: str) -> None:
        if fs.get_file_info(hidden).type != pafs.FileType.NotFound:
            fs.delete_dir(hidden)


class StageLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stage_logs"

    def schema(self) -> str:
        return "document string, page int, log string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("stage logs are added, never replaced: use the append mode")
        return _Writer(dict(self.options), schema)
