"""SNK1 with a commit: one file a notice, by batch or stream, of which all or none are there. Register
with spark.dataSource.register(RecordFiles); df has path (relative) and content."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """A task's folder below the staging folder, and how many files it holds."""

    folder: str
    files: int


class RecordFiles(DataSource):
    """Options: path, the root as a URI of any store that Arrow can reach; existing: `error` (the
    default; nothing is written then) or `replace`, for names that are there already."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema: StructType, overwrite: bool) -> "Writer":
        return Writer(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> "StreamWriter":
        return StreamWriter(dict(self.options))


class _Files:
    """Tasks write below `_staging/<job>/<attempt>`, where readers of the root's days don't look; the
    driver moves the files of the tasks that count when all have ended. The driver holds one folder's
    list at a time."""

    def __init__(self, options: dict[str, str]):
        self.root, self.replace = options["path"].rstrip("/"), options.get("existing", "error") == "replace"
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def _write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = self._store()
        folder, files = f"{base}/_staging/{self.job}/{uuid.uuid4().hex}", 0
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                if path is None or ".." in path.split("/") or path.startswith("/"):
                    raise ValueError(f"not a path below the root: {path}")
                at = f"{folder}/{path}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write((content or "").encode())
                files += 1
        return Written(folder, files)

    def _staged(self, store: fs.FileSystem, messages: list[Written | None]) -> Iterator[list[tuple[str, str]]]:
        """(staged, final) of each task's files."""
        base = self._store()[1]
        for m in messages:
            if m is not None and m.files:
                found = store.get_file_info(fs.FileSelector(m.folder, recursive=True))
                yield [(f.path, f"{base}/{f.path[len(m.folder) + 1 :]}") for f in found if f.type == fs.FileType.File]

    def _commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        if not self.replace:
            for own in self._staged(store, messages):
                taken = [i.path for i in store.get_file_info([to for _, to in own]) if i.type != fs.FileType.NotFound]
                if taken:
                    self._abort(messages)
                    raise FileExistsError(f"there already: {taken[0]}")

        def move(pair: tuple[str, str]) -> None:
            store.create_dir(pair[1].rsplit("/", 1)[0], recursive=True)
            store.move(*pair)

        with ThreadPoolExecutor(16) as pool:
            for own in self._staged(store, messages):
                list(pool.map(move, own))
        self._abort(messages)

    def _abort(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        if store.get_file_info(f"{base}/_staging/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_staging/{self.job}")


class Writer(_Files, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class StreamWriter(_Files, DataSourceStreamArrowWriter):
    """A batch that is committed again puts its files in place of its own, so a stream replaces."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.replace = True

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)
