"""Files whose names and bytes are rows: a writer and a reader as a Spark data source, with commit and abort.

Tasks write their files into a folder beside the target that only this write has, each under another name until it is whole, so a task that is lost or runs
twice leaves no half file. When all tasks are done, the driver renames that folder to the target, in one step; if the write fails, it removes it.
Nothing is seen at the target before. Rows are dealt to tasks by their names, so many small files that come from one task are made by all.

The driver lists a folder's own entries only, and deals these to `TASKS` tasks, which list and read what is below: a folder of very many folders costs no task for each.
Paths may be local to a folder that all executors share, or of any store that pyarrow opens by its URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Tasks that read a folder, at most; bytes and files of one batch of them, about.
TASKS, BATCH_BYTES, BATCH_FILES = 256, 8 << 20, 4096
#: The folder of a null, as Spark names it.
NULL = "__HIVE_DEFAULT_PARTITION__"


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A file of such a path, open for reading from any place; the path is as it stands on disk, as Spark's binaryFile gives it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, at = _store(path)
    return store.open_input_file(at)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.name, self.content = options["path"].rstrip("/"), options["name"], options["content"]
        self.folders = [c for c in options.get("folders", "").split("\t") if c]
        head, _, tail = self.path.rpartition("/")
        self.staged = f"{head}/.{tail}-{uuid.uuid4().hex}"
        self.overwrite = options.get("replace") == "true"
        self.joined = options.get("joined") == "true"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, at = _store(self.staged)
        made: set[str] = set()
        for file, rows in self._files(iterator):
            name = file[-1]
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"{name!r} is no name of a file")
            folder = "/".join([at, *(f"{c}={NULL if v is None else quote(str(v), safe=' ')}" for c, v in zip(self.folders, file))])
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                for row in rows:
                    out.write(bytes(row[self.content] or b""))
            store.move(part, f"{folder}/{name}")
        return WriterCommitMessage()

    def _files(self, rows: Iterator[Row]) -> Iterator[tuple[tuple, Iterator[Row]]]:
        """Folders and name of each file, and its rows: one, or all that follow each other."""
        of = lambda row: (*(row[c] for c in self.folders), row[self.name])
        return groupby(rows, of) if self.joined else ((of(row), [row]) for row in rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        store, staged = _store(self.staged)
        target = _store(self.path)[1]
        there = store.get_file_info(target).type != FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        store.create_dir(staged, recursive=True)  # no rows: an empty folder
        if there:
            store.move(target, f"{staged}-old")
        store.move(staged, target)
        if there:
            store.delete_dir(f"{staged}-old")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        store, staged = _store(self.staged)
        if store.get_file_info(staged).type != FileType.NotFound:
            store.delete_dir(staged)


def _seen(path: str) -> bool:
    """Names that Spark's sources leave out too are no files of a folder."""
    return not any(n.startswith(".") or n.startswith("_") and "=" not in n for n in path.split("/"))


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = _store(self.path)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if _seen(f.base_name))
        n = min(TASKS, len(names))
        return [_Names(names[i::n]) for i in range(n)] or [_Names([])]

    def read(self, partition: _Names) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = _store(self.path)
        held: list[tuple[str, bytes]] = []
        size = 0
        for name in partition.names:
            found = [store.get_file_info(f"{at}/{name}")]
            if found[0].type == fs.FileType.Directory:
                found = store.get_file_info(fs.FileSelector(found[0].path, recursive=True))
            for f in found:
                below = f.path[len(at) :].lstrip("/")
                if f.type != fs.FileType.File or not _seen(below):
                    continue
                with store.open_input_stream(f.path) as data:
                    held.append((f"{self.path}/{below}", data.read()))
                size += len(held[-1][1])
                if size > BATCH_BYTES or len(held) >= BATCH_FILES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _batch(files: list[tuple[str, bytes]]) -> pa.RecordBatch:
    paths, contents = zip(*files)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], ["path", "length", "content"])


class NamedFiles(DataSource):
    """Format named_files. Options: path; of a write, name and content (columns), folders (columns, between tabs), replace (what is at the path), joined (rows of one file that follow each other)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in all tasks, by all of their columns but the last."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns[:-1])


def write_named(rows: DataFrame, path: str, folders: list[str], name: str, content: str, replace: bool = False, order: list[str] | None = None, dealt: bool = False) -> None:
    """A file for each row, in folders column=value. The path must not be there yet, or is replaced when all files are. Of rows with one name one stays.
    dealt: rows are in many tasks already, such as those of a shuffle by what names them, and each task writes its own; they are not dealt once more.
    order: rows with one name are one file instead, their contents in the order of these columns; a task writes them one by one, so the file is never put together before."""
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    if order:
        own = [*folders, name]
        n = 4 * spark.sparkContext.defaultParallelism
        kept = rows.select(*own, *order, content).repartition(n, *own).sortWithinPartitions(*own, *order).select(*own, content)
    else:
        kept = rows.select(*folders, name, content)
        kept = kept if dealt else _dealt(kept)
    said = {"name": name, "content": content, "folders": "\t".join(folders), "replace": str(replace).lower(), "joined": str(bool(order)).lower()}
    kept.write.format("named_files").options(**said).mode("append").save(path)


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all files in a folder and the folders below."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").load(path)


def write_batch(rows: DataFrame, batch: int, path: str, folders: list[str], name: str, content: str) -> bool:
    """For foreachBatch: the files of a micro-batch in a folder batch=.. of their own. A batch that comes again, whose files are there, writes nothing. Whether it wrote."""
    spark: SparkSession = rows.sparkSession
    at = f"{path.rstrip('/')}/batch={batch}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = jvm.Path(at)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(where):
        return False
    store.mkdirs(where.getParent())
    write_named(rows, at, folders, name, content)
    return True
