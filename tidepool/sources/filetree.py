"""A tree of files, one for each row, written through a data source with a commit.

``df.write.format("file_tree").mode("append").save(root)`` with columns (dir, name, body):
tasks write into a staging folder of their own beside the tree, and the files take
their places when all tasks have ended.  A task that fails removes what it
wrote, a job that fails leaves the tree as it was.  ``root`` is a path or a URI of any
store that pyarrow's file systems reach (file, s3, gs, hdfs, …), not a local folder of an executor.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "dir string, name string, body binary"
#: Files that the commit moves at once.
MOVERS = 16


def open_store(uri: str):
    """(file system, path) of a URI or plain path."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))
    return fs.LocalFileSystem(), uri


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class FileTreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root
        self.job = uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base.rstrip('/')}/.staging-{self.job}"

    def write(self, rows: Iterator) -> Staged:
        store, base = open_store(self.root)
        folder = f"{self._staging(base)}/{uuid.uuid4().hex}"
        made: set[str] = set()
        count = 0

        def make(at: str) -> None:  # never the staging folder itself: once a failed job has removed it, its last tasks fail too
            if at not in made:
                if at != folder:
                    make(at.rsplit("/", 1)[0])
                store.create_dir(at, recursive=False)
                made.add(at)

        try:
            for row in rows:
                parts = [p for p in f"{row['dir']}/{row['name']}".split("/") if p]
                if ".." in parts:
                    raise ValueError(f"a file outside the tree: {row['dir']}/{row['name']}")
                at = "/".join([folder, *parts[:-1]])
                make(at)
                with store.open_output_stream(f"{at}/{parts[-1]}") as out:
                    out.write(bytes(row["body"] or b""))
                count += 1
        except BaseException:
            self._remove(store, folder)
            raise
        return Staged(folder, count)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base = open_store(self.root)
        base = base.rstrip("/")
        made: set[str] = set()
        with ThreadPoolExecutor(MOVERS) as pool:
            for message in (m for m in messages if m is not None and m.files):
                found = store.get_file_info(fs.FileSelector(message.folder, recursive=True))
                for at in sorted(f.path[len(message.folder):] for f in found if f.type == fs.FileType.Directory):
                    if at not in made:
                        store.create_dir(base + at, recursive=True)
                        made.add(at)
                list(pool.map(lambda f: store.move(f.path, base + f.path[len(message.folder):]), [f for f in found if f.type == fs.FileType.File]))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, base = open_store(self.root)
        self._remove(store, self._staging(base))

    @staticmethod
    def _remove(store, folder: str) -> None:
        """Remove a folder that another task may still write to."""
        from pyarrow import fs

        for wait in (0.1, 0.5, 2.0):
            try:
                if store.get_file_info(folder).type == fs.FileType.Directory:
                    store.delete_dir(folder)
                return
            except OSError:
                time.sleep(wait)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FileTreeWriter:
        if overwrite:
            raise ValueError("file_tree appends; files of the same name are replaced")
        writer = FileTreeWriter(self.options["path"])
        store, base = open_store(writer.root)
        store.create_dir(writer._staging(base), recursive=True)
        return writer


def write_files(df: DataFrame, root: str) -> str:
    """Rows (dir, name, body: string or binary) as files ``root/dir/name``."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(FileTree)
    df.select("dir", "name", F.col("body").cast("binary").alias("body")).write.format("file_tree").mode("append").save(root)
    return root
