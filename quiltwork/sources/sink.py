"""Files written as one transaction.

Rows of path and content become files below a folder. Each task writes beside them, into a hidden folder of the job; the
driver's commit moves what tasks wrote into place, so no reader sees a part of a file, and a failed job leaves none. A file
whose content is there already isn't touched, which the tasks find out, each for its own rows.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from quiltwork.functions.text import file_name
from quiltwork.sources import store as st


@dataclass
class Staged(WriterCommitMessage):
    """Of each file of a task: its path, its digest, and where it waits (nothing if it is there already)."""

    files: list[tuple[str, str, str | None]]


def plain_path(path: str | None) -> str:
    """A path below the folder; paths that lead out of it, or nowhere, are errors."""
    found = posixpath.normpath((path or "").replace("\\", "/"))
    if not path or found in (".", "..") or found.startswith(("../", "/")) or ":" in found.split("/")[0]:
        raise ValueError(f"no path below the folder: {path!r}")
    return found


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType):
        missing = {"path", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"rows of files need the columns {sorted(missing)}")
        self.folder, self.waiting = folder, f".staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Staged:
        store, root = st.opened(self.folder)
        own, files = f"{root}/{self.waiting}/{uuid.uuid4().hex}", []
        for k, row in enumerate(rows):
            path, content = plain_path(row["path"]), row["content"]
            content = content.encode() if isinstance(content, str) else bytes(content or b"")
            digest, place = hashlib.sha256(content).hexdigest(), f"{root}/{path}"
            info = store.get_file_info(place)
            if info.type == fs.FileType.File and info.size == len(content) and st.read(store, place) == content:
                files.append((path, digest, None))
            else:
                st.write(store, f"{own}/{k}", content)
                files.append((path, digest, f"{own}/{k}"))
        return Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Paths and digests alone come to the driver. Two contents for one path are an error, and nothing is moved then."""
        store, root = st.opened(self.folder)
        wanted: dict[str, tuple[str, str | None]] = {}
        for message in messages:
            for path, digest, waits in message.files if message else ():
                if wanted.setdefault(path, (digest, waits))[0] != digest:
                    self.abort(messages)
                    raise ValueError(f"two contents for {path}")
        for path, (_, waits) in sorted(wanted.items()):
            if waits:
                store.create_dir(posixpath.dirname(f"{root}/{path}"), recursive=True)
                store.move(waits, f"{root}/{path}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = st.opened(self.folder)
        if store.get_file_info(f"{root}/{self.waiting}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.waiting}")


class FileSink(DataSource):
    """Format `filesink`: df.write.format("filesink").mode("append").save(folder). Files of other names stay."""

    @classmethod
    def name(cls) -> str:
        return "filesink"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema)


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows of path and content (text or bytes) below a folder, all or none; equal files aren't touched. Null contents are empty files."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("path", "content").write.format("filesink").mode("append").save(folder)


def document_files(documents: DataFrame, name: Column, content: str = "document") -> DataFrame:
    """path and content of documents, by name."""
    return documents.select(name.alias("path"), F.col(content).cast("binary").alias("content"))


def slice_files(slices: DataFrame, image: Column, extension: str = "png", folder: str = "") -> DataFrame:
    """path and content of the encoded cells of sheets (row, column, content): name_row_column below the folder, by the sheet's file name."""
    bare = F.regexp_replace(file_name(image), r"\.[^.]*$", "")
    path = F.concat(F.lit(folder and folder.rstrip("/") + "/"), bare, F.lit("_"), F.col("row").cast("string"), F.lit("_"), F.col("column").cast("string"), F.lit(f".{extension}"))
    return slices.select(path.alias("path"), "content")
